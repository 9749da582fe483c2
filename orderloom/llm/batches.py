"""Packed batches of documents and the hash exchange between them.

Window operators compare every position of every text with every other. A row per
position would make a shuffle many times the input, so positions travel packed:
documents are written as batches of a few MB, each batch sends its sorted distinct
keys to buckets by key, a bucket answers each batch with one bit per key, and the
batch - whose keys follow again from its text - reads the bits. A key that fills a
third of all texts reaches its bucket once per batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import U, columns, lean, slices, utf8, written

BATCH_BYTES = 4 << 20
KEYS_PER_BUCKET = 1 << 20
#: Batches of a Parquet row group.
GROUP_BATCHES = 2
BATCH_SCHEMA = "batch_id long, n_bytes long, ids array<long>, offsets binary, data binary"
ANSWER_SCHEMA = "batch_id long, bucket int, mask binary"


def make_batches(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Batches of whole documents, written; null text is empty, ids may be null or repeat.

    ``data`` is zstd over ``n_bytes`` of text, so that scans, exchanges and sorts of the
    JVM hold a third of it; only the task that works on a batch unpacks it.
    """

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for part in parts:
            data, offsets = utf8(part.column("text"))
            ids = part.column("doc_id").cast(pa.int64())
            for a, b in slices(offsets, batch_bytes):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()), pa.array([offsets[b] - offsets[a]], pa.int64()), pa.array([ids.slice(a, b - a).to_pylist()], pa.list_(pa.int64())),
                        pa.array([(offsets[a : b + 1] - offsets[a]).tobytes()], pa.binary()), pa.array([pa.compress(data[offsets[a] : offsets[b]].tobytes(), "zstd", asbytes=True)], pa.binary()),
                    ],
                    ["batch_id", "n_bytes", "ids", "offsets", "data"],
                )
                number += 1

    return written(columns(docs, "doc_id", "text").mapInArrow(lean(pack), BATCH_SCHEMA), "batches", group_rows=GROUP_BATCHES)


class Batch:
    """One batch row as arrays; ``ids`` has -1 and ``known`` False where an id is null."""

    def __init__(self, table: pa.Table | pa.RecordBatch, row: int = 0):
        at = {n: i for i, n in enumerate(table.schema.names)}
        self.batch_id = table.column(at["batch_id"])[row].as_py()
        raw = table.column(at["ids"])[row].values
        self.ids = raw.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.known = ~np.asarray(raw.is_null())
        self.raw_ids = raw
        self.offsets = np.frombuffer(table.column(at["offsets"])[row].as_buffer(), np.int64)
        size = table.column(at["n_bytes"])[row].as_py()
        self.data = np.frombuffer(pa.decompress(table.column(at["data"])[row].as_buffer(), size, "zstd"), np.uint8) if size else np.zeros(0, np.uint8)


def batch_rows(fn: Callable[[Batch], Iterator[pa.RecordBatch]]):
    """For mapInArrow: applies ``fn`` to one batch row at a time."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in range(part.num_rows):
                yield from fn(Batch(part, row))

    return lean(run)


def bucket_bits(keys: int, per_bucket: int = KEYS_PER_BUCKET) -> int:
    """Bits of a key that name its bucket, so that a bucket has about ``per_bucket`` keys."""
    return max(4, int(np.ceil(np.log2(max(1, keys / per_bucket)))))


def short(keys: np.ndarray, bits: int) -> np.ndarray:
    """The top ``bits`` + 32 bits of 64-bit keys: bucket, then what is sent."""
    return keys >> U(32 - bits)


def by_bucket(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted short keys."""
    if len(keys):
        which = (keys >> U(32)).astype(np.int64)
        cut = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
        for a, b in zip(cut, np.append(cut[1:], len(keys)), strict=True):
            yield int(which[a]), int(a), int(b)


def low(keys: np.ndarray) -> np.ndarray:
    return (keys & U(0xFFFFFFFF)).astype(np.uint32)


def bits_of(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def read_answers(answers: pa.Table, keys: np.ndarray, bits: int, column: str = "mask") -> np.ndarray:
    """The answer for each of a batch's sorted short keys."""
    out = np.zeros(len(keys), bool)
    got = dict(zip(answers.column("bucket").to_pylist(), answers.column(column).to_pylist(), strict=True))
    for bucket, a, b in by_bucket(keys, bits):
        if got.get(bucket) is not None:
            out[a:b] = flags(got[bucket], b - a)
    return out


def repeated_keys(keyed: DataFrame, hot: int | None = None) -> DataFrame:
    """Answers for rows (bucket, batch_id, keys, twice): which keys two batches hold,
    or one batch holds twice by its own account (``twice``). Keys are fixed-width
    and sorted; the width follows from their type name in ``width``.

    With ``hot``, rows are of COUNTED_SCHEMA (heavy: the places of keys that a batch holds
    ``HEAVY`` times or more; counts: how often) and answers have one more column, hot: the
    keys that all batches together hold so often, or null for none. Keys that a batch holds
    less often count once there, so a key is hot by ``HEAVY * hot`` occurrences at the latest.
    """

    def merge(group: pa.Table) -> pa.Table:
        width = group.column("width")[0].as_py()
        keys = [np.frombuffer(k, np.dtype(f"u{width}")) for k in group.column("keys").to_pylist()]
        twice = [flags(t, len(k)) for t, k in zip(group.column("twice").to_pylist(), keys, strict=True)]
        every, weight = np.concatenate(keys), np.concatenate(twice) + np.int64(1)
        ends = np.cumsum([len(k) for k in keys])
        order = np.argsort(every)
        ordered = every[order]
        head = np.append(True, ordered[1:] != ordered[:-1])
        first = np.flatnonzero(head)
        each = np.cumsum(head) - 1

        def parts(chosen: np.ndarray) -> list[np.ndarray]:
            mask = np.zeros(len(every), bool)
            mask[order] = chosen[each]
            return np.split(mask, ends[:-1])

        many = parts(np.add.reduceat(weight[order], first) >= 2)
        keep = [i for i, p in enumerate(many) if p.any()]
        out = {
            "batch_id": group.column("batch_id").take(pa.array(keep, pa.int64())),
            "bucket": pa.array([group.column("bucket")[0].as_py()] * len(keep), pa.int32()),
            "mask": pa.array([bits_of(many[i]) for i in keep], pa.binary()),
        }
        if hot is not None:
            total = np.ones(len(every), np.int64)
            for end, k, at, n in zip(ends.tolist(), keys, group.column("heavy").to_pylist(), group.column("counts").to_pylist(), strict=True):
                total[end - len(k) + np.frombuffer(at, np.uint32).astype(np.int64)] = np.frombuffer(n, np.uint32)
            often = parts(np.add.reduceat(total[order], first) >= hot)
            out["hot"] = pa.array([bits_of(often[i]) if often[i].any() else None for i in keep], pa.binary())
        return pa.table(out)

    return keyed.groupBy("bucket").applyInArrow(lean(merge), ANSWER_SCHEMA if hot is None else ANSWER_SCHEMA + ", hot binary")


KEY_SCHEMA = "bucket int, batch_id long, width int, keys binary, twice binary"


COUNTED_SCHEMA = KEY_SCHEMA + ", heavy binary, counts binary"
#: Occurrences of a key in one batch from which on they are counted.
HEAVY = 8


def counted_key_rows(batch_id: int, keys: np.ndarray, twice: np.ndarray, count: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of COUNTED_SCHEMA for sorted distinct short keys that occur ``count`` times."""
    cuts = list(by_bucket(keys, bits))
    if cuts:
        sent = low(keys)
        heavy = [np.flatnonzero(count[a:b] >= HEAVY) for _, a, b in cuts]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([c[0] for c in cuts], pa.int32()), pa.array([batch_id] * len(cuts), pa.int64()), pa.array([4] * len(cuts), pa.int32()),
                pa.array([sent[a:b].tobytes() for _, a, b in cuts], pa.binary()), pa.array([bits_of(twice[a:b]) for _, a, b in cuts], pa.binary()),
                pa.array([h.astype(np.uint32).tobytes() for h in heavy], pa.binary()),
                pa.array([count[a:b][h].astype(np.uint32).tobytes() for h, (_, a, b) in zip(heavy, cuts, strict=True)], pa.binary()),
            ],
            ["bucket", "batch_id", "width", "keys", "twice", "heavy", "counts"],
        )


def with_answers(batches: DataFrame, answers: DataFrame, fn: Callable[[Batch, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Applies ``fn`` to each batch and its answers, brought together by batch_id."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    want = to_arrow_schema(StructType.fromDDL(schema))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [rb for row in range(left.num_rows) for rb in fn(Batch(left, row), right)]
        return pa.Table.from_batches(out).cast(want) if out else want.empty_table()

    return batches.groupBy("batch_id").cogroup(answers.groupBy("batch_id")).applyInArrow(lean(run), schema)


def total_bytes(batches: DataFrame) -> int:
    return batches.agg(F.sum("n_bytes")).first()[0] or 0
