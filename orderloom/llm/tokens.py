"""Token-ID output as ORC: run-length coded integers, row indexes, Bloom filters.

A data set is a folder with two ORC tables. ``tokens``: part, doc_id, local_start,
n_tokens and the ids of one document a row, in ascending doc_id order within and
across files, with a Bloom filter on doc_id and a row index every
``row_stride`` rows, so that readers run stripe by stripe and prune by metadata.
``manifest``: for each file its id range, token count and the number of tokens in
all files before it.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderloom.llm.common import checkpoint_dir, columns, lean, slices, table, utf8

END_ID = 1
FILE_BYTES = 48 << 20
#: Text that is encoded at once, and parts of words that a worker remembers.
ENCODE_BYTES, CACHE_PARTS = 2 << 20, 200_000
#: Words that the tokenizer splits into their letters and the signs after them (no apostrophe, which may begin
#: an ending, and no <, which may begin a special token).
PLAIN = (
    "^(?P<stem>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f\u0430-\u044f]+)"
    r"(?P<tail>[!\"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]*)$"
)
WORD_END = "</w>"
# The definition under which a text's ids are those of its words, and a word's those of its parts.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def word_by_word(definition: dict) -> bool:
    """Whether a tokenizer (its JSON) encodes words apart as ``WordEncoder`` cuts them."""
    model, cut = definition["model"], (definition.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (
        model.get("type") == "BPE" and model.get("end_of_word_suffix") == WORD_END and not model.get("dropout") and definition.get("normalizer") == NORMALIZER
        and [c.get("type") for c in cut] == ["Split", "ByteLevel"] and cut[0]["pattern"] == {"Regex": SPLIT} and cut[0]["invert"] and not cut[1]["add_prefix_space"]
        and not definition.get("truncation") and not definition.get("padding")
        and all(t["content"].startswith("<") and " " not in t["content"] and not t["lstrip"] and not t["rstrip"] for t in definition["added_tokens"])
    )


class WordEncoder:
    """Encodes texts by the distinct parts of their words, each once.

    With a tokenizer that ``word_by_word`` knows, a text's ids are those of its words in
    order, and those of a word of letters and signs are its letters' and its signs'.
    Parts are remembered; beyond ``CACHE_PARTS`` those that the last texts used stay.
    Texts go whole to any other tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cuts = word_by_word(json.loads(self.tokenizer.to_str()))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.known = {"": 0}  # part -> its number in begin, size
        self.flat, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.used = np.zeros(1, np.int64)

    def ids(self, texts: list[str], at_once: int) -> Iterator[np.ndarray]:
        """The ids of each text; the library's results, which are large, live for ``at_once`` texts."""
        for i in range(0, len(texts), at_once):
            for e in self.tokenizer.encode_batch_fast(texts[i : i + at_once], add_special_tokens=False):
                yield np.asarray(e.ids, np.uint32)

    def remember(self, parts: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts)), strict=True))
        self.begin = np.append(self.begin, len(self.flat) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.flat = np.append(self.flat, ids)

    def learn(self, parts: list[str], together: bool) -> None:
        """``together``: each is one part to the tokenizer, so many go in one text and word ends tell them apart."""
        if together:
            ids = np.concatenate(list(self.ids([" ".join(parts[i : i + 256]) for i in range(0, len(parts), 256)], 16)))
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(parts):  # a part that was taken for one is several
                return self.learn(parts, False)
            self.remember(parts, ids, np.diff(last, prepend=-1))
        else:
            each = list(self.ids(parts, 4096))
            self.remember(parts, np.concatenate(each), np.array([len(x) for x in each], np.int64))

    def forget(self) -> None:
        """Keeps the parts that the last texts used."""
        names, keep = list(self.known), np.union1d(self.used, [0])
        self.known = {names[k]: i for i, k in enumerate(keep.tolist())}
        size = self.size[keep]
        begin = np.cumsum(size) - size
        self.flat = self.flat[np.arange(int(size.sum())) + np.repeat(self.begin[keep] - begin, size)]
        self.begin, self.size = begin, size

    def numbers(self, parts: pa.Array, together: bool) -> np.ndarray:
        """The number of each part, new ones learned."""
        coded = parts.dictionary_encode()
        names = coded.dictionary.to_pylist()
        new = [p for p in names if p not in self.known]
        if new:
            self.learn(new, together)
        self.used = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        return self.used[coded.indices.to_numpy()]

    def encode(self, texts: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end id after each; number of ids of each)."""
        if not self.cuts:
            each = [np.append(x, np.uint32(end_id)) for x in self.ids(texts.to_pylist(), 16)]
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.array([len(x) for x in each], np.int64)
        if len(self.known) > CACHE_PARTS:
            self.forget()
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        cut = pc.extract_regex(coded.dictionary, PLAIN)
        plain = pc.is_valid(cut)
        flat = cut.filter(plain)
        n = len(flat)
        halves = self.numbers(pa.concat_arrays([pc.utf8_lower(flat.field("stem")), flat.field("tail")]), True)
        used = self.used
        odd = self.numbers(coded.dictionary.filter(pc.invert(plain)), False)
        self.used = np.append(used, self.used)
        # the two parts of each distinct word, and the ids that they have one after the other
        plain = plain.to_numpy(zero_copy_only=False)
        parts = np.zeros((len(plain), 2), np.int64)
        parts[plain] = np.stack([halves[:n], halves[n:]], axis=1)
        parts[~plain, 0] = odd
        size = self.size[parts]
        each, two = size.sum(axis=1), size.ravel()
        at = np.arange(int(two.sum()), dtype=np.int64) + np.repeat(self.begin[parts].ravel() - np.cumsum(two) + two, two)
        # the end id acts as one more word behind each text
        ids = np.append(self.flat[at], np.uint32(end_id))
        size = np.append(each, 1).astype(np.int32)
        begin = (np.cumsum(size) - size).astype(np.int32)
        n_words = split.value_lengths().to_numpy()
        which = np.insert(coded.indices.to_numpy(), np.cumsum(n_words), len(size) - 1)
        n = size[which]
        ends = np.cumsum(n, dtype=np.int32)
        out = ids[np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat(begin[which] - ends + n, n)]
        return out, np.diff(ends[np.cumsum(n_words + 1) - 1].astype(np.int64), prepend=0)


_ENCODERS: dict[str, WordEncoder] = {}


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES,
    stripe_bytes: int = 16 << 20, row_stride: int = 1000,
) -> None:
    """Tokenise ``docs`` and write the data set at ``path``.

    Each document's ids end with ``end_id``; a null or empty text is that id alone.
    Rows that repeat a doc_id are written one after the other, null ids first;
    an empty table gives a data set without rows. Extra columns are ignored.
    """
    rows = columns(docs, "doc_id", "text")
    size = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    parts = max(1, -(-(size[0] or 0) // file_bytes), min(size[1], rows.sparkSession.sparkContext.defaultParallelism))
    ordered = rows.repartitionByRange(int(parts), "doc_id").sortWithinPartitions("doc_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = WordEncoder(tokenizer)
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column("text").fill_null("")
            _, offsets = utf8(texts)
            for a, b in slices(offsets, ENCODE_BYTES):
                ids, n = _ENCODERS[tokenizer].encode(texts.slice(a, b - a), end_id)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b - a, part, np.int32)), batch.column("doc_id").slice(a, b - a), pa.array(start + ends - n), pa.array(n), lists],
                    ["part", "doc_id", "local_start", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    coded = ordered.mapInArrow(lean(encode), f"part int, doc_id {dict(rows.dtypes)['doc_id']}, local_start long, n_tokens long, ids array<int>")
    coded.write.options(**{
        "compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
        "orc.stripe.size": str(stripe_bytes), "orc.row.index.stride": str(row_stride), "orc.create.index": "true",
    }).orc(f"{path}/tokens")
    spark = docs.sparkSession
    back = spark.read.schema(coded.schema).orc(f"{path}/tokens")  # reads three columns, not the ids
    per = back.groupBy("part").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    per = per.withColumn("before", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per.write.option("compression", "zstd").orc(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids from a data set; no rows from an empty one."""
    tokens, manifest = spark.read.orc(f"{path}/tokens"), spark.read.orc(f"{path}/manifest")
    # one small row per file: broadcast while that is sure to be small, else merge
    base = manifest.select("part", "before").hint("broadcast" if manifest.count() <= 100_000 else "merge")
    return tokens.join(base, "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def find_document(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """The rows of one document (all that repeat its id; none if it is not there); stripes that
    cannot hold it are skipped by ranges and Bloom filters."""
    return read_tokens(spark, path).filter(F.col("doc_id") == doc_id)


def ids_digest(tokens: DataFrame) -> DataFrame:
    """Replaces ids by ids_crc32 of them as little-endian unsigned 32-bit integers, row by row: null and
    repeated doc_ids stay as they are, an empty table gives no rows, other columns are dropped."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat, off = np.asarray(lists.flatten(), dtype="<u4"), lists.offsets.to_numpy()
            off = off - off[0] if len(off) else off
            sums = [zlib.crc32(flat[off[i] : off[i + 1]].data) for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(lean(crc), f"doc_id {dict(tokens.dtypes)['doc_id']}, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Writes the data set and reads back doc_id, start, n_tokens, ids_crc32, a row for each row of ``docs``.

    Null and empty texts, repeated and null ids, empty tables and extra columns as in ``write_tokens``.
    """
    spark = docs.sparkSession
    path = path or f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer or tokenizer_path())
    return ids_digest(read_tokens(spark, path))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))
