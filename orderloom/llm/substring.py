"""Substring dedup with fixed-block anchors.

A window of ``window`` words holds one whole reference block when blocks are the
non-overlapping runs of (window + 1) // 2 words from each document's start. The
blocks of all documents are indexed; every rolling run of that many words, in every
document, probes the index. A block that is hit from no other place rules out its
windows. Around the blocks that are hit, hits are extended word by word over all
the windows that hold the block: windows that occur again elsewhere merge to
maximal exact repeats, and their words go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm.batches import (
    ANSWER_SCHEMA, KEY_SCHEMA, Batch, batch_rows, bits_of, bucket_bits, by_bucket, flags, low, make_batches,
    read_answers, repeated_keys, short, total_bytes, with_answers,
)
from orderloom.llm.common import NOT_SPACE, U, lean, powers, range_hash, row_bounds, table, word_hashes, written

WINDOW = 35
PROBE_SCHEMA = "bucket int, batch_id long, blocks binary, probes binary, twice binary"


class Words:
    """A batch's words, its blocks and its windows.

    ``bounds``: where each document's words begin. A run's hash is that of its word
    hashes, so equal runs of words have equal hashes wherever they stand.
    """

    def __init__(self, batch: Batch, window: int):
        self.hash, row, self.start, self.end = word_hashes(batch.data, batch.offsets, NOT_SPACE)
        self.bounds = row_bounds(row, len(batch.offsets) - 1)
        self.window, self.block = window, (window + 1) // 2
        n = np.diff(self.bounds)
        self.within = np.arange(len(row)) - np.repeat(self.bounds[:-1], n)
        self.left = np.repeat(n, n) - self.within  # words from here to the document's end

    def run_hashes(self, at: np.ndarray, length: int, which: int = 0) -> np.ndarray:
        sums = np.zeros(len(self.hash) + 1, U)
        np.cumsum(self.hash * powers(len(self.hash), which), out=sums[1:])
        return range_hash(sums, at, at + length, which)

    def probes(self) -> np.ndarray:
        """Every place at which a run of a block's length begins."""
        return np.flatnonzero(self.left >= self.block)

    def blocks(self) -> np.ndarray:
        return np.flatnonzero((self.left >= self.block) & (self.within % self.block == 0))

    def candidates(self, hit: np.ndarray) -> np.ndarray:
        """Places of windows whose block (the first that starts in them) is hit; ``hit``: for each of blocks()."""
        good = np.zeros(len(self.hash) + 1, bool)
        good[self.blocks()[hit]] = True
        at = np.flatnonzero(self.left >= self.window)
        return at[good[at + (-self.within[at]) % self.block]]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, whether each occurs more than once)."""
    ordered = np.sort(keys)
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first], np.diff(np.append(first, len(ordered))) > 1


def probe_index(probed: DataFrame) -> DataFrame:
    """Answers for rows of PROBE_SCHEMA: which of each batch's blocks occur twice or more."""

    def look_up(group: pa.Table) -> pa.Table:
        blocks = [np.frombuffer(b, np.uint32) for b in group.column("blocks").to_pylist()]
        index = np.unique(np.concatenate(blocks))
        seen = np.zeros(len(index), np.int64)
        for raw, twice in zip(group.column("probes").to_pylist(), group.column("twice").to_pylist(), strict=True):
            # probes look into the index, not the other way: each is looked up once, however many batches there are
            probes = np.frombuffer(raw, np.uint32)
            at = np.minimum(np.searchsorted(index, probes), max(0, len(index) - 1))
            hit = index[at] == probes if len(index) else np.zeros(len(probes), bool)
            seen[at[hit]] += 1 + flags(twice, len(probes))[hit]
        masks = [seen[np.searchsorted(index, b)] >= 2 for b in blocks]
        keep = [i for i, m in enumerate(masks) if m.any()]
        return pa.table({
            "batch_id": group.column("batch_id").take(pa.array(keep, pa.int64())),
            "bucket": pa.array([group.column("bucket")[0].as_py()] * len(keep), pa.int32()),
            "mask": pa.array([bits_of(masks[i]) for i in keep], pa.binary()),
        })

    return probed.groupBy("bucket").applyInArrow(lean(look_up), ANSWER_SCHEMA)


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """What stays of each document once repeated runs of ``window`` words are removed.

    Returns doc_id, n_words, n_removed, removed (array of (start, end) word ranges,
    the maximal exact repeats), kept_text (the other words, joined by one space):
    one row for each row of ``docs``. A word goes when a window over it occurs
    anywhere else, the same document included; all occurrences go. Windows are
    judged on the input. Null and empty texts have no words; texts shorter than the
    window lose nothing; rows that repeat a doc_id are separate texts; an empty
    table gives no rows; extra columns are ignored.

    Windows are compared by 64 bits of one hash and the bucket's bits of another.
    """
    batches = make_batches(docs)
    n_bytes = total_bytes(batches)
    bits = bucket_bits(n_bytes // 5)

    def probe(batch: Batch) -> Iterator[pa.RecordBatch]:
        w = Words(batch, window)
        probes, twice = distinct(short(w.run_hashes(w.probes(), w.block), bits))
        blocks = np.unique(short(w.run_hashes(w.blocks(), w.block), bits))
        own = {k: blocks[a:b] for k, a, b in by_bucket(blocks, bits)}
        cuts = list(by_bucket(probes, bits))
        if cuts:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([c[0] for c in cuts], pa.int32()), pa.array([batch.batch_id] * len(cuts), pa.int64()),
                    pa.array([low(own.get(c[0], blocks[:0])).tobytes() for c in cuts], pa.binary()),
                    pa.array([low(probes[a:b]).tobytes() for _, a, b in cuts], pa.binary()), pa.array([bits_of(twice[a:b]) for _, a, b in cuts], pa.binary()),
                ],
                ["bucket", "batch_id", "blocks", "probes", "twice"],
            )

    hits = written(probe_index(batches.mapInArrow(batch_rows(probe), PROBE_SCHEMA)), "block-hits")

    def candidates(batch: Batch, answers: pa.Table) -> tuple[Words, np.ndarray]:
        w = Words(batch, window)
        own = short(w.run_hashes(w.blocks(), w.block), bits)
        blocks = np.unique(own)
        return w, w.candidates(read_answers(answers, blocks, bits)[np.searchsorted(blocks, own)])

    def window_keys(w: Words, at: np.ndarray) -> np.ndarray:
        """(bucket from one hash, 64 bits of another), sorted as pairs by callers."""
        return np.rec.fromarrays([(w.run_hashes(at, window, 1) >> U(64 - bits)).astype(np.int32), w.run_hashes(at, window)], names="bucket,key")

    def extend(batch: Batch, answers: pa.Table) -> Iterator[pa.RecordBatch]:
        w, at = candidates(batch, answers)
        keys = window_keys(w, at)
        order = np.lexsort((keys.key, keys.bucket))
        keys = keys[order]
        if not len(keys):
            return
        first = np.flatnonzero(np.append(True, (keys.key[1:] != keys.key[:-1]) | (keys.bucket[1:] != keys.bucket[:-1])))
        twice = np.diff(np.append(first, len(keys))) > 1
        own = keys[first]
        cut = np.flatnonzero(np.append(True, own.bucket[1:] != own.bucket[:-1]))
        ends = np.append(cut[1:], len(own))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(own.bucket[cut], pa.int32()), pa.array([batch.batch_id] * len(cut), pa.int64()), pa.array([8] * len(cut), pa.int32()),
                pa.array([own.key[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
                pa.array([bits_of(twice[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary()),
            ],
            ["bucket", "batch_id", "width", "keys", "twice"],
        )

    repeats = written(repeated_keys(with_answers(batches, hits, extend, KEY_SCHEMA)), "window-repeats")

    # both kinds of answers reach the last step under one roof: blocks' with bucket >= 0, windows' below 0
    both = hits.unionByName(repeats.withColumn("bucket", -1 - F.col("bucket")))

    def remove(batch: Batch, answers: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket = answers.column("bucket").to_numpy()
        w, at = candidates(batch, answers.filter(pa.array(bucket >= 0)))
        again = answers.filter(pa.array(bucket < 0))
        got = dict(zip((-1 - again.column("bucket").to_numpy()).tolist(), again.column("mask").to_pylist(), strict=True))
        keys = window_keys(w, at)
        order = np.lexsort((keys.key, keys.bucket))
        ordered = keys[order]
        head = np.append(True, (ordered.key[1:] != ordered.key[:-1]) | (ordered.bucket[1:] != ordered.bucket[:-1]))[: len(ordered)]
        own = ordered[head].bucket
        many = np.zeros(len(own), bool)
        cut = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else []
        for a, b in zip(cut, np.append(cut[1:], len(own)) if len(own) else [], strict=True):
            if own[a] in got:
                many[a:b] = flags(got[own[a]], b - a)
        gone = np.zeros(len(w.hash) + 1, np.int64)
        hit = at[order[many[np.cumsum(head) - 1]]] if len(own) else at[:0]
        np.add.at(gone, hit, 1)
        np.add.at(gone, hit + window, -1)
        gone = np.cumsum(gone)[:-1] > 0
        yield removal_rows(batch, w, gone)

    out = with_answers(batches, both, remove, "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string")
    out._scratch = [batches, hits, repeats]
    return out


def removal_rows(batch: Batch, w: Words, gone: np.ndarray) -> pa.RecordBatch:
    """One row for each document of the batch; ``gone``: for each word."""
    raw, n_words, n_removed, spans, texts = batch.data.tobytes(), [], [], [], []
    # runs of removed words, never across documents
    edge = np.zeros(len(gone), bool)
    edge[w.bounds[:-1][w.bounds[:-1] < len(gone)]] = True
    begins = np.flatnonzero(gone & (edge | ~np.append(False, gone[:-1])))
    ends = np.flatnonzero(gone & np.append(edge[1:] | ~gone[1:], True)) + 1 if len(gone) else begins
    per = np.searchsorted(begins, w.bounds)
    for i in range(len(batch.ids)):
        a, b = int(w.bounds[i]), int(w.bounds[i + 1])
        lo, hi = per[i], per[i + 1]
        spans.append([{"start": int(s) - a, "end": int(e) - a} for s, e in zip(begins[lo:hi], ends[lo:hi], strict=True)])
        n_words.append(b - a)
        n_removed.append(int((ends[lo:hi] - begins[lo:hi]).sum()))
        # kept words lie between the removed runs; split() has the words' own separators
        kept, at = [], a
        for s, e in [*zip(begins[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True), (b, b)]:
            if at < s:
                kept += raw[w.start[at] : w.end[s - 1]].split()
            at = e
        texts.append(b" ".join(kept).decode("utf-8"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [batch.raw_ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(texts, pa.string())],
        ["doc_id", "n_words", "n_removed", "removed", "kept_text"],
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i+34], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
r AS (SELECT g FROM p GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM p JOIN r USING (g)),
k AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM w WHERE len(ws) > 0),
kept AS (SELECT k.doc_id, string_agg(ws[k.k], ' ' ORDER BY k.k) AS t, count(*) AS n FROM k ANTI JOIN gone ON k.doc_id = gone.doc_id AND k.k = gone.k GROUP BY k.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
