import glob
import tracemalloc

import numpy as np
import pyarrow.parquet as pq

from orderloom.llm import suffix as S
from orderloom.llm.batches import GROUP_BATCHES, Batch, make_batches
from tests.llm.helpers import DOCS, as_dict, corpus, frame


def brute(rows, length):
    seen, out = set(), {}
    for doc_id, text, *_ in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        own = [b[i : i + length] for i in range(len(b) - length + 1)]
        for i, w in enumerate(own):
            if w in seen:
                gone[i : i + length] = b"\1" * length
        seen.update(own)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc_id] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def test_against_brute_force(spark):
    rows = corpus()
    want = brute(rows, 50)
    for array_bytes in (1 << 20, 700):  # one array a shard, then many that are merged
        got = as_dict(S.suffix_dedup(frame(spark, rows), array_bytes=array_bytes))
        assert {k: (r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for k, r in got.items()} == want


def test_other_lengths_and_order_of_ids(spark):
    rows = [(9 - i, t, None, None, None) for i, t in enumerate(["abcdefghijklmnop" * 3, "xx" + "abcdefghijklmnop" * 2, "a" * 100, "a" * 90, None, "", "\x00" * 40, "\x00" * 41])]
    got = as_dict(S.suffix_dedup(frame(spark, rows), length=16, gram=8))
    assert {k: (r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for k, r in got.items()} == brute(rows, 16)


def test_null_and_equal_ids(spark):
    rows = [(None, "z" * 80, None, None, None), (5, "z" * 80, None, None, None), (5, "z" * 80, None, None, None)]
    assert all(r.n_removed == 0 for r in S.suffix_dedup(spark.createDataFrame(rows, DOCS)).collect())
    assert S.suffix_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    for n, kinds in ((0, 2), (1, 2), (7, 1), (300, 2), (2000, 3), (5000, 1)):
        text = rng.integers(0, kinds, n).astype(np.uint8)
        raw = text.tobytes()
        sa = S.suffix_array(text)
        assert sa.tolist() == sorted(range(n), key=lambda i: raw[i:])
        lcp = S.common_prefixes(text, sa, 50, lanes=7)
        for k in range(1, n):
            a, b = raw[sa[k - 1] :], raw[sa[k] :]
            m = 0
            while m < min(len(a), len(b), 50) and a[m] == b[m]:
                m += 1
            assert lcp[k] == m


def test_binary_search_merge():
    rng = np.random.default_rng(1)
    parts, every = [], {}
    for _ in range(4):
        rows = sorted({bytes(x) for x in rng.integers(0, 4, (50, 3)).astype(np.uint8)})
        low = rng.integers(0, 100, len(rows))
        parts.append((np.frombuffer(b"".join(rows), "S3"), low))
        for r, v in zip(rows, low.tolist(), strict=True):
            every[r] = min(every.get(r, 10**9), v)
    for (have, _), low in zip(parts, S.merge_arrays(parts), strict=True):
        assert [every[x.ljust(3, b"\0")] for x in have.tolist()] == low.tolist()


def test_hot_anchors_fill_other_shards(spark):
    """A phrase in every document with other text around it each time, at a bound that makes its anchors hot."""
    phrase = "the quick brown fox jumps over"
    rows = [(i, f"{i * 7919:>30} {phrase} {'abcdefgh'[i % 5] * 30} {i}", None, None, None) for i in range(200)] + corpus()[:40]
    rows = [(i, r[1], None, None, None) for i, r in enumerate(rows)]
    want = brute(rows, 50)
    for hot in (1, 50):
        got = as_dict(S.suffix_dedup(frame(spark, rows), hot_slices=hot, shard_bytes=2000))
        assert {k: (r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for k, r in got.items()} == want


def test_batches_are_packed_in_small_row_groups(spark):
    """A reader holds a row group whole: it has few batches, however many its file has, and their text is packed."""
    texts = [None, "", *("some words again and again " * 40 + str(i) for i in range(60))]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS).coalesce(1)
    batches = make_batches(docs, batch_bytes=2000)
    files = [pq.ParquetFile(f) for f in glob.glob(f"{batches._scratch_path.removeprefix('file://')}/*.parquet")]
    rows = [f.metadata.row_group(g).num_rows for f in files for g in range(f.metadata.num_row_groups)]
    assert sum(rows) > 5 * GROUP_BATCHES and max(rows) <= GROUP_BATCHES
    stored = batches.toArrow()
    assert sum(len(x) for x in stored.column("data").to_pylist()) < sum(stored.column("n_bytes").to_pylist()) / 2
    got = {}
    for row in range(stored.num_rows):
        b = Batch(stored, row)
        got |= {int(k): b.data[i:j].tobytes().decode() for k, i, j in zip(b.ids, b.offsets[:-1], b.offsets[1:], strict=True)}
    assert got == {i: t or "" for i, t in enumerate(texts)}


def test_only_arrays_of_one_anchor_are_merged(monkeypatch):
    merged = []
    monkeypatch.setattr(S, "merge_arrays", lambda parts, f=S.merge_arrays: merged.append(len(parts)) or f(parts))
    rng = np.random.default_rng(2)
    bodies = [rng.integers(97, 100, 60).astype(np.uint8) for _ in range(40)]
    size = np.full(40, 60)
    for key, sets in ((np.arange(40) // 2, 0), (np.where(np.arange(40) < 20, 99, np.arange(40) // 2), 1)):
        merged.clear()
        out = S.slice_leasts(np.concatenate(bodies), np.arange(40) * 60, size, key.astype(np.uint64), np.arange(40), 6, array_bytes=300)
        assert len(merged) == sets  # 20 slices of one anchor need several arrays, pairs do not
        least = {}
        for i, b in enumerate(bodies):
            for k in range(55):
                w = (int(key[i]), b[k : k + 6].tobytes())
                least[w] = min(least.get(w, 99), i)
        # windows of other anchors may be equal in this table; arrays may tell, but need not
        for i, b in enumerate(bodies):
            for k in range(55):
                assert out[i * 55 + k] <= least[int(key[i]), b[k : k + 6].tobytes()]


def test_memory_of_an_array():
    """Bytes held at a time for each byte of a suffix array's text; several workers share an executor."""
    rng = np.random.default_rng(4)
    bodies = rng.integers(97, 123, 1_000_000).astype(np.uint8)
    size = np.full(10_000, 100)
    windows, begin = size - 49, np.arange(10_000) * 101
    text, at = S.gather(bodies, np.arange(10_000) * 100, size, gap=1)
    assert (at == begin).all()
    tracemalloc.start()
    S.least_by_window(text, at, windows, np.arange(10_000), 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 * len(text), peak / len(text)
