from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from orderloom.llm.mixing import QuotaTree, block_plan, mix_report, mix_sources, mixed_documents, op3_mix_sources, permuted, sized, source_targets
from tests.llm.helpers import DOCS, corpus, frame, words


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), epochs=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    total, w = float(sum(sizes.values())), {s: weights[i % len(weights)] for i, s in enumerate(names)}
    t, free = {}, set(names)
    while free:
        left = total - sum(t.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > epochs * sizes[s]}
        if not over:
            t |= share
            break
        for s in over:
            t[s] = float(epochs * sizes[s])
        free -= over
    return t


def test_targets_with_caps(spark):
    rows = [(i, "w " * n, None, s, None) for i, (s, n) in enumerate([("a", 3), ("b", 100), ("c", 50), (None, 200), ("d", 1), ("e", 0)])]
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    got = {r.source: r.target for r in source_targets(sized(frame(spark, rows))).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_report(spark):
    rows = corpus(6)
    out = mix_report(frame(spark, rows), block_words=16, shard_words=500).collect()
    again = mix_report(frame(spark, rows), block_words=16, shard_words=500).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    sizes, source = defaultdict(int), {r[0]: r[3] for r in rows}
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want, taken = brute_targets(sizes), defaultdict(int)
    assert len(out) == len(rows)
    for r in out:
        assert r["size"] == len(words(rows[r.doc_id][1])) and r.taken <= 3 * r["size"]
        assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-6
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_each_copy_is_taken_once_and_shards_hold_their_quotas(spark):
    pieces, _ = mix_sources(frame(spark, corpus(6)), block_words=16, shard_words=500)
    rows = pieces.collect()
    per = defaultdict(int)
    for p in rows:
        per[p.shard] += p.n_words
    assert len({(p["rank"], p.place, p.copy) for p in rows if p.n_words}) == len(rows)
    for shard in per:
        at = sorted(p.position for p in rows if p.shard == shard)
        assert at == list(range(1, len(at) + 1))
    assert len(per) > 8


def test_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        a = permuted(np.arange(n), np.full(n, n), np.full(n, 5))
        b = permuted(np.arange(n), np.full(n, n), np.full(n, 6))
        assert sorted(a.tolist()) == sorted(b.tolist()) == list(range(n))
        assert n < 64 or (a != b).any() and (a != np.arange(n)).any()


def test_tree_divides_exact_quotas():
    whole, drawn, spare = [100, 0, 37, 900], [10, 5, 0, 200], [3, 0, 60, 100]
    tree = QuotaTree(whole, drawn, spare, 7, seed=3)
    load = np.zeros(7, int)
    for s in range(4):
        n = whole[s]
        leaf, taken = tree.place(np.full(n, s), np.zeros(n, bool), np.arange(n))
        assert taken.all()
        load += np.bincount(leaf, minlength=7)
        n = drawn[s] + spare[s]
        leaf, taken = tree.place(np.full(n, s), np.ones(n, bool), np.arange(n))
        assert taken.sum() == drawn[s]
        assert 0 < np.diff(taken.astype(int)).__abs__().sum() or min(drawn[s], spare[s]) == 0  # each shard draws from its own
        load += np.bincount(leaf, minlength=7)
    assert load.sum() == 1415 and load.max() - load.min() <= 1


def model(rows, h, block, leaves, seed=7):
    """doc_id -> words taken, without Spark but for the hash that orders a source's documents."""
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    want = brute_targets({s: sum(len(words(r[1])) for r in rs) for s, rs in by.items()})
    names = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    size = [sum(len(words(r[1])) for r in by[s]) for s in names]
    plans = [block_plan(n, round(want[s]), block) for n, s in zip(size, names, strict=True)]
    tree = QuotaTree(*([p[k] for p in plans] for k in range(3)), leaves, seed)
    out = {}
    for k, s in enumerate(names):
        at, blocks = 0, defaultdict(list)
        for r in sorted(by[s], key=lambda r: (h[r[0]], r[0])):
            blocks[at // block].append(r)
            at += len(words(r[1]))
        times, left = divmod(round(want[s]), size[k]) if size[k] else (0, 0)
        n = -(-size[k] // block)
        turn = permuted(np.arange(n), np.full(n, n), np.full(n, 2 * k + 1 + 1000 * seed))
        _, taken = tree.place(np.full(n, k), np.ones(n, bool), turn)
        for r in by[s]:
            out[r[0]] = times * len(words(r[1]))
        for b in sorted(range(n), key=lambda b: (not taken[b], turn[b])):
            for r in blocks[b]:
                got = min(left, len(words(r[1])))
                out[r[0]] += got
                left -= got
    return out


def hashes(spark, rows, seed=7):
    ids = spark.createDataFrame([(r[0],) for r in rows], "doc_id long")
    return {r.doc_id: r.h for r in ids.select("doc_id", F.xxhash64(F.lit(seed), "doc_id").alias("h")).collect()}


def test_words_taken_of_each_document(spark):
    """The mix against a model of it; another tree takes other words."""
    rows = corpus(6)
    h, got = hashes(spark, rows), {}
    for leaves in (8, 11):
        got[leaves] = {r.doc_id: r.taken for r in mix_report(frame(spark, rows), block_words=64, shards=leaves).collect()}
        assert got[leaves] == model(rows, h, 64, leaves)
    assert got[8] != got[11]


def test_query(spark, data):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = op3_mix_sources(spark, data).collect()
    assert {r.doc_id: r.taken for r in got} == model(rows, hashes(spark, rows), 1024, 8)
    assert len({r.first_shard for r in got} - {None}) == 8


def test_documents_of_the_mix(spark):
    rows = corpus(6)
    docs = frame(spark, rows, extra=False)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    took = {r.doc_id: r.taken for r in mix_report(docs).collect()}
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += len(words(r.text))
        assert words(r.text) == words(rows[r.doc_id][1])[: len(words(r.text))]
    assert all(got[k] == v for k, v in took.items())


def test_edges_of_input(spark):
    assert mix_report(spark.createDataFrame([], DOCS)).count() == 0
    assert mixed_documents(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "a b", None, None, 3), (1, "a b", None, None, 3), (None, "c", None, "s", 1), (2, None, None, "s", None)]
    out = mix_report(spark.createDataFrame(rows, DOCS))
    assert out.count() == 4 and out.agg(F.sum("taken")).first()[0] == 5
    assert mixed_documents(spark.createDataFrame(rows, DOCS)).count() >= 3
