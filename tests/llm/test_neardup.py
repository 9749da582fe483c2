import random
from collections import Counter

import numpy as np

from orderloom.llm.graph import components
from orderloom.llm.neardup import MAX_LEVELS, TOKENS, branch, drop_near_copies, near_components, plan_trees, recall
from tests.llm.helpers import DOCS, as_dict, corpus, frame, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(rows, n):
    out = {}
    for r in rows:
        w = words((r[1] or "").translate(LOW))
        out[r[0]] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def brute(rows, n, percent=80):
    s = sets(rows, n)
    ids, up = sorted(s), {k: k for k in s}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(s[a] & s[b])
            if both and 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {k: (len(s[k]), root(k)) for k in ids}


def test_against_brute_force(spark):
    rows = corpus(3, 120)
    for n in (2, 5):
        got = as_dict(near_components(frame(spark, rows), words=n))
        assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == brute(rows, n)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_chains_and_large_nodes_find_all_links(spark):
    """A chain of near copies that its least member does not reach, in nodes that must branch."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        base = list(base)
        for _ in range(3):
            base[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(base), None, None, None))
    got = as_dict(near_components(frame(spark, rows), words=2, small_node=4))
    assert {k: r.component_id for k, r in got.items()} == {k: c for k, (_, c) in brute(rows, 2).items()}


def test_large_class_whose_nearest_sketches_fail(spark):
    """Documents at 0.80 from one member of a large class and 0.79 from the others, of which some have nearer sketches."""
    rng, rows = random.Random(3), []
    core = [f"c{i}" for i in range(400)]
    for i in range(400):
        w = list(core)
        for k in range(15):
            w[k * 3] = f"m{i}_{k}"
        rows.append((i, " ".join(w), None, None, None))
    for q in range(40):
        w = rows[rng.randrange(400)][1].split()
        for k in range(2, 15):
            w[k * 3] = f"q{q}_{k}"
        for k in range(9):
            w[48 + k * 3] = f"r{q}_{k}"
        rows.append((1000 + q, " ".join(w), None, None, None))
    want = {k: c for k, (_, c) in brute(rows, 2).items()}
    assert set(want.values()) == {0}
    assert {k: r.component_id for k, r in as_dict(near_components(frame(spark, rows), words=2, small_node=4)).items()} == want


def test_trees_follow_depth():
    assert round(recall(20, 8, 1, 0), 3) == 0.974 and round(recall(20, 3, 1, 5), 3) == 0.974
    for levels in range(1, 11):
        trees, copies = plan_trees(levels)
        assert recall(trees, levels, copies, MAX_LEVELS) >= 0.99, levels


def test_recall_at_the_deepest_nodes(spark):
    """Pairs at the threshold, followed down by ``branch`` to the deepest setting."""
    rng, pairs, levels = np.random.default_rng(4), 800, 3
    one = rng.integers(1, 1 << 32, (pairs, TOKENS), dtype=np.uint32)
    two = np.where(rng.random((pairs, TOKENS)) < 0.8, one, rng.integers(1, 1 << 32, (pairs, TOKENS), dtype=np.uint32))
    rows = [(2 * i + k, 1, 0, 0, m[i].tobytes()) for i in range(pairs) for k, m in enumerate((one, two))]
    docs = spark.createDataFrame(rows, "doc long, n long, s1 long, s2 long, mins binary")
    trees, copies = plan_trees(levels)
    nodes = branch(docs, levels, trees, 80)
    for deep in range(MAX_LEVELS):
        nodes = branch(nodes.join(docs.select("doc", "mins"), "doc"), 1, 1 if deep else copies, 80)
    both = nodes.selectExpr("node", "doc", "doc div 2 as pair").distinct().groupBy("pair", "node").count().filter("count = 2")
    assert both.select("pair").distinct().count() >= 0.985 * pairs  # 0.974 of them with 20 trees alone


def test_edges_of_input(spark):
    assert near_components(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b c", None, None, None), (1, "A B c", None, None, None), (2, None, None, None, None), (3, "a b C", None, None, None), (3, "a b C", None, None, None), (4, "a", None, None, None), (5, "a", None, None, None)]
    out = near_components(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out) == Counter(
        [(None, 2, None, True), (1, 2, 1, True), (2, 0, 2, True), (3, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (5, 1, 4, False)]
    )
    kept = drop_near_copies(spark.createDataFrame(rows, DOCS), words=2)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(70)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(k, k) == root(k) for k in up)
