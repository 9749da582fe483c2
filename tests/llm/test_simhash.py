import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm.common import table
from orderloom.llm.simhash import fingerprint, fingerprint_classes, linked, op13_simhash_dedup, simhash_components
from tests.llm.helpers import DOCS, as_dict, corpus, frame, words

WIDE = "".join(f"w{i} " for i in range(50000))


def shingles(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []


def brute_prints(spark, rows):
    """doc_id -> fingerprint, with Spark's own XXH64 (seed 42)."""
    pairs = [(r[0], s) for r in rows for s in shingles(r[1])]
    hashes = spark.createDataFrame(pairs, "doc_id long, s string").select("doc_id", F.xxhash64("s").alias("h")).collect()
    out = {r[0]: 0 for r in rows}
    by = {}
    for d, h in hashes:
        by.setdefault(d, []).append(h % (1 << 64))
    for d, hs in by.items():
        out[d] = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))
    return out


def brute_classes(prints, budget=3):
    """id -> least id reachable over links."""
    root = {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= budget:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in ids}


def close_prints(rng, n):
    """Random fingerprints, chains and dense groups of close ones, the ends of the range."""
    out = {0, (1 << 64) - 1, 1 << 63}
    while len(out) < n:
        x = rng.getrandbits(64) if rng.random() < 0.3 else rng.choice(sorted(out)[:50])
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_fingerprint_is_the_majority_of_shingle_hashes(spark):
    rows = [*corpus(3), (900, "UPPER lower ÄÖ", "", "", 0), (901, "one", "", "", 0), (902, "two words", "", "", 0), (903, "a a a a a a", "", "", 0), (904, "x y z q", "", "", 0)]
    want = brute_prints(spark, rows)
    got = as_dict(simhash_components(frame(spark, rows)))
    assert {k: int(r.fingerprint, 16) for k, r in got.items()} == want
    assert all(len(r.fingerprint) == 16 for r in got.values())
    assert {k: r.component_id for k, r in got.items()} == brute_classes(want)
    assert fingerprint(WIDE.encode()) != 0  # several chunks


@pytest.mark.parametrize("seed", range(3))
def test_trie_walk_finds_every_link(seed):
    rng = random.Random(seed)
    prints = close_prints(rng, 700)
    want = brute_classes(dict(zip(prints, prints, strict=True)))
    u, v = linked(np.array(prints, np.uint64), None, 0, 0, 3)
    got = {p: p for p in prints} | dict(zip(u.tolist(), v.tolist(), strict=True))
    assert got == want
    assert len(u) == len(set(u.tolist()))  # at most one link for each fingerprint


def test_walk_in_spark_and_numpy(spark, block=40):
    rng = random.Random(7)
    prints = close_prints(rng, 250)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = {r.fp: r.root for r in fingerprint_classes(fps, 3, block).collect()}
    want = brute_classes(dict(zip(signed, prints, strict=True)))
    assert {s: got.get(s, s) for s in signed} == want


def test_dense_group_across_nodes(spark):
    """A ball of fingerprints at one or two bits, far more than a node holds."""
    centre = 0x0123456789ABCDEF
    ball = sorted({centre ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i, 64)})
    fps = spark.createDataFrame([(s - (1 << 64) if s >> 63 else s,) for s in ball], "fp long")
    got = fingerprint_classes(fps, 3, 500).collect()
    assert len(got) == len(ball) and len({r.root for r in got}) == 1


def test_odd_rows(spark):
    rows = [(5, None, None, None, None), (4, " \n", "", "", 0), (None, "", "", "", 0), (None, "some text of words", "", "", 0), (9, "some text of words", "", "", 0), (9, "other words here now", "", "", 0), (3, "other words here now", "", "", 0)]
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash_components(frame(spark, rows)).collect())
    zero = "0" * 16
    a, b = (f"{fingerprint(t):016x}" for t in (b"some text of words", b"other words here now"))
    assert got == sorted([("5", zero, "4"), ("4", zero, "4"), ("None", zero, "None"), ("None", a, "None"), ("9", a, "9"), ("9", b, "3"), ("3", b, "3")])
    empty = simhash_components(spark.createDataFrame([], DOCS))
    assert empty.count() == 0 and empty.columns == ["doc_id", "fingerprint", "component_id"]


def test_query(spark, data):
    rows = [(r.doc_id, r.text) for r in table(spark, data, "documents").collect()]
    want = brute_prints(spark, rows)
    got = as_dict(op13_simhash_dedup(spark, data))
    assert {k: int(r.fingerprint, 16) for k, r in got.items()} == want
    assert {k: r.component_id for k, r in got.items()} == brute_classes(want)
