import hashlib
import tracemalloc
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from orderloom.llm.common import byte_values, prefix_sums, range_hash, word_hashes
from orderloom.llm.substring import substring_dedup
from tests.llm.helpers import DOCS, as_dict, corpus, frame, words


def brute(rows, window):
    ws = {r[0]: words(r[1]) for r in rows}
    seen = Counter(tuple(w[i : i + window]) for w in ws.values() for i in range(len(w) - window + 1))
    out = {}
    for k, w in ws.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out[k] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def test_against_brute_force(spark):
    rows = corpus()
    for window in (35, 6, 1):
        got = as_dict(substring_dedup(frame(spark, rows), window))
        want = brute(rows, window)
        assert {k: (r.n_words, r.n_removed, r.kept_text) for k, r in got.items()} == want
        for r in got.values():
            assert sum(s.end - s.start for s in r.removed) == r.n_removed


def test_repeats_inside_one_document(spark):
    rows = [(1, "a b c d x a b c d", "", "", 0), (2, "a a a a a a", "", "", 0), (3, "q", "", "", 0)]
    got = as_dict(substring_dedup(frame(spark, rows), 4))
    assert got[1].kept_text == "x" and got[2].kept_text == "" and got[3].kept_text == "q"


def test_empty_table_and_digest(spark):
    assert substring_dedup(spark.createDataFrame([], DOCS)).count() == 0
    out = substring_dedup(spark.createDataFrame([(None, "a", None, None, 1)], DOCS)).withColumn("d", F.sha2(F.encode("kept_text", "utf-8"), 256))
    assert out.first().d == hashlib.sha256(b"a").hexdigest()


def test_word_hashes_are_made_block_by_block():
    """A batch's words cost memory by their number, not eight bytes and more for each byte of text at a time."""
    rng = np.random.default_rng(3)
    data = rng.choice(np.frombuffer(b"abcdefgh  ", np.uint8), 2_000_000)
    data[300_000:900_000] = 120  # a word longer than a block
    offsets = np.array([0, 7, 7, 250_000, 2_000_000])
    for which in (0, 1):
        word_hashes(data[:1000], np.array([0, 1000]), which=which)
        tracemalloc.start()
        hashes, row, start, end = word_hashes(data, offsets, which=which)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (hashes == range_hash(prefix_sums(byte_values(data, which), which), start, end, which)).all()
        assert peak < 32 * len(data)
