import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from orderloom.llm.exact_dedup import exact_dedup
from tests.llm.helpers import DOCS, as_dict, corpus, frame


def check(df, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    got = as_dict(df)
    assert len(got) == len(rows)
    for r in rows:
        ids, x = groups[r[1] or ""], got[r[0]]
        assert (x.keep_id, x.group_size, x.kept) == (max(ids), len(ids), r[0] == max(ids))
        assert x.text_sha256 == hashlib.sha256((r[1] or "").encode()).hexdigest()


def test_against_brute_force(spark):
    rows = corpus()
    check(exact_dedup(frame(spark, rows)), rows)


def test_hot_group_and_one_salt(spark):
    rows = [(i, "same" if i % 3 else f"t{i}", None, None, None) for i in range(90)]
    check(exact_dedup(frame(spark, rows), salts=1), rows)
    check(exact_dedup(frame(spark, rows), salts=7), rows)


def test_colliding_digests_are_told_apart_by_content(spark):
    rows = corpus(2)
    check(exact_dedup(frame(spark, rows), digest=lambda c: F.length(c).cast("string")), rows)


def test_empty_and_repeated_rows(spark):
    assert exact_dedup(spark.createDataFrame([], DOCS)).count() == 0
    out = exact_dedup(spark.createDataFrame([(1, "a", None, None, 1), (1, "a", None, None, 1), (None, "a", None, None, 1)], DOCS)).collect()
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in out) == [(0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]
