"""Every pipeline stage and document operator on nulls, empties, long texts, repeated ids, empty tables and odd column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orderloom.llm.common import table
from orderloom.llm.decontam import contaminated, decontaminate
from orderloom.llm.exact_dedup import exact_dedup
from orderloom.llm.licences import scan_licences
from orderloom.llm.neardup import near_components
from orderloom.llm.quality import quality_scores
from orderloom.llm.toxicity import toxicity_scores
from tests.llm.helpers import DOCS

NAMES = ("rank", "place", "copy", "__id", "__text", "__size", "a.b", "row", "id", "at", "class", "node", "doc", "body", "score", "label", "size")
LONG = " ".join(f"word{i}" for i in range(20000))
SAME = "the same text of more than five words here"
ROWS = [
    (1, SAME, "en", "s", 9), (2, SAME, None, None, None), (3, None, "en", "s", None), (4, "", "en", None, 0), (None, "without an id but with some words", "en", "s", 1),
    (None, None, None, None, None), (5, LONG, "en", "s", len(LONG)), (6, SAME + " and then", "en", "s", 1), (6, "another text under the id of the one before", "en", "t", 1), (7, " \n ", "en", "s", 3),
]


def odd(spark, rows=ROWS):
    df = spark.createDataFrame(rows, DOCS)
    for name in NAMES:
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, data, name, stage):
    docs = odd(spark)
    out = stage(spark, docs, data)
    rows = out.collect()
    if name == "tokens":
        assert len(rows) == len(ROWS) and all(r.n_tokens >= 1 for r in rows)
    else:
        assert out.columns == docs.columns and all(r["a.b"] == "x" and r["__id"] == "x" for r in rows)
    ids = [r.doc_id for r in rows]
    if name in ("toxicity", "decontamination"):
        assert sorted(map(str, ids)) == sorted(str(r[0]) for r in ROWS)
    if name == "near_dedup":
        assert sorted(map(str, ids)) == sorted(map(str, [1, 3, 4, None, None, 5, 6, 6, 7]))
    if name == "mixing":
        assert {1, 5} <= set(ids) and not {3, 4, 7} & set(ids)
    assert stage(spark, docs.limit(0), data).count() == 0


def test_exact_dedup_of_rows_without_ids(spark):
    rows = [(None, "a", None, None, None), (None, "a", None, None, None), (None, "b", None, None, None), (1, "b", None, None, None), (2, None, None, None, None), (3, "", None, None, None)]
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup(odd(spark, rows)).collect())
    assert got == [("1", "1", 2, True), ("2", "3", 2, False), ("3", "3", 2, True), ("None", "1", 2, False), ("None", "None", 2, True), ("None", "None", 2, True)]


def test_licences_read_each_row_for_itself(spark):
    first = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."
    rest = 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.'
    rows = [(1, first, None, None, None), (1, rest, None, None, None), (2, f"{first} {rest}", None, None, None)]
    rows += [(None, "Released under the MIT License.", None, None, None)] * 2
    got = sorted((str(r.doc_id), r.rule, r.matches) for r in scan_licences(odd(spark, rows)).collect())
    assert got == [("2", "mit-full", 1), ("None", "mit-short", 1), ("None", "mit-short", 1)]


def test_a_repeated_id_is_one_document_in_links(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:-1], "x"])
    rows = [(1, " ".join(base), None, None, None), (7, near, None, None, None), (7, "short one", None, None, None), (8, "short one", None, None, None)]
    for _ in range(2):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_components(odd(spark, rows)).collect())
        assert got == [(1, 59, 1), (7, 1, 1), (7, 59, 1), (8, 1, 8)]


def test_repeated_and_null_labels(spark, data):
    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    more = labels.unionByName(labels.limit(20)).unionByName(spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 7, 7)], labels.schema))
    twice = docs.unionByName(docs.limit(30))
    for fn, label in ((quality_scores, "quality"), (toxicity_scores, "toxic")):
        a, b = (sorted((r.doc_id, r.score) for r in fn(twice, more).collect()) for _ in range(2))
        assert a == b and len(a) == twice.count() and all(0 <= s <= 1 for _, s in a)
        assert fn(docs.limit(0), labels).count() == 0 and fn(odd(spark), labels.limit(0)).count() == len(ROWS)


def test_decontamination_without_items(spark, data):
    docs = odd(spark)
    assert contaminated(docs, table(spark, data, "benchmark").limit(0)).count() == 0
    items = spark.createDataFrame([(1, None), (2, ""), (3, SAME)], "item_id long, text string")
    assert sorted(r.doc_id for r in contaminated(docs, items).collect()) == [1, 2, 6]


def test_decontamination_of_rows_without_ids_and_items_of_two_texts(spark):
    rows = [(None, "so " + SAME, None, None, None), (None, SAME, None, None, None), (None, "a clean text of some more words", None, None, None), (8, SAME, None, None, None), (0, "a clean text of some more words", None, None, None)]
    items = spark.createDataFrame([(3, "quite other words that are nowhere to be found " * 2), (3, SAME)], "item_id long, text string")
    found = sorted((str(r.doc_id), r.item_id, r.item_shingles, r.shared) for r in contaminated(odd(spark, rows), items).collect())
    assert found == [("8", 3, 5, 5), ("None", 3, 5, 5), ("None", 3, 5, 5)]
    assert sorted(str(r.doc_id) for r in decontaminate(odd(spark, rows), items).collect()) == ["0", "None"]
