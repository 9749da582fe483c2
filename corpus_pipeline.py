"""From raw documents to token files in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet and reads back as the next stage's ``docs``.

All stages take rows with nulls in any column, empty and very long texts, repeated and
null ids, empty tables and extra columns of any name; what becomes of each is stated at
the operator that the stage calls. Documents without text and documents without an id are
clean; the mix takes no words from the former.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderloom.llm.common import table, written
from orderloom.llm.decontam import decontaminate
from orderloom.llm.mixing import mixed_documents
from orderloom.llm.neardup import drop_near_copies
from orderloom.llm.tokens import token_output
from orderloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity classifier rejects."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least document of each group of near copies (five-word shingles)."""
    return drop_near_copies(docs, words=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each copy of a document that the mix takes."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what they hold of each document."""
    return token_output(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: A trained classifier, seeded permutations and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
