"""Exact dedup by skew-safe combining (native DataFrame operations only).

Texts are deduplicated where they are read, merged within salted digest groups,
and the winners of the salts are combined globally. Every grouping has the whole
text among its keys, so equality is always of content; the digest only spreads
and shortens the work. No group is ever collected: a text that fills a third of
the table reaches the shuffle as at most one row per task and salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm.common import columns, table, written

SALTS = 16


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def exact_groups(docs: DataFrame, salts: int = SALTS, digest=sha256) -> DataFrame:
    """One row per distinct text: digest, text, keep_id (largest id), group_size.

    A null text counts as empty. Ids that are null lose to any other.
    """
    rows = columns(docs, "doc_id", "text").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text")
    ).withColumns({"digest": digest(F.col("text")), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(salts))})
    # the partial aggregate of this step is the local dedup
    salted = rows.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, salts: int = SALTS, digest=sha256) -> DataFrame:
    """Each document with its group's winner.

    Returns doc_id, keep_id, group_size, kept, text_sha256: one row for each row
    of ``docs``, dropped ones too. Of equal texts the largest doc_id stays. Null
    text equals empty text; rows that repeat a doc_id each count in group_size and
    share its ``kept``; a row without an id goes if its text has a row with one, and
    where no row of a text has one all of them stay, as nothing tells them apart (keep_id
    is null); an empty table gives no rows; extra columns are ignored.
    ``digest`` maps the text column to the digest that spreads the groups; a weak
    one (tests use it) costs time, never correctness.
    """
    groups = exact_groups(docs, salts, digest)
    winners = written(
        groups.groupBy("digest").agg(
            F.count(F.lit(1)).alias("contents"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
        ),
        "exact-winners",
    )
    rows = columns(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns(
        {"digest": digest(F.col("text")), "text_sha256": sha256(F.col("text"))}
    )
    out = rows.drop("text").join(winners.filter("contents = 1").hint("merge"), "digest").drop("contents")
    shared = winners.filter("contents > 1").select("digest")
    if not shared.isEmpty():  # a digest with two contents: those rows are told apart by their text
        clash = groups.join(shared.hint("merge"), "digest", "left_semi")
        out = out.unionByName(rows.join(clash.hint("merge"), ["digest", "text"]).drop("text"))
    return out.select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
