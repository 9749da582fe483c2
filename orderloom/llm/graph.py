"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import drop_written, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(node, root): each node of ``edges`` (u, v) with the least node that it reaches.

    Every round rewires edges towards least neighbours; each is written out, so the
    plan stays short and a lost executor repeats one round. Rounds grow with the
    logarithm of the longest path. ``parts``: tasks that a round's result is made by.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges", parts=parts)
    stamp = _stamp(now)
    while True:
        both = _both(now)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = written(large, "large-star", parts=parts)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, "small-star", parts=parts)
        fresh = _stamp(after)
        drop_written(large, now)
        now = after
        if fresh == stamp:
            break
        stamp = fresh
    # a star: every node but the roots has one edge, to its root
    leaves = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
