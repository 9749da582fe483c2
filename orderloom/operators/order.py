"""Numbering and selection by rank that no single task carries."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.sources.staging import staged

#: Rows of a small table of partitions or groups up to which it is broadcast.
SMALL = 200_000


def hinted(df: DataFrame, rows: int) -> DataFrame:
    return df.hint("broadcast" if rows <= SMALL else "merge")


def numbered(df: DataFrame, *order: Column | str, by: str | None = None, out: str = "no") -> DataFrame:
    """``df`` with its rows numbered from 0 in the ascending order of ``order``, for each value of ``by`` apart.

    Rows are dealt out by ranges of (by, order) and sorted within them; a row's number is its
    place in its range plus the rows of the ranges before, which are counted: a table of a
    row for each range. However many rows one value of ``by`` has, they are spread over many
    ranges; give an order without ties, which ranges cannot part. Null values of
    ``by`` are numbered together; an empty table gives no rows.
    """
    keys = [F.col(by), *order] if by else list(order)
    named = {f"__o{i}": F.col(k) if isinstance(k, str) else k for i, k in enumerate(keys)}
    dealt = df.withColumns(named).repartitionByRange(*named).sortWithinPartitions(*named).drop(*named)
    rows = staged(dealt.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    per = rows.groupBy(F.shiftright("__id", 33).alias("__part")).agg(F.count(F.lit(1)).alias("n")).collect()  # a number a range
    starts, before = {}, 0
    for r in sorted(per, key=lambda r: r["__part"]):
        starts[r["__part"]], before = before, before + r["n"]
    if not starts:
        return rows.withColumn(out, F.col("__id")).drop("__id")
    begins = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]) if len(starts) <= 1000 else None
    part = F.shiftright("__id", 33)
    if begins is None:
        spark = df.sparkSession
        table = spark.createDataFrame(list(starts.items()), "__part long, __begin long")
        rows = rows.withColumn("__part", part).join(hinted(table, len(starts)), "__part").withColumn("__at", F.col("__begin") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__part", "__begin")
    else:
        rows = rows.withColumn("__at", F.element_at(begins, part) + F.col("__id").bitwiseAND((1 << 33) - 1))
    if by is None:
        return rows.withColumn(out, F.col("__at")).drop("__id", "__at")
    first = staged(rows.groupBy(F.col(by).alias("__by")).agg(F.min("__at").alias("__first")), "group-starts")
    rows = rows.join(hinted(first, first.count()), F.col(by).eqNullSafe(F.col("__by")))
    return rows.withColumn(out, F.col("__at") - F.col("__first")).drop("__id", "__at", "__first", "__by")


def percentiles_by(df: DataFrame, by: str, value: str, key: str, pcts: tuple[float, ...] = (50.0, 95.0, 99.0)) -> DataFrame:
    """(by, p50, ...): exact percentiles of ``value`` by linear interpolation between the two
    nearest ranks, for each ``by``; ``key`` parts equal values. Nulls are left out.

    Rows are numbered in order and those of the ranks that count are selected, so no
    group of rows meets in one task.
    """
    known = df.select(by, F.col(value).cast("double").alias(value), key).filter(F.col(value).isNotNull())
    rows = numbered(known, value, key, by=by, out="__no")
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    place = {p: (F.col("__n") - 1) * F.lit(p / 100) for p in pcts}
    low = F.array(*[F.floor(x).cast("long") for x in place.values()])
    high = F.array(*[F.ceil(x).cast("long") for x in place.values()])
    wanted = sizes.select(F.col(by).alias("__by"), "__n", F.explode(F.array_distinct(F.concat(low, high))).alias("__rank"))
    met = rows.join(wanted.hint("broadcast" if sizes.count() * 2 * len(pcts) <= SMALL else "merge"), F.col(by).eqNullSafe(F.col("__by")) & (F.col("__no") == F.col("__rank")))
    at = met.groupBy(by, "__n").agg(F.map_from_entries(F.collect_list(F.struct("__rank", value))).alias("__at"))  # two ranks a percentile

    def between(p: float) -> Column:
        a, b = F.floor(place[p]).cast("long"), F.ceil(place[p]).cast("long")
        lo, hi = F.element_at("__at", a), F.element_at("__at", b)
        return lo + (hi - lo) * (place[p] - a)

    return at.select(by, *[between(p).alias(f"p{p:g}") for p in pcts])


def greedy_fill(groups: DataFrame, goal: int, order: str = "k", size: str = "n", bucket: str = "bucket") -> Column:
    """Condition on (order, size): which groups, taken in order, still fit into ``goal`` rows.

    A group that does not fit is skipped and later ones are tried. ``groups`` is a written
    table of distinct ``order`` values with their sizes, dealt into buckets that follow the order.
    Each round sums the groups that could still fit by bucket (a bounded number of sums), finds
    the bucket and in it the group at which they no longer do, and goes on behind that one
    with the room that is left; so what is taken follows from a few numbers.
    """
    taken, room, behind = [], goal, None
    while room > 0:
        open_ = F.col(size) <= room
        if behind is not None:
            open_ = open_ & (F.col(order) > F.lit(behind))
        fitting = groups.filter(open_)
        sums = sorted((r[0], r[1]) for r in fitting.groupBy(bucket).agg(F.sum(size)).collect())
        before, full = 0, None
        for b, n in sums:
            if before + n > room:
                full = b
                break
            before += n
        if full is None:
            taken.append(open_)
            break
        inner = fitting.filter(F.col(bucket) == F.lit(full)).select(order, size)
        running = inner.withColumn("__upto", F.sum(size).over(Window.partitionBy(F.lit(full)).orderBy(order)) + before)  # one bucket
        stop = running.filter(F.col("__upto") > room).agg(F.min(order)).first()[0]
        taken.append(open_ & (F.col(order) < F.lit(stop)))
        used = running.filter(F.col(order) < F.lit(stop)).agg(F.coalesce(F.max("__upto"), F.lit(before))).first()[0]
        room, behind = room - used, stop
    return functools.reduce(Column.__or__, taken, F.lit(False))
