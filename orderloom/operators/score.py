"""Scoring predictions against expectations (ids E1-E25)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.jsontext import json_text
from orderloom.functions.text import eval_text, export_text, let, score_text
from orderloom.operators.order import percentiles_by

# The scored fields and the paths of their public form.
FIELDS = {
    "name": "recipient_name", "phone": "phone_number", "note": "note", "address.province": "address_info.sub_region",
    "address.ward": "address_info.municipality", "address.street": "address_info.street", "address.house_number": "address_info.address_number",
}


def _has(df: DataFrame, path: str) -> bool:
    kind = df.schema
    for part in path.split("."):
        if not hasattr(kind, "names") or part not in kind.names:
            return False
        kind = kind[part].dataType
    return True


def field_value(df: DataFrame, side: str, path: str) -> Column:
    """Side.path, else the alias; a path that the schema lacks is null."""
    found = [F.col(f"{side}.{p}").cast("string") for p in (path, FIELDS.get(path, path)) if _has(df, f"{side}.{p}")]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def to_fields(preds: DataFrame) -> DataFrame:
    """(run, id, category, ok, field, expected, predicted), one row for each field."""
    cells = F.array(*[
        F.struct(F.lit(f).alias("field"), field_value(preds, "expected", f).alias("expected"), field_value(preds, "prediction", f).alias("predicted")) for f in FIELDS
    ])
    return preds.select("run", "id", "category", "ok", F.explode(cells).alias("c")).select("run", "id", "category", "ok", "c.*")


def json_fields(preds: DataFrame) -> DataFrame:
    """E2 where ``expected`` and ``prediction`` are JSON text of either shape, row by row: as to_fields.

    Each text is parsed once, to a variant; a field is looked up by its path, then by its
    alias. Text that is no JSON has no fields; numbers and booleans are read as text.
    """
    parsed = preds.select("run", "id", "category", "ok", *[F.try_parse_json(c).alias(c) for c in ("expected", "prediction")])

    def value(side: str, field: str) -> Column:
        return F.coalesce(*[F.try_variant_get(F.col(side), f"$.{p}", "string") for p in (field, FIELDS[field])])

    cells = F.array(*[F.struct(F.lit(f).alias("field"), value("expected", f).alias("expected"), value("prediction", f).alias("predicted")) for f in FIELDS])
    return parsed.select("run", "id", "category", "ok", F.explode(cells).alias("c")).select("run", "id", "category", "ok", "c.*")


def _unlike(e: Column, p: Column) -> tuple[Column, Column]:
    """Both sides where they differ as written, else nulls: equal texts need no normalising to be compared."""
    e, p = e.cast("string"), p.cast("string")
    differ = ~e.eqNullSafe(p)
    return F.when(differ, e), F.when(differ, p)


def _some(c: Column) -> Column:
    """Whether a text has other than white space; most show it by their first sign."""
    return F.when(F.substring(c, 1, 1).between("!", "~"), True).otherwise(F.coalesce(c.rlike(r"(?U)\S"), F.lit(False)))


def exact(e: Column, p: Column) -> Column:
    """Equal in the scorer's form."""
    e, p = _unlike(e, p)
    return score_text(e) == score_text(p)


def confusion(df: DataFrame, *by: str) -> DataFrame:
    """Exact, tp, fp, fn and total of each group; a mismatch can be both fp and fn."""
    # cells are counted by what they say before they are normalised: sides that are equal as written need not be told
    # apart, so that most cells fall together, and only distinct pairs of others are normalised and compared;
    # a side is empty in the scorer's form if it has nothing but white space, which normalising neither makes nor takes
    sides = df.select(*by, *[c.alias(n) for c, n in zip(_unlike(F.col("expected"), F.col("predicted")), ("e", "p"), strict=True)], *[
        _some(F.col(c).cast("string")).alias(n) for c, n in (("expected", "some_e"), ("predicted", "some_p"))
    ])
    pairs = sides.groupBy(*by, "e", "p", "some_e", "some_p").agg(F.count(F.lit(1)).alias("times")).withColumns({n: score_text(F.col(n)) for n in ("e", "p")})
    same, e, p, times = F.col("e") == F.col("p"), F.col("some_e"), F.col("some_p"), F.col("times")

    def count(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(c, times).otherwise(0)), F.lit(0))

    f1 = F.when(same, 1.0).otherwise(_word_f1(F.col("e"), F.col("p")))
    return pairs.groupBy(*by).agg(
        count(same).alias("exact_count"), count(same & e).alias("tp"), count(~same & p).alias("fp"), count(~same & e).alias("fn"),
        F.coalesce(F.sum(times), F.lit(0)).alias("total"), (F.sum(f1 * times) / F.sum(times)).alias("token_f1_avg"),
    )


def _rate(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> Column:
    """E5: struct (precision, recall, f1), 0 where nothing counts."""
    p, r = _rate(tp, tp + fp), _rate(tp, tp + fn)
    return F.struct(p.alias("precision"), r.alias("recall"), _rate(2 * p * r, p + r).alias("f1"))


def _numbered(text: Column) -> Column:
    """The words of a text, each followed by how often it has occurred before: a multiset as a set."""
    words = F.array_sort(F.filter(F.split(text, " "), lambda t: t != ""))
    return let(words, lambda ws: F.transform(ws, lambda w, i: F.concat(w, F.lit(" "), (i + 1 - F.array_position(ws, w)).cast("string"))))


def _word_f1(e: Column, p: Column) -> Column:
    def f1(s: Column) -> Column:
        return 2.0 * F.size(F.array_intersect(s["e"], s["p"])) / (F.size(s["e"]) + F.size(s["p"]))

    return F.when((e == "") & (p == ""), 1.0).when((e == "") | (p == ""), 0.0).otherwise(let(F.struct(_numbered(e).alias("e"), _numbered(p).alias("p")), f1))


def token_f1(e: Column, p: Column) -> Column:
    """F1 of token multisets; both empty 1, one empty 0."""
    return let(F.struct(score_text(e).alias("e"), score_text(p).alias("p")), lambda s: _word_f1(s["e"], s["p"]))


def field_metrics(preds: DataFrame) -> DataFrame:
    """Per run and field: accuracy, precision, recall, f1, mean token f1, counts."""
    c = confusion(to_fields(preds.filter("ok")), "run", "field")
    m = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select(
        "run", "field", F.round(F.col("exact_count") / F.col("total"), 4).alias("exact_accuracy"), F.round(m["precision"], 4).alias("precision"),
        F.round(m["recall"], 4).alias("recall"), F.round(m["f1"], 4).alias("f1"), F.round("token_f1_avg", 4).alias("token_f1_avg"), "exact_count", "total",
    )


def exact_rows(preds: DataFrame, *keep: str) -> DataFrame:
    """(run, ok, *keep, same): whether all fields of a row are equal in the scorer's form."""
    same = [exact(field_value(preds, "expected", f), field_value(preds, "prediction", f)) for f in FIELDS]
    # through an array, as one method with all comparisons and the counts would be too long to be compiled
    return preds.select("run", "ok", *keep, F.forall(F.array(*same), lambda s: s).alias("same"))


def count_exact(rows: DataFrame) -> DataFrame:
    """Per run the successful rows of exact_rows that are the same; zeros for a run without any."""
    done = rows.groupBy("run").agg(F.count_if(F.col("ok") & F.col("same")).alias("exact_count"), F.count_if("ok").alias("total"))
    return done.withColumn("accuracy", F.round(_rate(F.col("exact_count"), F.col("total")), 4))


def full_exact(preds: DataFrame) -> DataFrame:
    """Per run the successful rows of which all fields are equal; zeros for a run without any."""
    return count_exact(exact_rows(preds))


def percentiles(preds: DataFrame, pcts: tuple[float, ...] = (50.0, 95.0, 99.0)) -> DataFrame:
    """Per run exact latency percentiles by linear interpolation, over successful rows."""
    return percentiles_by(preds.filter("ok"), "run", "latency_seconds", "id", pcts)


def latency_summary(preds: DataFrame) -> DataFrame:
    """Per run over successful rows: mean, p50, p95, p99, min, max; zeros for a run without any."""
    x = F.when(F.col("ok"), F.col("latency_seconds"))
    s = preds.groupBy("run").agg(F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))
    p = percentiles(preds).withColumnRenamed("run", "of")  # a row a run
    both = s.join(p.hint("merge"), F.col("run").eqNullSafe(F.col("of")), "left")
    return both.select("run", *[F.round(F.coalesce(n, F.lit(0.0)), 4).alias(n) for n in ("mean", "p50", "p95", "p99", "min", "max")])


def throughput(preds: DataFrame, wall_seconds: float | None = None) -> DataFrame:
    """Per run orders a minute by summed latency, and by wall time where it is given; zeros for a run without a success."""
    ok = preds.groupBy("run").agg(F.count_if("ok").alias("n"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("latency_seconds"))), F.lit(0.0)).alias("s"))
    wall = F.lit(None).cast("double") if wall_seconds is None else F.round(F.col("n") / F.lit(wall_seconds) * 60, 4)
    return ok.select("run", F.round(_rate(F.col("n") * 60, F.col("s")), 4).alias("orders_per_minute"), wall.alias("orders_per_minute_wall"))


def run_summary(preds: DataFrame) -> DataFrame:
    """Per run total, successful, failed."""
    return preds.groupBy("run").agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("successful"), F.count_if(~F.col("ok")).alias("failed"))


def json_valid_rate(df: DataFrame, parsed: str = "parsed") -> DataFrame:
    """Share of replies that could be read."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count(parsed).alias("valid"), F.round(F.count(parsed) / F.count(F.lit(1)), 4).alias("json_valid_rate"))


def null_outcomes(fields: DataFrame) -> DataFrame:
    """Per field (columns field, expected, predicted): exact, hallucinated (nothing
    expected), missed (nothing predicted); null-aware on the evaluation's form (T6)."""
    e, p = eval_text(F.col("expected")), eval_text(F.col("predicted"))
    return fields.groupBy("field").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(e.eqNullSafe(p)).alias("exact"), F.count_if(e.isNull() & p.isNotNull()).alias("hallucinated"),
        F.count_if(e.isNotNull() & p.isNull()).alias("missed"),
    ).withColumn("accuracy", F.round(F.col("exact") / F.col("total"), 4))


# The fields of the null-aware evaluation, in the public form.
EVAL_FIELDS = (
    "recipient_name", "phone_number", "note", "address_raw", "address_info.address_number", "address_info.street", "address_info.neighborhood",
    "address_info.municipality", "address_info.sub_region", "address_info.country",
)


def to_eval_fields(df: DataFrame, truth: str = "response", prediction: str = "prediction") -> DataFrame:
    """(field, expected, predicted) of all ten fields; rows without a prediction at all,
    whose reply could not be read, are not scored."""
    cells = F.array(*[
        F.struct(F.lit(f).alias("field"), field_value(df, truth, f).alias("expected"), field_value(df, prediction, f).alias("predicted")) for f in EVAL_FIELDS
    ])
    return df.filter(F.col(prediction).isNotNull()).select(F.explode(cells).alias("c")).select("c.*")


def micro_average(outcomes: DataFrame) -> DataFrame:
    """All fields together."""
    return outcomes.agg(F.sum("exact").alias("exact"), F.sum("total").alias("total"), F.round(F.sum("exact") / F.sum("total"), 4).alias("accuracy"))


def invalid_sample(df: DataFrame, parsed: str = "parsed", order: str = "id", n: int = 5) -> DataFrame:
    """The first n replies that could not be read."""
    return df.filter(F.col(parsed).isNull()).orderBy(order).limit(n)


def error_rows(preds: DataFrame) -> DataFrame:
    """One row for each wrong field, with both sides as JSON sorted by key."""
    cells = to_fields(preds).filter(export_text(F.col("expected")) != export_text(F.col("predicted"))).drop("category", "ok")
    sides = preds.select(
        "run", "id", "category", F.round("latency_seconds", 4).alias("latency_seconds"), "input",
        canonical_json(preds, "expected").alias("expected_all"), canonical_json(preds, "prediction").alias("prediction_all"),
    )
    return cells.join(sides.hint("merge"), ["run", "id"])  # cells come from explode: no estimate


def canonical_json(df: DataFrame, column: str) -> Column:
    """JSON of a column with keys sorted at every level, also in arrays and maps, and nulls kept."""
    return json_text(F.col(column), df.schema[column].dataType, ordered=True)


def mismatch_count(preds: DataFrame) -> DataFrame:
    """Per run the rows with any wrong field, none included."""
    cells = [export_text(field_value(preds, "expected", f)) != export_text(field_value(preds, "prediction", f)) for f in FIELDS]
    return preds.groupBy("run").agg(F.count_if(functools.reduce(Column.__or__, cells)).alias("mismatches"))


def examples(preds: DataFrame, rows: int = 6, fields: int = 4) -> DataFrame:
    """Per run the first bad rows and of each its first wrong fields."""
    wrong = to_fields(preds).filter(export_text(F.col("expected")) != export_text(F.col("predicted")))
    number = F.lit(0)
    for i, f in enumerate(FIELDS):
        number = F.when(F.col("field") == f, i).otherwise(number)
    # the filter on this rank alone lets each task keep its own first rows before any of a run meet
    ranked = wrong.withColumn("row_rank", F.dense_rank().over(Window.partitionBy("run").orderBy("id"))).filter(F.col("row_rank") <= rows)
    ranked = ranked.withColumn("field_no", number).withColumn("field_rank", F.row_number().over(Window.partitionBy("run", "id").orderBy("field_no")))
    return ranked.filter(F.col("field_rank") <= fields).drop("field_no", "category", "ok")


def compare_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both runs by id (the last of a repeated id on the right) and the share of equal
    predictions, compared as JSON with sorted keys; two missing ones are equal."""
    sides = [df.withColumn("said", canonical_json(df, "prediction")) for df in (left, right)]
    r = sides[1].groupBy("id").agg(F.max_by("said", "seq").alias("other"))
    both = sides[0].select("id", "said").hint("merge").join(r, "id")
    same = F.col("said").eqNullSafe(F.col("other"))
    out = both.agg(F.count(F.lit(1)).alias("shared"), F.count_if(same).alias("same"))
    return out.withColumn("same_ratio", F.round(_rate(F.col("same"), F.col("shared")), 4))


def suspicious(df: DataFrame, limit: float = 0.98) -> DataFrame:
    """Flags comparisons in which nearly all predictions are equal."""
    return df.withColumn("suspicious", F.col("same_ratio") > limit)


def best_runs(summary: DataFrame) -> DataFrame:
    """The run of least p95 and the run of most full exact matches (columns run, p95, accuracy)."""
    return summary.agg(F.min_by("run", F.struct("p95", "run")).alias("fastest"), F.max_by("run", F.struct("accuracy", "run")).alias("most_exact"))


def gains(summary: DataFrame, a: str, b: str) -> DataFrame:
    """Of run b against a: relative change of p95, absolute change of accuracy."""
    both = summary.filter(F.col("run").isin(a, b)).agg(*[
        F.max(F.when(F.col("run") == r, F.col(c))).alias(f"{c}_{i}") for i, r in ((0, a), (1, b)) for c in ("p95", "accuracy")
    ])
    p95, accuracy = (F.col("p95_0") - F.col("p95_1")) / F.col("p95_0"), F.col("accuracy_1") - F.col("accuracy_0")
    return both.select(F.round(p95, 4).alias("p95_gain"), F.round(accuracy, 4).alias("accuracy_gain"))


def field_by_run(metrics: DataFrame, runs: list[str]) -> DataFrame:
    """Accuracy of each field in each of the named runs."""
    return metrics.groupBy("field").pivot("run", runs).agg(F.first("exact_accuracy"))


def take(df: DataFrame, limit: int, skip: int = 0, order: str = "id") -> DataFrame:
    """Rows skip .. limit in order."""
    return df.orderBy(order).limit(limit).offset(skip) if skip else df.orderBy(order).limit(limit)
