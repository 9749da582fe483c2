"""Scans and sinks (ids S1-S11)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orderloom.functions.jsontext import row_text
from orderloom.functions.text import place_name

ADMIN = (
    "province_code string, province_name string, wards array<struct<ward_code:string,ward_name:string,is_merged:boolean,merged_from_raw:string,"
    "merged_from:array<struct<old_ward_name:string,old_district_name:string,old_province_name:string>>>>"
)
#: Files of a run at most.
FILES_PER_RUN = 32
UNIT = "ma string, magoc string, ten string, malk string, truocsapnhap string"


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One object a line, blank lines skipped, unreadable lines kept in _corrupt_record."""
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_admin_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The nested administrative table, one JSON array; ``lines``: a province a line, as write_admin_json has it."""
    return spark.read.schema(ADMIN).option("multiLine", not lines).json(path)


def read_code_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """S3: one object keyed by code, as rows (code, value fields, ord) in file order."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.map_entries(F.from_json("value", f"map<string,struct<{value}>>"))).alias("ord", "e"))
    return rows.select(F.col("e.key").alias("code"), "e.value.*", "ord")


def read_merger_map(spark: SparkSession, path: str) -> DataFrame:
    """(province_code, old_province_key) from code -> list of old provinces."""
    text = spark.read.text(path, wholetext=True)
    lists = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("province_code", "names"))
    names = lists.select("province_code", F.explode("names").alias("name"))
    return names.select("province_code", place_name(F.col("name")).alias("old_province_key"))


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """The flat list of units, already fetched."""
    return spark.read.schema(UNIT).option("multiLine", True).json(path)


def split_province_reply(df: DataFrame, column: str) -> DataFrame:
    """``{province}.synt.[wards]`` as columns province and wards; bad parts are null and an empty array."""
    parts = F.split(F.col(column), r"\.synt\.")
    whole = F.size(parts) == 2
    wards = F.from_json(F.when(whole, parts[1]), f"array<struct<{', '.join(f.replace(' ', ':') for f in UNIT.split(', '))}>>")
    province = F.from_json(F.when(whole & F.get_json_object(parts[0], "$").isNotNull(), parts[0]), UNIT)
    return df.withColumns({"province": province, "wards": F.coalesce(wards, F.array().cast(f"array<struct<{', '.join(f.replace(' ', ':') for f in UNIT.split(', '))}>>"))})


def discover_runs(spark: SparkSession, root: str, include: tuple[str, ...] = (), latest: int | None = None) -> DataFrame:
    """Pairs of files ``x_summary.json`` and ``x_predictions.jsonl`` one folder below ``root``.

    Returns folder, run (x), summary, predictions (paths), modified and recency (1: the newest,
    of equal times the last path). Left out are runs with a path component ``smoke``, and with
    ``include`` those whose path holds none of its tokens, as they are written. With
    ``latest`` the newest so many. Only names and times of files are read.
    """

    def files(suffix: str, name: str) -> DataFrame:
        found = spark.read.format("binaryFile").load(f"{root}/*/*{suffix}").select("path", "modificationTime")
        stem = rf"([^/]+)/([^/]+)\Q{suffix}\E$"
        return found.select(
            F.regexp_extract("path", stem, 1).alias("folder"), F.regexp_extract("path", stem, 2).alias("run"), F.col("path").alias(name), F.col("modificationTime").alias(f"{name}_time")
        )

    runs = files("_summary.json", "summary").withColumnRenamed("summary_time", "modified").join(files("_predictions.jsonl", "predictions").drop("predictions_time"), ["folder", "run"])
    runs = runs.filter(~F.array_contains(F.split("summary", "/"), "smoke"))
    if include:
        runs = runs.filter(functools.reduce(Column.__or__, [F.col("summary").contains(token) for token in include]))
    runs = runs.withColumn("recency", F.row_number().over(Window.orderBy(F.desc("modified"), F.desc("summary"))))  # a row a run
    return runs.filter(F.col("recency") <= latest) if latest and latest > 0 else runs


def write_jsonl(df: DataFrame, path: str, compact: bool = True) -> None:
    """One object a line, nulls written; spaced puts a blank after : and , between members, at every level."""
    if compact:
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    else:
        df.select(row_text(df.schema).alias("value")).write.mode("overwrite").text(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row summary as one JSON object."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_errors(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Error rows, a folder for each run; a run of many rows has several files there."""
    dealt = df.repartition("run", F.pmod(F.xxhash64("id"), F.lit(FILES_PER_RUN)))
    dealt.write.mode("overwrite").partitionBy("run").format(fmt).save(path)


def nest_admin(wards: DataFrame) -> DataFrame:
    """The nested table from ward rows (province_code, province_name, ward fields, merged_from, pos)."""
    ward = F.struct("pos", "ward_code", "ward_name", "is_merged", "merged_from_raw", "merged_from")
    grouped = wards.groupBy("province_code", "province_name").agg(F.sort_array(F.collect_list(ward)).alias("w"))  # wards of a province: some hundreds

    def bare(w: Column) -> Column:
        return F.struct(*[w[f].alias(f) for f in ("ward_code", "ward_name", "is_merged", "merged_from_raw", "merged_from")])

    return grouped.select("province_code", "province_name", F.transform("w", bare).alias("wards"))


def write_admin_json(wards: DataFrame, path: str) -> None:
    """The nested administrative table as JSON."""
    nest_admin(wards).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
