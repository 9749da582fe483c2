"""Model replies as table columns (ids M1-M4)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# A reply has the internal or the public shape; both are read with one superset schema.
REPLY = (
    "name string, phone string, note string, address_raw string, "
    "address struct<province:string,district_hint:string,ward:string,street:string,house_number:string>, "
    "recipient_name string, phone_number string, "
    "address_info struct<address_number:string,street:string,neighborhood:string,municipality:string,sub_region:string,country:string>"
)


def _parsed(text: Column) -> Column:
    whole = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(whole.rlike(r"(?s)^\{.*\}$"), F.from_json(whole, REPLY, {"mode": "PERMISSIVE"}))


def _has_keys(order: Column) -> Column:
    return F.coalesce(*[order[f.split()[0]].cast("string") for f in ("name", "phone", "note", "address_raw", "recipient_name", "phone_number", "address", "address_info")]).isNotNull()


def recover_json(c: Column) -> Column:
    """M1: struct (status, order). The whole text, else from the first { to the last }.
    status: ok, no_json (no braces) or error (not readable)."""
    text = F.coalesce(c, F.lit(""))
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    valid = F.when(F.get_json_object(braces, "$").isNotNull(), braces)
    order = F.coalesce(_parsed(F.when(F.get_json_object(text, "$").isNotNull(), text)), _parsed(valid))
    status = F.when(order.isNotNull(), F.lit("ok")).when(braces == "", F.lit("no_json")).otherwise(F.lit("error"))
    return F.struct(status.alias("status"), order.alias("order"))


def recover_json_safe(c: Column) -> Column:
    """M2: the object from the first { to the last }, null on any failure."""
    a = F.locate("{", c)
    b = F.length(c) - F.locate("}", F.reverse(c)) + 1
    body = F.when((a > 0) & (F.locate("}", c) > 0) & (b > a), F.substring(c, a, b - a + 1))
    return F.when(F.get_json_object(body, "$").isNotNull(), _parsed(body))


def reply_to_order(order: Column) -> Column:
    """M3: either shape to the internal order; [PHONE] is no phone; the municipality is
    the ward unless a neighborhood is, and then the district."""
    info = order["address_info"]
    public = order["recipient_name"].isNotNull() | info.isNotNull()
    phone = F.when(order["phone_number"] != "[PHONE]", order["phone_number"])
    address = F.struct(
        F.when(public, info["sub_region"]).otherwise(order["address"]["province"]).alias("province"),
        F.when(public, F.when(F.coalesce(info["neighborhood"], F.lit("")) != "", info["municipality"])).otherwise(order["address"]["district_hint"]).alias("district_hint"),
        F.when(public, F.coalesce(F.nullif(info["neighborhood"], F.lit("")), info["municipality"])).otherwise(order["address"]["ward"]).alias("ward"),
        F.when(public, info["street"]).otherwise(order["address"]["street"]).alias("street"),
        F.when(public, info["address_number"]).otherwise(order["address"]["house_number"]).alias("house_number"),
    )
    return F.struct(
        F.when(public, order["recipient_name"]).otherwise(order["name"]).alias("name"),
        F.when(public, phone).otherwise(order["phone"]).alias("phone"),
        order["note"].alias("note"), order["address_raw"].alias("address_raw"), address.alias("address"),
    )


def score_with(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str | StructType, parallelism: int | None = None) -> DataFrame:
    """M4: a user's batch scorer over the rows; ``parallelism`` bounds its concurrent calls."""
    return (df.repartition(parallelism) if parallelism else df).mapInPandas(fn, schema)
