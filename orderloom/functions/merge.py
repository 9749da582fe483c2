"""Merge and repair of rule output and model output (ids R1-R8), native Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.text import recipient_name

# Words that mark alleys and streets, and words of district level.
WAYS = r"\b(ngõ|ngo|ngách|ngach|hẻm|hem|kiệt|kiet|đường|duong|phố|pho)\b"
DISTRICT_WORDS = r"\b(quận|quan|huyện|huyen|thị xã|thi xa|thành phố|thanh pho|tp\.?)\b"
LEADING_NUMBER = r"^\s*(?:số\s*)?([0-9]+[a-zA-Z]?(?:/[0-9]+[a-zA-Z]?)?)\s+(.+)$"
LABELLED_NUMBER = r"^\s*(sn|số|so)\b"
FIELDS = ("province", "district_hint", "ward", "street", "house_number")


def _some(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _bare(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")), F.lit(" ,"))


def merge_hints(addr: Column, hints: Column) -> Column:
    """R2: rule hints into the model's address. Weak districts and wards (shorter than
    four letters, with a comma, or of district words) give way; the longer street wins;
    a labelled or street-like house number gives way."""

    def weak(c: Column) -> Column:
        return (F.length(F.trim(c)) < 4) | c.contains(",") | c.rlike(f"(?iU){DISTRICT_WORDS}")

    out = {"province": F.when(_some(addr["province"]), addr["province"]).otherwise(hints["province"])}
    for f in ("district_hint", "ward"):
        out[f] = F.when(_some(hints[f]) & (~_some(addr[f]) | weak(addr[f])), hints[f]).otherwise(addr[f])
    longer = _some(hints["street"]) & (~_some(addr["street"]) | (F.length(hints["street"]) > F.length(addr["street"])))
    out["street"] = F.when(longer, hints["street"]).otherwise(addr["street"])
    number = addr["house_number"]
    loose = ~_some(number) | number.rlike(f"(?iU){LABELLED_NUMBER}") | number.rlike(f"(?iU){WAYS}")
    out["house_number"] = F.when(_some(hints["house_number"]) & loose, hints["house_number"]).otherwise(number)
    return F.struct(*[out[f].alias(f) for f in FIELDS])


def join_street(a: Column, b: Column) -> Column:
    """Both parts, or the longer one where one contains the other; null for none."""
    x, y = _bare(a), _bare(b)
    low_x, low_y = F.lower(x), F.lower(y)
    inside = low_x.contains(low_y) | low_y.contains(low_x)
    both = F.when(inside, F.when(F.length(y) > F.length(x), y).otherwise(x)).otherwise(F.concat(x, F.lit(" "), y))
    return F.nullif(F.when(x == "", y).when(y == "", x).otherwise(both), F.lit(""))


def format_address(*parts: Column) -> Column:
    """Non-empty parts once each (case aside), joined by a comma; null for none."""
    bare = F.filter(F.array(*[_bare(p) for p in parts]), lambda p: p != "")
    once = F.aggregate(
        bare, F.array().cast("array<string>"),
        lambda acc, p: F.when(F.exists(acc, lambda have: F.lower(have) == F.lower(p)), acc).otherwise(F.concat(acc, F.array(p))),
    )
    return F.nullif(F.array_join(once, ", "), F.lit(""))


def fix_address_parts(addr: Column) -> Column:
    """A street inside the house number moves to the street; a number before the street moves out of it."""
    number, street = addr["house_number"], addr["street"]
    pattern = f"(?isU){LEADING_NUMBER}"
    rest = F.regexp_extract(number, pattern, 2)
    splits = _some(number) & number.rlike(pattern) & rest.rlike(f"(?iU){WAYS}")
    number1 = F.when(splits, F.regexp_extract(number, pattern, 1)).otherwise(number)
    street1 = F.when(splits, join_street(rest, street)).otherwise(street)
    leads = ~_some(number1) & _some(street1) & street1.rlike(pattern)
    number2 = F.when(leads, F.regexp_extract(street1, pattern, 1)).otherwise(number1)
    street2 = F.when(leads, F.trim(F.regexp_extract(street1, pattern, 2), F.lit(" ,"))).otherwise(street1)
    kept = [addr[f].alias(f) for f in FIELDS[:3]]
    return F.struct(*kept, street2.alias("street"), number2.alias("house_number"))


def apply_precedence(df: DataFrame) -> DataFrame:
    """From ``rule`` (phone, name, note) and ``model`` (order struct): the rule's phone
    and note first, the model's name first. Adds phone, name, note."""
    m, r = F.col("model"), F.col("rule")
    return df.withColumns({
        "phone": F.coalesce(r["phone"], m["phone"]),
        "name": F.coalesce(F.nullif(m["name"], F.lit("")), r["name"]),
        "note": F.coalesce(r["note"], m["note"]),
    })


def trust_resolved(df: DataFrame) -> DataFrame:
    """Ward and province of ``resolved`` only where it is normalised, else the raw
    ones of ``address``; the district stands in for a missing ward."""
    a, n = F.col("address"), F.col("resolved")
    sure = F.coalesce(n["is_normalized"], F.lit(False))
    return df.withColumns({
        "address_number": F.coalesce(F.nullif(n["house_number"], F.lit("")), a["house_number"]),
        "street": F.coalesce(F.nullif(n["street"], F.lit("")), a["street"]),
        "municipality": F.coalesce(F.when(sure, n["ward"]), a["ward"], a["district_hint"]),
        "sub_region": F.coalesce(F.when(sure, n["province"]), a["province"]),
    })


def repair_region(df: DataFrame) -> DataFrame:
    """With ``inferred_region`` (of sub_region) and ``inferred_municipality`` (of
    municipality): a region that is a municipality moves down, a missing one is filled."""
    region, place = F.col("sub_region"), F.col("municipality")
    moves = region.isNotNull() & place.isNull() & F.col("inferred_region").isNotNull() & (F.lower("inferred_region") != F.lower(region))
    return df.withColumn("__moves", moves).withColumns({
        "municipality": F.when(F.col("__moves"), region).otherwise(place),
        "sub_region": F.when(F.col("__moves"), F.col("inferred_region")).otherwise(F.coalesce(region, F.when(place.isNotNull(), F.col("inferred_municipality")))),
    }).drop("__moves")


def project_order(df: DataFrame) -> DataFrame:
    """The final row; country is VNM once any address part is known."""
    new = format_address(join_street(F.col("address_number"), F.col("street")), F.col("municipality"), F.col("sub_region"))
    known = F.coalesce("address_raw", "address_number", "street", "municipality", "sub_region").isNotNull()
    info = F.struct("address_number", "street", "municipality", "sub_region", F.when(known, F.lit("VNM")).alias("country"))
    return df.select(
        "msg_id", recipient_name(F.col("name")).alias("recipient_name"), F.col("phone").alias("phone_number"), "note", "address_raw",
        new.alias("address_new"), info.alias("address_info"),
    )
