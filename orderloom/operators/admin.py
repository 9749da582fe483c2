"""The administrative reference table: units, predecessors, old names (ids G1-G19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.text import collapse_ws, place_name

# Openings of text that names no unit, and of unit names.
NOISE = (
    r"m[oộ]t ph[aầ]n di[eệ]n t[íi]ch", r"m[oộ]t ph[aầ]n quy m[oô]", r"quy m[oô] d[aâ]n s[oố]", r"ph[aầ]n c[oò]n l[aạ]i", r"sau khi s[aắ]p",
    r"v[àa] ph[aầ]n", r"to[aà]n b[oộ]", r"di[eệ]n t[íi]ch tn", r"\d+", r"v[àa]\s", r"hay\s", r"ho[aặ]c\s", r"c[uù]ng",
)
SKIPPED_V1 = (
    r"m[oộ]t ph[aầ]n", r"ph[aầ]n c[oò]n l[aạ]i", r"sau khi s[aắ]p x[eế]p", r"sau khi s[aắ]p nh[aậ]p", r"to[aà]n b[oộ]", r"\d+", r"v[àa]\s", r"c[aá]c ",
)
UNIT_TYPES = r"^(Phường|Xã|Thị trấn|Thị xã|Đặc khu)\s+\S"
DESCRIPTIVE_PAREN = r"\s*\([^)]*(?:ph[aầ]n c[oò]n l[aạ]i|sau khi|tr[uướ]c khi)[^)]*\)"
WARD_PREFIX = r"^(?:xa|phuong|thi tran|thi xa|dac khu) "
SURE = ("exact", "filtered", "district_hint", "ambiguous_region", "ambiguous_district_hint")


def is_merged(c: Column) -> Column:
    """Predecessor text is there and does not say that the unit stays as it is."""
    text = F.coalesce(collapse_ws(c), F.lit(""))
    return (text != "") & ~F.lower(text).contains("giữ nguyên")


def is_noise(c: Column) -> Column:
    """Not the name of a unit: too short, no letter first, or a descriptive opening."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return (F.length(t) < 2) | ~t.rlike(r"(?U)^\p{L}") | F.lower(t).rlike(f"(?iU)^(?:{'|'.join(NOISE)})")


def is_unit_name(c: Column) -> Column:
    """A unit type first, or a capital and three letters or more."""
    t = F.trim(c)
    return ~is_noise(c) & (t.rlike(f"(?iU){UNIT_TYPES}") | ((F.length(t) >= 3) & t.rlike(r"^\p{Lu}")))


def split_paren(c: Column) -> Column:
    """(ward, district, province) of ``Xã A (huyện B, tỉnh C)``; the last part of a kind
    wins, a single part of no kind is a district."""
    inside = F.trim(F.regexp_extract(c, r"\(([^)]+)\)", 1))
    has = c.rlike(r"\([^)]+\)")
    parts = F.transform(F.split(inside, ","), lambda p: F.trim(p))
    province = F.filter(parts, lambda p: F.lower(p).rlike(r"^(?:tỉnh |thành phố|tp\.)"))
    district = F.filter(parts, lambda p: F.lower(p).rlike(r"^(?:huyện |quận |thị xã )"))
    alone = F.when((F.size(parts) == 1) & (F.size(province) == 0) & (F.size(district) == 0), parts[0])
    return F.struct(
        F.when(has, F.trim(F.regexp_extract(c, r"(?s)^(.*?)\([^)]+\)", 1))).otherwise(F.trim(c)).alias("old_ward_name"),
        F.when(has, F.coalesce(F.try_element_at(district, F.lit(-1)), alone)).alias("old_district_name"),
        F.when(has, F.try_element_at(province, F.lit(-1))).alias("old_province_name"),
    )


def _entry(w: Column, d: Column, p: Column) -> Column:
    return F.struct(w.alias("old_ward_name"), d.alias("old_district_name"), p.alias("old_province_name"))


def parse_predecessors_v1(c: Column, province: Column) -> Column:
    """All parentheses dropped, cut at , and ;, descriptive and short parts skipped."""
    text = F.regexp_replace(collapse_ws(c), r"\s*\([^)]*\)", "")
    parts = F.transform(F.split(text, "[,;]"), lambda p: F.trim(p))
    good = F.filter(parts, lambda p: (F.length(p) >= 3) & p.rlike(r"^\p{L}") & ~F.lower(p).rlike(f"(?iU)^(?:{'|'.join(SKIPPED_V1)})"))
    none = F.lit(None).cast("string")
    return F.when(is_merged(c), F.transform(good, lambda p: _entry(p, none, province))).otherwise(F.array().cast("array<struct<old_ward_name:string,old_district_name:string,old_province_name:string>>"))


def parse_predecessors(c: Column, province: Column) -> Column:
    """Descriptive parentheses dropped, cut at commas outside parentheses, a leading
    ``và`` and noise dropped, the given province where none is named."""
    text = F.regexp_replace(F.trim(c), f"(?iU){DESCRIPTIVE_PAREN}", "")
    parts = F.transform(F.split(text, r",\s*(?![^()]*\))"), lambda p: F.trim(F.regexp_replace(F.trim(p), r"(?iU)^v[àa]\s+", "")))
    units = F.transform(F.filter(parts, lambda p: ~is_noise(p)), split_paren)
    units = F.filter(units, lambda u: ~is_noise(u["old_ward_name"]))
    full = F.transform(units, lambda u: _entry(u["old_ward_name"], u["old_district_name"], F.coalesce(u["old_province_name"], province)))
    return F.when(is_merged(c), full).otherwise(F.array().cast("array<struct<old_ward_name:string,old_district_name:string,old_province_name:string>>"))


def assemble_units(units: DataFrame, details: DataFrame) -> DataFrame:
    """G1: provinces (magoc 0) with their wards; a province's detail wards where it has
    any, else its rows of the unit list. Columns: ma, magoc, ten, truocsapnhap."""
    provinces = units.filter("magoc = '0'").select(F.col("ma").alias("province_code"), F.col("ten").alias("province_name"))
    cols = ("ma", "magoc", "ten", "truocsapnhap")
    detailed = details.select("magoc").distinct()
    plain = units.filter("magoc <> '0'").join(detailed, "magoc", "left_anti").select(*cols)
    wards = details.select(*cols).unionByName(plain)
    out = wards.join(provinces, wards["magoc"] == provinces["province_code"])
    order = Window.partitionBy("province_code").orderBy("ten", "ma")
    return out.select(
        "province_code", "province_name", F.col("ma").alias("ward_code"), F.col("ten").alias("ward_name"),
        is_merged(F.col("truocsapnhap")).alias("is_merged"), collapse_ws(F.col("truocsapnhap")).alias("merged_from_raw"),
        (F.row_number().over(order) - 1).alias("pos"),
    )


def reparse(wards: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wards with merged_from parsed anew, totals, entries that look wrong)."""
    done = wards.withColumn("merged_from", parse_predecessors(F.when(F.col("is_merged"), F.col("merged_from_raw")), F.col("province_name")))
    totals = done.agg(
        F.count(F.lit(1)).alias("wards"), F.count_if("is_merged").alias("merged"), F.sum(F.size("merged_from")).alias("entries"),
        F.count_if(F.col("is_merged") & (F.size("merged_from") == 0)).alias("merged_without_entries"),
    )
    entry = done.select("province_name", "ward_name", F.explode("merged_from").alias("e")).select("province_name", "ward_name", "e.*")
    return done, totals, entry.filter(~is_unit_name(F.col("old_ward_name")))


def denormalize_old(wards: DataFrame, districts: DataFrame, provinces: DataFrame) -> DataFrame:
    """Old wards with the names of their district and province; missing parents are null.
    Columns of each: code, name, name_with_type, parent_code (not of provinces), ord (of wards)."""
    d = districts.select(F.col("code").alias("d"), F.nullif("name_with_type", F.lit("")).alias("old_district_name"), F.col("parent_code").alias("dp"))
    p = provinces.select(F.col("code").alias("p"), F.nullif("name_with_type", F.lit("")).alias("old_province_name"))
    out = wards.join(d, wards["parent_code"] == F.col("d"), "left").join(p, F.col("dp") == F.col("p"), "left")
    return out.select(F.col("code").alias("old_ward_code"), F.col("name_with_type").alias("old_ward_name"), F.col("name").alias("short_name"), "old_district_name", "old_province_name", "ord")


def name_index(old: DataFrame, kind: str) -> DataFrame:
    """Old wards by normalised ``full`` or ``short`` name, file order kept in ord."""
    name = F.col("old_ward_name" if kind == "full" else "short_name")
    return old.select(place_name(F.coalesce(name, F.lit(""))).alias("key"), "old_district_name", "old_province_name", "ord")


def split_compound(entries: DataFrame) -> DataFrame:
    """``A và B`` becomes two entries, told apart by sub."""
    parts = F.filter(F.transform(F.split("old_ward_name", r"(?iU)\s+v[àa]\s+"), lambda p: F.trim(p)), lambda p: p != "")
    return entries.select(*[c for c in entries.columns if c != "old_ward_name"], F.posexplode(parts).alias("sub", "old_ward_name"))


def lookup_candidates(entries: DataFrame, full: DataFrame, short: DataFrame) -> DataFrame:
    """Candidates by full name, else by short name without its type; entries
    (entry_id, province_code, old_ward_name, district_hint) without any keep one null row."""
    keyed = entries.withColumn("key", place_name(F.col("old_ward_name")))
    named = keyed.hint("merge").join(full, "key")
    rest = keyed.hint("merge").join(full.select("key").distinct(), "key", "left_anti").withColumn("key", F.regexp_replace("key", WARD_PREFIX, ""))
    return named.unionByName(rest.hint("merge").join(short, "key", "left")).drop("key")


def allowed_only(cands: DataFrame, merger: DataFrame) -> DataFrame:
    """Adds ``mapped`` (the new province has a merger list) and ``allowed`` (the
    candidate's old province is in it). merger: province_code, old_province_key."""
    has = merger.select("province_code").distinct().withColumn("mapped", F.lit(True))
    ok = merger.select("province_code", F.col("old_province_key").alias("pk")).distinct().withColumn("allowed", F.lit(True))
    keyed = cands.withColumn("pk", place_name(F.coalesce("old_province_name", F.lit(""))))
    out = keyed.join(has.hint("merge"), "province_code", "left").join(ok.hint("merge"), ["province_code", "pk"], "left")
    return out.withColumns({"mapped": F.coalesce("mapped", F.lit(False)), "allowed": F.coalesce("allowed", F.lit(False))}).drop("pk")


def classify_matches(cands: DataFrame) -> DataFrame:
    """One row per entry with its confidence tier and the first matching candidate."""
    real = F.col("ord").isNotNull()
    hint = place_name(F.coalesce("district_hint", F.lit("")))
    same = real & F.col("allowed") & (hint != "") & (place_name(F.coalesce("old_district_name", F.lit(""))) == hint)
    place = F.struct("old_district_name", "old_province_name")
    label = F.concat(F.coalesce("old_district_name", F.lit("None")), F.lit(", "), F.coalesce("old_province_name", F.lit("None")))

    def subset(cond: Column, name: str) -> list[Column]:
        listed = F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ord", label.alias("l"))))), lambda x: x["l"])
        return [F.count_if(cond).alias(f"n_{name}"), F.min_by(place, F.when(cond, F.col("ord"))).alias(f"first_{name}"), listed.alias(f"list_{name}")]

    per = cands.groupBy("entry_id", "province_code", "old_ward_name", "district_hint", "mapped").agg(
        *subset(real, "all"), *subset(real & F.col("allowed"), "ok"), *subset(same, "hint")
    )
    n_all, n_ok, n_hint, mapped = (F.col(c) for c in ("n_all", "n_ok", "n_hint", "mapped"))
    tier = (
        F.when(n_all == 0, "not_found")
        .when(mapped & (n_hint == 1), "district_hint").when(mapped & (n_hint > 1), "ambiguous_district_hint")
        .when(mapped & (n_all == 1) & (n_ok == 1), "exact").when(mapped & (n_ok == 1), "filtered")
        .when(mapped & (n_ok > 1), "ambiguous_region").when(mapped, "not_allowed")
        .when(n_all == 1, "exact").otherwise("ambiguous")
    )
    chosen = F.when(F.col("conf").isin("district_hint", "ambiguous_district_hint"), F.col("first_hint")).when(
        mapped & (F.col("conf") != "not_allowed"), F.col("first_ok")
    ).when(~mapped, F.col("first_all"))
    options = F.when(F.col("conf") == "ambiguous_district_hint", F.col("list_hint")).when(F.col("conf") == "ambiguous_region", F.col("list_ok")).when(
        F.col("conf").isin("not_allowed", "ambiguous"), F.col("list_all")
    )
    return per.withColumn("conf", tier).withColumn("c", chosen).select(
        "entry_id", "province_code", "old_ward_name", "district_hint", "c.old_district_name", "c.old_province_name", "conf",
        F.coalesce(options, F.array().cast("array<string>")).alias("all_options"),
    )


def infer_from_siblings(df: DataFrame, ward: str = "ward_code") -> DataFrame:
    """Within a new ward a strictly most frequent (district, province) of two or more
    sure entries fills the entries that were not allowed."""
    sure = df.filter(F.col("conf").isin(*SURE) & F.col("old_district_name").isNotNull() & F.col("old_province_name").isNotNull())
    counts = sure.groupBy(ward, "old_district_name", "old_province_name").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(ward).orderBy(F.desc("n"), "old_district_name", "old_province_name")
    top = counts.withColumns({"rn": F.row_number().over(order), "next": F.lead("n").over(order)}).filter("rn = 1 and n >= 2 and (next is null or n > next)")
    top = top.select(ward, F.col("old_district_name").alias("sd"), F.col("old_province_name").alias("sp"))
    fill = (F.col("conf") == "not_allowed") & F.col("sd").isNotNull()
    return df.join(top.hint("merge"), ward, "left").withColumns({
        "old_district_name": F.when(fill, F.col("sd")).otherwise(F.col("old_district_name")),
        "old_province_name": F.when(fill, F.col("sp")).otherwise(F.col("old_province_name")),
        "conf": F.when(fill, F.lit("inferred_from_siblings")).otherwise(F.col("conf")),
    }).drop("sd", "sp")


def tier_stats(df: DataFrame) -> DataFrame:
    """Entries and share of each tier."""
    return df.groupBy("conf").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))


def ambiguous_audit(df: DataFrame) -> DataFrame:
    """Entries with several candidates or none allowed."""
    return df.filter(F.col("conf").contains("ambiguous") | (F.col("conf") == "not_allowed"))


def not_found_audit(df: DataFrame) -> DataFrame:
    """Entries without any candidate."""
    return df.filter("conf = 'not_found'")


def merge_totals(wards: DataFrame) -> DataFrame:
    """New wards, merged and unchanged ones, per province."""
    return wards.groupBy("province_name").agg(F.count(F.lit(1)).alias("wards"), F.count_if("is_merged").alias("merged"), F.count_if(~F.col("is_merged")).alias("unchanged"))
