"""Whole plans: messages and an administrative table from the star schema, and the parse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.functions.extract import address_parts, extract_name, extract_note, is_likely_order
from orderloom.functions.merge import apply_precedence, fix_address_parts, format_address, join_street, merge_hints, project_order, repair_region, trust_resolved
from orderloom.functions.phone import extract_phone, mask_phone, normalize_phone
from orderloom.functions.text import compact_text
from orderloom.operators.dataset import PLACE_FORMS, expected_order, expected_parts, place_forms, with_fields, with_text
from orderloom.operators.resolve import infer_province, resolve_records, unique_municipalities
from orderloom.sources.io import nest_admin
from orderloom.sources.staging import staged

# Sample names for the administrative table that is derived from the star schema.
PROVINCES = ("Thành phố Hà Nội", "Thành phố Hồ Chí Minh", "Tỉnh Thái Bình", "Tỉnh Nghệ An", "Tỉnh Lâm Đồng")
DISTRICTS = ("Quận Ba Đình", "Huyện Quỳnh Phụ", "Quận Bình Thạnh", "Thị xã Sơn Tây", "Huyện Đông Hưng", "Quận Tân Bình", "Huyện Củ Chi")
WARD_TYPES = ("Phường", "Xã", "Thị trấn")
FIRST = ("An", "Bình", "Đông", "Hòa", "Tân", "Phú", "Mỹ", "Vĩnh", "Long", "Thanh", "Xuân")
SECOND = ("Thái", "Hưng", "Khê", "Sơn", "Lộc", "Thịnh", "Hải", "Châu", "Trung", "Quang", "Giang", "Đức", "Lâm")

EMPTY_ORDER = "struct<name:string,phone:string,note:string,address_raw:string,address:struct<province:string,district_hint:string,ward:string,street:string,house_number:string>>"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of(values: tuple[str, ...], n) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def old_wards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One old ward a supplier: its names, its district by nation and province by region,
    and the new ward (one for every three keys of a nation) that took it in."""
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    both = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"])  # nation: 25 rows
    k, nat, reg = F.col("s_suppkey"), F.col("s_nationkey"), F.col("n_regionkey")
    district = F.concat(_of(DISTRICTS, nat), F.lit(" "), nat.cast("string"))
    name = F.concat_ws(" ", _of(WARD_TYPES, k), _of(FIRST, k), _of(SECOND, F.floor(k / 11)))
    new = F.floor(k / 3)
    return both.select(
        k.alias("ord"), F.lpad(reg.cast("string"), 2, "0").alias("province_code"), _of(PROVINCES, reg).alias("province_name"),
        F.concat(nat.cast("string"), F.lit("-"), new.cast("string")).alias("ward_code"),
        F.concat_ws(" ", F.lit("Phường"), _of(SECOND, new), _of(FIRST, nat)).alias("ward_name"),
        name.alias("old_ward_name"), district.alias("old_district_name"), _of(PROVINCES, reg).alias("old_province_name"),
    )


def admin_wards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New wards with their predecessors; a ward has at most three."""
    olds = F.array_sort(F.collect_list(F.struct("ord", "old_ward_name", "old_district_name", "old_province_name")))
    per = old_wards(spark, sf_dir).groupBy("province_code", "province_name", "ward_code", "ward_name").agg(olds.alias("olds"), F.min("ord").alias("pos"))
    bare = F.transform("olds", lambda o: F.struct(o["old_ward_name"].alias("old_ward_name"), o["old_district_name"].alias("old_district_name"), o["old_province_name"].alias("old_province_name")))
    text = F.array_join(F.transform("olds", lambda o: F.concat(o["old_ward_name"], F.lit(" ("), o["old_district_name"], F.lit(")"))), ", ")
    return per.select("province_code", "province_name", "ward_code", "ward_name", F.lit(True).alias("is_merged"), text.alias("merged_from_raw"), bare.alias("merged_from"), "pos")


def admin_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nest_admin(admin_wards(spark, sf_dir))


#: Messages of a task at most, and at least where there are fewer tasks than cores.
MESSAGES_PER_TASK, LEAST_MESSAGES = 50_000, 4_000
#: The same of whole documents, which are longer.
DOCUMENTS_PER_TASK, LEAST_DOCUMENTS = 5_000, 250
#: Wards up to which their table is broadcast.
WARDS_TO_BROADCAST = 100_000


def spread(df: DataFrame, key: str, most: int = MESSAGES_PER_TASK, least: int = LEAST_MESSAGES) -> DataFrame:
    """Rows of small keys dealt out by them: a scan's splits go by bytes, and one of keys alone holds
    millions of rows, from each of which a message is made and parsed."""
    rows = df.count()
    tasks = max(-(-rows // most), min(df.sparkSession.sparkContext.defaultParallelism, rows // least))
    return df.repartition(tasks, key) if tasks > 1 else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text), dealt out: a row group is read by one task, and one may hold a million documents."""
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", DOCUMENTS_PER_TASK, LEAST_DOCUMENTS)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(msg_id, idx, text, place, fields, expected): a message for each order."""
    olds = old_wards(spark, sf_dir)
    n = olds.count()
    pool = olds.select(
        F.col("ord").alias("no"), F.struct(
            F.col("old_province_name").alias("province"), F.col("old_district_name").alias("district"), F.col("old_ward_name").alias("ward"),
            F.col("province_name").alias("new_province"), F.col("ward_name").alias("new_ward"),
        ).alias("place"),
    ).select("*", *place_forms(F.col("place")))  # once a ward, not once a message
    low = olds.agg(F.min("ord").alias("lo")).first()["lo"] or 0
    few = n <= WARDS_TO_BROADCAST
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("msg_id"), F.col("o_orderkey").alias("idx"))
    # many wards are not broadcast: messages are dealt out by their ward then, and each task has its share of wards to look up
    keyed = spread(orders.withColumn("no", F.pmod("idx", F.lit(max(n, 1))) + low), "msg_id" if few else "no")
    both = with_fields(keyed.join(pool.hint("broadcast" if few else "shuffle_hash"), "no"), keep=("msg_id", "idx", "place", *PLACE_FORMS))
    f = {c: F.col(c) for c in both.columns}
    # what several expressions read is a column of a step before; a struct's fields would be put back in wherever they are read
    place, e = F.col("place"), expected_parts(f, F.col("place"))
    both = with_text(both, f, place, F.col("idx")).select("*", *[e[c].alias(f"e_{c}") for c in ("recipient_name", "address_new")])
    expected = expected_order(f, place, {c: F.col(f"e_{c}") for c in ("recipient_name", "address_new")})
    return both.select("msg_id", "idx", "text", "place", F.struct("phone", "phone_text", "house", "street", "name", "note").alias("fields"), expected.alias("expected"))


def rule_pass(msgs: DataFrame) -> DataFrame:
    """Canonical text, rule hints, masked text and the gate: msg_id, cleaned, rule, hints, masked, is_order.

    Each step reads columns of the step before, which Spark computes once; a filter on
    ``is_order`` right behind it would be pushed below all steps and compute them again.
    """
    cleaned = msgs.select("msg_id", compact_text(F.col("text")).alias("cleaned"))
    c = F.col("cleaned")
    hints = address_parts(c)  # columns of their own: the fields of a struct would be found anew wherever they are read
    found = cleaned.withColumns({"phone0": extract_phone(c), "name0": extract_name(c), "note0": extract_note(c), "masked0": mask_phone(c)} | {f"hint_{x}": h for x, h in hints.items()})
    found = found.withColumns({"masked": compact_text(F.col("masked0")), "is_order": is_likely_order(c, F.col("phone0"), {x: F.col(f"hint_{x}") for x in hints})})
    return found.select(
        "msg_id", "cleaned", F.struct(F.col("phone0").alias("phone"), F.col("name0").alias("name"), F.col("note0").alias("note")).alias("rule"),
        F.struct(*[F.col(f"hint_{x}").alias(x) for x in hints]).alias("hints"), "masked", "is_order",
    )


def parse_messages(
    msgs: DataFrame, records: DataFrame, replies: DataFrame | None = None, threshold: float = 84.0, resolve: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Messages (msg_id, text) to parsed orders. ``replies`` (msg_id, model) are model
    orders where a model was asked; without them rules alone decide. Texts that are no
    order give an all-null row. ``resolve``: what adds ``resolved`` to addresses, in place of
    resolution against ``records``."""
    ruled = rule_pass(msgs)
    empty = F.lit(None).cast(EMPTY_ORDER)
    ruled = ruled.join(replies.hint("merge"), "msg_id", "left") if replies is not None else ruled.withColumn("model", empty)
    blank = "named_struct('province', cast(null as string), 'district_hint', cast(null as string), 'ward', cast(null as string), 'street', cast(null as string), 'house_number', cast(null as string))"
    ruled = staged(ruled.drop("cleaned", "masked"), "ruled")
    merged = apply_precedence(ruled.filter("is_order")).withColumn("phone", normalize_phone(F.col("phone")))
    merged = merged.withColumn("address", merge_hints(F.coalesce(F.col("model.address"), F.expr(blank)), F.col("hints")))
    merged = staged(merged.select("msg_id", "phone", "name", "note", F.col("model.address_raw").alias("said"), "address"), "merged")
    fixed = staged(merged.withColumn("address", fix_address_parts(F.col("address"))), "fixed")
    a = F.col("address")
    raw = format_address(join_street(a["house_number"], a["street"]), a["ward"], a["district_hint"], a["province"])
    fixed = fixed.withColumn("address_raw", F.coalesce(F.nullif("said", F.lit("")), raw)).drop("said")
    keys = fixed.select("address.province", "address.district_hint", "address.ward", "address.street", "address.house_number", "msg_id")
    known = resolve(keys) if resolve else resolve_records(keys, records, threshold)
    resolved = staged(known.select("msg_id", "resolved"), "resolved")
    resolved = fixed.join(resolved.hint("merge"), "msg_id")
    trusted = staged(trust_resolved(resolved), "trusted")
    unique = unique_municipalities(records)
    trusted = infer_province(trusted, "sub_region", unique, "inferred_region")
    trusted = infer_province(trusted, "municipality", unique, "inferred_municipality")
    done = project_order(staged(repair_region(trusted), "repaired"))
    rest = ruled.filter("not is_order").select("msg_id")
    return done.unionByName(rest, allowMissingColumns=True)
