"""Datasets: keys, splits, profiles, packaging and generation (ids D1-D22)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.functions.phone import mask_phone
from orderloom.functions.text import abbreviate_admin, begins, collapse_ws, compact_text, short_district, short_province, short_ward, strip_accents, strip_honorific
from orderloom.functions.jsontext import row_text
from orderloom.operators.order import greedy_fill, hinted, numbered
from orderloom.sources.staging import staged

RESPONSE = (
    "struct<recipient_name:string,phone_number:string,note:string,address_raw:string,"
    "address_info:struct<address_number:string,street:string,neighborhood:string,municipality:string,sub_region:string,country:string>>"
)
# Text that tells who is spoken to, labels, and times in notes, as the profile counts them.
ROLE = (
    r"(ơi ship cho mình|ơi em chốt|shop .+ gửi giúp|nhân viên chốt đơn|liên hệ shop|ơi giao hộ|người gửi|sale, ship cho|ơi giao cho|ơi ship cho|"
    r"ơi đi giao|ơi đến .+ giao)"
)
LABELS = r"(Tên:|Họ tên:|ĐT:|SĐT:)\s"
TIMES = r"giao buổi|giao trước|giao sau|giao tối"
REVERSED = r"^(?:tinh|tỉnh|thanh pho|thành phố|tp\.?|ha noi|hà nội|ho chi minh|hồ chí minh)"
INFO = ("neighborhood", "municipality", "sub_region", "street", "address_number")
# Sample values for generated orders (own wording).
NAMES = ("chị Mai", "anh Tuấn", "cô Lan", "bạn Hương", "chú Bình", "Quỳnh", "anh Khoa", "chị Thảo", "bạn Phúc")
STREETS = ("đường Lê Lợi", "phố Huế", "đường Trần Phú", "đường Nguyễn Trãi", "phố Hàng Bông", "đường Hai Bà Trưng", "đường Quang Trung")
NOTES = ("gọi trước khi giao", "giao giờ hành chính", "để hàng ở quầy lễ tân", "ship sau 18h", "thu cod 250k", "chuyển khoản rồi", "giao buổi sáng")


def canonical_key(df: DataFrame, columns: list[str] | None = None) -> Column:
    """JSON of the row with sorted keys at every level, as Python's ``json.dumps`` writes it
    (nested structs, arrays and maps included); equal rows have equal keys."""
    return row_text(df.schema, columns, ordered=True)


def duplicate_stats(df: DataFrame) -> DataFrame:
    """Records, unique records, duplicate rows."""
    key = df.select(F.sha2(canonical_key(df), 256).alias("k"))
    return key.agg(F.count(F.lit(1)).alias("records"), F.count_distinct("k").alias("unique_records")).withColumn("duplicate_rows", F.col("records") - F.col("unique_records"))


def seeded(key: Column, seed: int) -> Column:
    """A number of 60 bits from a key and a seed, by SHA-256, so that other engines draw alike."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 15), 16, 10).cast("long")


#: Groups of a bucket whose sizes are summed one by one.
GROUPS_PER_BUCKET = 100_000


def split_groups(df: DataFrame, ratio: float = 0.8, seed: int = 1, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """D3: (train, valid); equal records stay together.

    The default sends a record to train by a hash of its key, both sides read from one written table: no shuffle,
    ratio approximate. ``exact`` takes the groups of equal records in the order of that hash and
    fills train up to round(n * ratio) rows; a group that does not fit goes to valid, and
    later, smaller ones are still tried.
    """
    # written out: as a step, a filter on the key would be pushed below all steps that make the records, and compute them again
    keyed = staged(df.withColumn("__k", seeded(canonical_key(df), seed)), "split-keys")
    if not exact:
        first = F.col("__k") / F.lit(float(1 << 60)) < ratio
        return keyed.filter(first).drop("__k"), keyed.filter(~first).drop("__k")
    groups = staged(keyed.groupBy(F.col("__k").alias("k")).agg(F.count(F.lit(1)).alias("n")), "split-groups")
    count, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = max(0, (count // GROUPS_PER_BUCKET).bit_length())
    fits = greedy_fill(groups.withColumn("bucket", F.shiftright("k", 60 - bits)), round(total * ratio))
    train = groups.filter(fits).select(F.col("k").alias("__k")).hint("merge")
    return keyed.join(train, "__k", "left_semi").drop("__k"), keyed.join(train, "__k", "left_anti").drop("__k")


def split_stats(train: DataFrame, valid: DataFrame) -> DataFrame:
    """Ratios of the split and records found on both sides."""
    sides = train.select(canonical_key(train).alias("k"), F.lit(0).alias("v")).unionByName(valid.select(canonical_key(valid).alias("k"), F.lit(1).alias("v")))
    keys = sides.groupBy(F.sha2("k", 256).alias("k")).agg(F.count_if(F.col("v") == 0).alias("t"), F.count_if(F.col("v") == 1).alias("v"))
    out = keys.agg(F.sum("t").alias("t"), F.sum("v").alias("v"), F.count_if((F.col("t") > 0) & (F.col("v") > 0)).alias("cross_split_overlap"))
    return out.select(F.round(F.col("t") / (F.col("t") + F.col("v")), 4).alias("train_ratio"), F.round(F.col("v") / (F.col("t") + F.col("v")), 4).alias("valid_ratio"), "cross_split_overlap")


def drop_leakage(train: DataFrame, valid: DataFrame, on: str) -> DataFrame:
    """Train rows whose ``on`` does not occur in valid."""
    return train.join(valid.select(on).distinct(), on, "left_anti")


def _has(pattern: str) -> Column:
    return F.col("input_masked").rlike(f"(?iU){pattern}")


def profile(df: DataFrame) -> DataFrame:
    """One-pass counts over (input_masked, response)."""
    r = F.col("response")
    marks = {"masked_phone_records": F.col("input_masked").contains("[PHONE]")}
    marks |= {f"{f}_null": r[f].isNull() for f in ("recipient_name", "note", "address_raw")}
    marks |= {f"{x}_dot_or_space_inputs": _has(rf"{begins(x)}\b{x}(?:\.|\s)") for x in "xhpq"}
    marks |= {f"{f}_null": r["address_info"][f].isNull() for f in INFO}
    # each record once: its marks as bits and 16 bytes of its key; equal records have equal marks and are counted together
    bits = functools.reduce(Column.bitwiseOR, [F.when(m, F.lit(1 << i)).otherwise(0) for i, m in enumerate(marks.values())])
    known = df.select(F.unhex(F.md5(canonical_key(df).cast("binary"))).alias("key"), bits.alias("bits"))
    per = known.groupBy("key", "bits").agg(F.count(F.lit(1)).alias("n"))
    sums = [F.sum(F.when(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0, F.col("n"))).alias(name) for i, name in enumerate(marks)]
    total = per.agg(*[F.coalesce(c, F.lit(0)).alias(n) for c, n in ((F.sum("n"), "records"), *zip(sums, marks, strict=True), (F.count(F.lit(1)), "unique_records"))])
    return total.withColumn("duplicate_rows", F.col("records") - F.col("unique_records"))


def profile_extended(df: DataFrame) -> DataFrame:
    """Styles of generated records: accentless, capitals, labels, order, roles."""
    raw, text = F.col("response")["address_raw"], F.col("input_masked")
    role = _has(ROLE)
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if((F.coalesce(raw, F.lit("")) != "") & (strip_accents(raw) == raw)).alias("accentless_address_records"),
        F.count_if(text == F.upper(text)).alias("all_caps_records"), F.count_if(_has(LABELS)).alias("formal_label_records"),
        F.count_if(text.startswith("[PHONE]")).alias("phone_first_records"), F.count_if(_has(TIMES)).alias("time_specific_note_records"),
        F.count_if(F.coalesce(raw, F.lit("")).rlike(f"(?iU){REVERSED}")).alias("reverse_order_records"),
        F.count_if(role).alias("role_confusion_records"), F.count_if(role & F.col("response")["recipient_name"].isNull()).alias("role_confusion_recipient_null"),
    )


def to_chat(df: DataFrame, system: str, *keep: str) -> DataFrame:
    """Messages of system, user and assistant; the answer is the response as JSON."""
    answer = F.to_json("response", {"ignoreNullFields": "false"})
    said = [(F.lit("system"), F.lit(system)), (F.lit("user"), F.col("input_masked")), (F.lit("assistant"), answer)]
    return df.select(*keep, F.array(*[F.struct(r.alias("role"), c.alias("content")) for r, c in said]).alias("messages"))


def package_splits(df: DataFrame, path: str, system: str) -> None:
    """Chat records as JSON lines, a folder for each value of ``split``."""
    to_chat(df, system, "split").write.mode("overwrite").partitionBy("split").json(path)


def unambiguous_entries(records: DataFrame) -> DataFrame:
    """Old triples (province, district, ward) that lead to one target only; of equal
    entries the last is kept. records: as flatten_admin gives them."""
    olds = records.filter("source = 'old'").select(
        *[collapse_ws(F.col(c)).alias(c) for c in ("old_province_name", "old_district_name", "old_ward_name")], "province_name", "ward_name", "ord"
    ).filter("old_province_name <> '' and old_district_name <> '' and old_ward_name <> ''")
    target = F.struct("province_name", "ward_name")
    per = olds.groupBy("old_province_name", "old_district_name", "old_ward_name").agg(F.count_distinct(target).alias("n"), F.max_by(target, "ord").alias("t"))
    return per.filter("n = 1").select("old_province_name", "old_district_name", "old_ward_name", "t.province_name", "t.ward_name")


def sampling_pools(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(old rows with district and province, new rows)."""
    old = records.filter("source = 'old' and coalesce(old_district_name, '') <> '' and coalesce(old_province_name, '') <> ''")
    return old, records.filter("source = 'new'")


def stratified_pick(df: DataFrame, n_by_stratum: dict[str, int], seed: int = 1, stratum: str = "stratum", key: str = "id") -> DataFrame:
    """So many rows of each stratum by seeded hash, in seeded order (``place``, from 1)."""
    limit = F.lit(0)
    for s, n in n_by_stratum.items():
        limit = F.when(F.col(stratum) == s, n).otherwise(limit)
    ranked = numbered(df.withColumn("__h", seeded(F.col(key), seed)), "__h", key, by=stratum, out="__r")
    picked = ranked.filter(F.col("__r") < limit).drop("__r", "__h")
    return numbered(picked.withColumn("__h", seeded(F.col(key), seed + 1)), "__h", key, out="place").drop("__h").withColumn("place", F.col("place") + 1)


def _of(values: tuple[str, ...], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(idx, F.lit(len(values))) + 1).cast("int"))


def _mod(idx: Column, n: int) -> Column:
    return F.pmod(idx, F.lit(n))


def _pick(idx: Column, *options: Column) -> Column:
    out = options[-1]
    for i in range(len(options) - 2, -1, -1):
        out = F.when(_mod(idx, len(options)) == i, options[i]).otherwise(out)
    return out


def synth_phone(idx: Column) -> Column:
    return F.concat(F.lit("09"), F.lpad(_mod(idx, 100).cast("string"), 2, "0"), F.lpad(_mod(idx * 37 + 123456, 1_000_000).cast("string"), 6, "0"))


def synth_fields(idx: Column, phone: Column | None = None) -> Column:
    """Phone, its written form, house number, street, name and note of an index; ``phone``: a column that holds synth_phone."""
    phone = synth_phone(idx) if phone is None else phone
    a, b, c = F.substring(phone, 1, 4), F.substring(phone, 5, 3), F.substring(phone, 8, 3)
    written = _pick(idx, F.concat_ws(".", a, b, c), F.concat_ws(" ", a, b, c), F.concat_ws(" ", F.lit("+84"), F.substring(phone, 2, 3), b, c), phone)
    house = _pick(
        idx, (idx + 10).cast("string"), F.concat((idx + 20).cast("string"), F.lit("/3")), F.concat((_mod(idx, 9) + 1).cast("string"), F.lit("A")),
        F.concat((idx + 30).cast("string"), F.lit("B")),
    )
    road = _of(STREETS, idx)
    alley = _pick(
        idx, F.concat_ws(" ", F.lit("ngõ"), (_mod(idx, 80) + 10).cast("string"), road), F.concat_ws(" ", F.lit("hẻm"), (_mod(idx, 60) + 5).cast("string"), road),
        F.concat_ws(" ", F.lit("ngách"), (_mod(idx, 30) + 2).cast("string"), F.lit("ngõ"), (_mod(idx, 70) + 11).cast("string"), road), road, road,
    )
    return F.struct(phone.alias("phone"), written.alias("phone_text"), house.alias("house"), alley.alias("street"), _of(NAMES, idx).alias("name"), _of(NOTES, idx).alias("note"))


def place_parts(place: Column, idx: Column) -> list[Column]:
    """Ward, district and province as a message has them."""
    return [short_ward(place["ward"], idx), short_district(place["district"], idx), short_province(place["province"], idx)]


#: Of each style of message what stands before name, phone, house, street, place and note; the fourth has dashes in
#: its place, the last the place before the street and the house behind it.
ORDER_STYLES = (
    ("", " đặt 1 đơn\nsđt ", "\nship sn ", " ", ", ", "\nnote: "),
    ("", " lấy 2 hộp, đt ", ". Giao về số ", " ", ", ", ". "),
    ("", " ", " nhận ở chỗ mới. ĐC: ", " ", ", ", ". "),
    ("đơn cho ", ", phone ", ", giao ", " ", ", ", "; ghi chú "),
    ("", "\n", "\nđịa chỉ: số ", ", ", ", ", "\n"),
    ("Shop nhận đơn của ", ": ", "; gửi ", " ", ", ", "; ghi chú: "),
    ("", " mua 3 món\ntel ", "\ngiao ", " ", ", ", "\n"),
    ("", " chốt đơn, sdt ", ", giao tới ", ", ", ", số nhà ", "; "),
)


def render_order(f: dict[str, Column] | Column, place: Column, idx: Column, tails: tuple[Column, Column] | None = None) -> Column:
    """The message of fields and place (province, district, ward), eight templates (own
    wording). ``tails``: columns that hold the place's parts, joined by commas and by dashes."""
    tail, dashed = tails or tuple(F.concat_ws(sep, *place_parts(place, idx)) for sep in (", ", " - "))
    # what stands between the parts is looked up by style: with a branch for each style the step is too long to be compiled
    gaps = [_of(values, idx) for values in zip(*ORDER_STYLES, strict=True)]
    style = _mod(idx, len(ORDER_STYLES))
    house, tail = f["house"], F.when(style == 3, dashed).otherwise(tail)
    turned = style == len(ORDER_STYLES) - 1
    parts = [f["name"], f["phone_text"], F.when(turned, tail).otherwise(house), f["street"], F.when(turned, house).otherwise(tail), f["note"]]
    return F.concat(*[c for pair in zip(gaps, parts, strict=True) for c in pair])


#: Of each style what stands before name, phone and address, and before the note; the fifth has the address before the
#: phone, those from the seventh to the tenth have it first, the last has the phone first.
TUNING_STYLES = (
    ("", " đt ", " về ", " note: "), ("đơn của ", ", phone ", ", nhận ở ", "; ghi chú "), ("", "\n", "\nđịa chỉ ", "\n"), ("Shop gửi giúp ", ": ", "; tới ", "; ghi chú: "),
    ("", " xin đổi chỗ nhận. ĐC: ", ". ", ". "), ("", " lấy thêm 1 hộp\nsđt ", "\nship ", "\nnote: "), ("giao về ", ", cho ", ", sđt ", ", ghi chú: "),
    ("nơi nhận: ", "\nkhách: ", "\ngọi: ", "\nnote: "), ("gửi ", " | ", " | ", " | "), ("ĐC ", " - ", " - ", " - "), ("Tên: ", " | ĐT: ", " | Nơi nhận: ", " | Ghi chú: "),
    ("Họ tên: ", "\nSĐT: ", "\nNơi nhận: ", "\nGhi chú: "), ("", " - ", " - ", " - "),
)


def render_tuning_order(f: Column, address: Column, idx: Column) -> Column:
    """D14 for tuning sets: the message of fields and one address line, thirteen templates (own
    wording): name first, address first, labelled, and phone first. A missing note leaves its
    part out; a missing phone is empty, or said to be missing where it has a label."""
    name, phone, told = F.coalesce(f["name"], F.lit("")), F.coalesce(f["phone_text"], F.lit("")), F.coalesce(f["phone_text"], F.lit("chưa có"))
    style = _mod(idx, len(TUNING_STYLES))
    first = F.when(style.between(6, 9), address).when(style == 12, phone).otherwise(name)
    second = F.when(style == 4, address).when(style.isin(6, 7, 8, 9, 12), name).when(style.isin(10, 11), told).otherwise(phone)
    third = F.when(style.isin(4, 6, 7, 8, 9), phone).otherwise(address)
    *gaps, noted = [_of(values, idx) for values in zip(*TUNING_STYLES, strict=True)]
    return F.concat(*[c for pair in zip(gaps, (first, second, third), strict=True) for c in pair], F.coalesce(F.concat(noted, f["note"]), F.lit("")))


#: Columns with the short forms of a place's names, and its province's on every third index.
PLACE_FORMS = ("short_ward", "short_district", "short_province", "third_province")


def place_forms(place: Column) -> list[Column]:
    w, d, p = place_parts(place, F.lit(0))
    return [c.alias(n) for c, n in zip((w, d, short_province(place["province"], F.lit(1)), p), PLACE_FORMS, strict=True)]


def with_text(df: DataFrame, f: dict[str, Column], place: Column, idx: Column) -> DataFrame:
    """Adds ``text`` as render_order has it, from PLACE_FORMS, which go; the lines of the place are a step of their own."""
    even, third = _mod(idx, 2) == 0, _mod(idx, 3) == 0
    parts = [F.when(even, F.col("short_ward")).otherwise(place["ward"]), F.when(even, F.col("short_district")).otherwise(place["district"]), F.when(third, F.col("third_province")).otherwise(F.col("short_province"))]
    told = df.select("*", *[c.alias(n) for c, n in zip(parts, ("__w", "__d", "__p"), strict=True)])
    told = told.select("*", *[F.concat_ws(sep, "__w", "__d", "__p").alias(n) for sep, n in ((", ", "__tail"), (" - ", "__dashed"))])
    return told.select(*[c for c in df.columns if c not in PLACE_FORMS], render_order(f, place, idx, (F.col("__tail"), F.col("__dashed"))).alias("text"))


def expected_parts(f: dict[str, Column] | Column, place: Column) -> dict[str, Column]:
    first = F.concat_ws(" ", f["house"], f["street"])
    return {
        "recipient_name": strip_honorific(f["name"]), "address_new": F.concat_ws(", ", first, place["new_ward"], place["new_province"]),
        "phone_number": f["phone"], "note": f["note"], "address_number": f["house"], "street": f["street"], "municipality": place["new_ward"], "sub_region": place["new_province"],
    }


def expected_order(f: dict[str, Column] | Column, place: Column, made: dict[str, Column] | None = None) -> Column:
    """What a parse of the rendered message should give; ``made``: columns that hold some of its parts."""
    e = expected_parts(f, place) | (made or {})
    info = F.struct(
        e["address_number"].alias("address_number"), e["street"].alias("street"), F.lit(None).cast("string").alias("neighborhood"), e["municipality"].alias("municipality"),
        e["sub_region"].alias("sub_region"), F.lit("VNM").alias("country"),
    )
    return F.struct(*[e[x].alias(x) for x in ("recipient_name", "phone_number", "note", "address_new")], info.alias("address_info"))


def perturb_address(df: DataFrame, idx: str = "idx") -> DataFrame:
    """Adds ``address_text``: one of sixteen ways to write (house, street, ward,
    district, province); every twentieth index from 14 on is in capitals."""
    i = F.col(idx)
    w, d, p = F.col("ward"), F.col("district"), F.col("province")
    front = F.concat_ws(" ", "house", "street")
    dot, bare = F.lit(True), F.lit(False)

    def short(c: Column, how: Column) -> Column:
        return abbreviate_admin(c, how)

    def line(*parts: Column) -> Column:
        return F.concat_ws(", ", *parts)

    ways = [
        line(front, w, d, p), line(front, short(w, dot), short(d, dot), short(p, dot)), line(front, short(w, bare), short(d, bare), short(p, bare)), line(front, w, p),
        line(front, d, p), line(front, w, d), F.lower(line(front, w, d, p)), strip_accents(line(front, w, d, p)), F.lower(strip_accents(line(front, short(w, bare), short(d, bare), p))),
        line(p, d, w, front), F.concat_ws(" - ", front, w, d, p), F.concat_ws(" ", front, w, d, p), line(front, short(w, dot), d, p), line(front, w, short(d, dot), p),
        line(w, d, p), line(front, short(w, dot), short(p, bare)),
    ]
    text = _pick(i, *ways)
    return df.withColumn("address_text", F.when(_mod(i, 20) == 14, F.upper(text)).otherwise(text))


def answer(name: Column, phone: Column, note: Column, raw: Column, house: Column, street: Column, neighborhood: Column, municipality: Column, sub_region: Column) -> Column:
    """The response of a tuning record; ``phone``: whether the text has one."""
    info = F.struct(
        house.alias("address_number"), street.alias("street"), neighborhood.alias("neighborhood"), municipality.alias("municipality"), sub_region.alias("sub_region"),
        F.when(F.coalesce(raw, F.lit("")) != "", F.lit("VNM")).alias("country"),
    )
    said = F.struct(strip_honorific(name).alias("recipient_name"), F.when(phone, F.lit("[PHONE]")).alias("phone_number"), note.alias("note"), raw.alias("address_raw"), info.alias("address_info"))
    return said.cast(RESPONSE)


def with_fields(df: DataFrame, by: Column | None = None, prefix: str = "", keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """Adds the fields of an index as columns of a step of their own, so that what names one often does not repeat how it is made."""
    i = F.col("idx") if by is None else by
    told = df.select(*keep, synth_phone(i).alias("__phone"))
    f = synth_fields(i, F.col("__phone"))
    return told.select(*[c for c in told.columns if c != "__phone"], *[f[x].alias(prefix + x) for x in ("phone", "phone_text", "house", "street", "name", "note")])


def role_records(ids: DataFrame, strict_compat: bool = False) -> DataFrame:
    """Messages in which a shop or courier is spoken to, so that no name is the
    recipient's or another one is; ``has_phone`` follows the text unless strict_compat."""
    i = F.col("idx")
    ids = with_fields(ids.select("idx"))
    f = {x: F.col(x) for x in ids.columns}
    who, other = _of(NAMES, i), _of(NAMES, i + 4)
    at = F.concat_ws(" ", f["house"], f["street"])

    def say(*bits: object) -> Column:
        return F.concat(*[F.lit(b) if isinstance(b, str) else b for b in bits])

    styles = [
        (say(who, " ơi ship cho mình tới ", at, ", số ", f["phone_text"]), None), (say(who, " ơi em chốt đơn này, giao ", at, " ", f["phone_text"]), None),
        (say("shop ", who, " gửi giúp tới ", other, " ", f["phone_text"], ", ", at), other), (say("nhân viên chốt đơn là ", who, ", khách ", other, " ", f["phone_text"], ", ", at), other),
        (say("liên hệ shop ", who, " nếu cần, giao ", at, " ", f["phone_text"]), None), (say(who, " ơi giao hộ cho ", other, " ở ", at, " ", f["phone_text"]), other),
        (say("người gửi ", who, ", người nhận ", other, " ", f["phone_text"], ", ", at), other), (say(who, " sale, ship cho ", other, " ", f["phone_text"], " về ", at), other),
        (say(who, " ơi giao cho ", other, " số ", f["phone_text"], " tại ", at), other), (say(who, " ơi ship cho ", other, " ", at, " ", f["phone_text"]), other),
        (say(who, " ơi đi giao giúp đơn ", f["phone_text"], " ", at), None), (say(who, " ơi đến ", at, " giao giúp"), None), (say("đơn của ", other, " ", f["phone_text"], ", ", who, " giao nhé, ", at), other),
    ]
    none = F.lit(None).cast("string")
    text = _pick(i, *[t for t, _ in styles])
    name = _pick(i, *[none if n is None else strip_honorific(n) for _, n in styles])
    said = _pick(i, *[none if n is None else n for _, n in styles])
    known = ids.select("idx", text.alias("text"), name.alias("recipient_name"), said.alias("said"), at.alias("at"), "house", "street")
    known = mask_record(known)
    has = F.lit(True) if strict_compat else F.col("input_masked").contains("[PHONE]")
    full = answer(F.col("said"), has, none, F.col("at"), F.col("house"), F.col("street"), none, none, none)
    return known.select("idx", "input_masked", "recipient_name", has.alias("has_phone"), full.alias("response"))


def correction_records(ids: DataFrame) -> DataFrame:
    """Messages that give an old address and then the right one, five styles (own wording)."""
    i = F.col("idx")
    ids = with_fields(with_fields(ids.select("idx")), i + 11, "later_")
    a, b = ({x: F.col(head + x) for x in ("phone_text", "house", "street", "name")} for head in ("", "later_"))
    old, new, none = F.concat_ws(" ", a["house"], a["street"]), F.concat_ws(" ", b["house"], b["street"]), F.lit(None).cast("string")

    def say(*bits: object) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in bits])

    text = _pick(
        i, say(a["name"], " ", a["phone_text"], " đổi từ ", old, " sang ", new), say("không giao ", old, " nữa, giao ", new, " cho ", a["name"], " ", a["phone_text"]),
        say(a["name"], " ", a["phone_text"], ", địa chỉ cũ ", old, "; địa chỉ mới ", new), say("sửa giúp ", a["name"], " ", a["phone_text"], ": ", new, " (trước là ", old, ")"),
        say(a["phone_text"], " ", a["name"], " chuyển về ", new, ", bỏ ", old),
    )
    known = ids.select("idx", text.alias("text"), "name", new.alias("address_raw"), F.col("later_house").alias("house"), F.col("later_street").alias("street"))
    full = answer(F.col("name"), F.lit(True), none, F.col("address_raw"), F.col("house"), F.col("street"), none, none, none)
    return mask_record(known).select("idx", "input_masked", strip_honorific(F.col("name")).alias("recipient_name"), "address_raw", full.alias("response"))


def generated_records(entries: DataFrame) -> DataFrame:
    """D19's address records: (idx, input_masked, response) of rows (idx, neighborhood, municipality,
    sub_region), of which sixteen styles shorten, lower, strip or leave out parts; every
    twentieth index from 14 on is in accentless capitals."""
    i = F.col("idx")
    entries = with_fields(entries.select("idx", "neighborhood", "municipality", "sub_region"))
    f, style = {x: F.col(x) for x in entries.columns}, _mod(i, 16)
    dotted, bare, low = style.isin(1, 7, 13), style.isin(2, 8), style.isin(3, 14)

    def stripped(c: Column) -> Column:
        return F.when(c.isNotNull(), strip_accents(c))

    def part(name: str, gone: tuple[int, ...], also_bare: tuple[int, ...] = ()) -> Column:
        c = F.col(name)
        short = F.when(dotted, abbreviate_admin(c, F.lit(True))).when(bare | style.isin(*also_bare), abbreviate_admin(c, F.lit(False)))
        return F.when(style.isin(*gone), F.lit(None)).otherwise(F.coalesce(short, F.when(low, F.lower(c)).when(style == 12, stripped(c)).otherwise(c)))

    street = F.when(style == 9, F.lit(None)).when(style == 12, stripped(f["street"])).otherwise(f["street"])
    house = F.when(style == 10, f["house"]).otherwise(F.concat(F.when(style == 12, F.lit("so ")).otherwise(F.lit("số ")), f["house"]))
    parts = entries.select("idx", "name", "phone_text", "note", "house", street.alias("street"), house.alias("front_house"), part("neighborhood", (4,)).alias("n"), part("municipality", (5,), (11, 15)).alias("m"), part("sub_region", (6, 15), (11,)).alias("p"))
    parts = parts.withColumn("front", F.concat_ws(" ", "front_house", "street"))
    gap = style.isin(3, 10, 11)
    lines = {sep: F.when(style.isin(13, 14), F.concat_ws(sep, "p", "m", "n", "front")).otherwise(F.concat_ws(sep, "front", "n", "m", "p")) for sep in (" ", ", ")}
    said = parts.withColumn("raw", F.when(gap, lines[" "]).otherwise(lines[", "]))
    said = said.withColumn("text", render_tuning_order(f, F.col("raw"), i))
    said = said.withColumn("text", F.when(_mod(i, 20) == 14, F.upper(strip_accents(F.col("text")))).otherwise(F.col("text")))
    full = answer(F.col("name"), F.lit(True), F.col("note"), F.col("raw"), F.col("house"), F.col("street"), F.col("n"), F.col("m"), F.col("p"))
    return mask_record(said).select("idx", "input_masked", full.alias("response"))


#: Share of the addresses, the first in order, that come from old entries.
OLD_SHARE = 0.7


def generate(ids: DataFrame, old: DataFrame, new: DataFrame, seed: int = 1) -> DataFrame:
    """Whole records (idx, kind, input_masked, response) for rows with distinct ``idx``.

    By place in the order of idx: every tenth is a role record, every twentieth from the sixth a
    correction; of the others the first 70 % have an old entry's address, the rest a new
    one's, drawn by a seeded hash with replacement. Entries are records as ``sampling_pools``
    gives them; without any of a kind its records are left out.
    """
    placed = numbered(ids.select("idx"), "idx", out="offset")
    at = F.col("offset")
    kind = F.when(_mod(at, 10) == 0, "role").when(_mod(at, 20) == 5, "correction").when(at < int(placed.count() * OLD_SHARE), "old").otherwise("new")
    placed = placed.withColumn("kind", kind)
    out = role_records(placed.filter("kind = 'role'").select("idx")).select("idx", F.lit("role").alias("kind"), "input_masked", "response")
    out = out.unionByName(correction_records(placed.filter("kind = 'correction'").select("idx")).select("idx", F.lit("correction").alias("kind"), "input_masked", "response"))
    for name, pool, names in (("old", old, ("old_ward_name", "old_district_name", "old_province_name")), ("new", new, (None, "ward_name", "province_name"))):
        known = numbered(pool, "ord")
        n = known.count()
        if n:
            parts = [(F.col(c) if c else F.lit(None).cast("string")).alias(x) for c, x in zip(names, ("neighborhood", "municipality", "sub_region"), strict=True)]
            drawn = placed.filter(F.col("kind") == name).withColumn("no", F.pmod(seeded(at, seed), F.lit(n)))
            drawn = drawn.join(hinted(known.select("no", *parts), n), "no")
            out = out.unionByName(generated_records(drawn).select("idx", F.lit(name).alias("kind"), "input_masked", "response"))
    return out


def curated(spark: SparkSession) -> DataFrame:
    """Small hand-made cases, one for each kind of edge (own wording)."""
    rows = [
        ("apartment", "chị Mai 0912345678 căn 12B tòa S2 chung cư Hoa Sen, phường Tân Phú", "0912345678"), ("urban_area", "anh Khoa 0387654321, lô 5 khu đô thị Mới, quận 7", "0387654321"),
        ("poi", "giao cổng trường tiểu học, cô Lan +84 912 345 678", "0912345678"), ("district_only", "ship quận 1 giúp bạn Hương 0909123456", "0909123456"),
        ("noisy_code", "mã đơn: 0912345678 chưa có số", None), ("noisy_short", "sđt 091234567 gọi giúp", None), ("two_phones", "0912345678 hoặc 0987654321", "0912345678"),
        ("house_like", "nhà số 0987654321 hẻm 3", None), ("old_admin", "xã An Thái, huyện Quỳnh Phụ, tỉnh Thái Bình 0356789012", "0356789012"), ("greeting", "chào shop, hôm nay mở cửa không", None),
    ]
    return spark.createDataFrame(rows, "category string, input string, expected_phone string")


# Sample places of edge cases (own wording): buildings, estates, landmarks, and districts for them.
BUILDINGS = ("căn 7C tòa Hoa Lan", "căn 1503 tháp Đông", "block B căn 21", "căn 09 tòa Sen", "tầng 5 nhà A2")
ESTATES = ("lô 5 KĐT Bờ Sông", "dãy N3 KĐT Đồi Xanh", "LK7 KĐT Hồ Tây Nhỏ")
LANDMARKS = ("cổng trường Hoa Mai", "quầy lễ tân khách sạn Biển", "chợ Đầu Mối", "bến xe Phía Nam")
AREAS = ("Quận 7", "Hà Đông", "Thủ Đức", "Đống Đa", "Tân Bình", "Long Biên", "Quận 1")
EDGES = ("apartment", "urban_area", "landmark", "district_only", "phone_like_code", "short_phone", "two_phones", "emoji")


def edge_records(ids: DataFrame) -> DataFrame:
    """D20 at any size: for each idx an edge case of one of eight kinds: category, input and
    what of it a parse should find (name, phone, note, ward, house_number)."""
    i = F.col("idx")
    n = F.floor(i / len(EDGES))
    f, other = synth_fields(n), synth_fields(n + 3)
    area, none = _of(AREAS, n), F.lit(None).cast("string")

    def say(*bits: object) -> Column:
        return F.concat(*[F.lit(b) if isinstance(b, str) else b for b in bits])

    home, lot, spot = _of(BUILDINGS, n), _of(ESTATES, n), _of(LANDMARKS, n)
    name, phone, note = f["name"], f["phone"], f["note"]
    cases = [  # text, name, phone, note, ward, house number
        (say(name, " ", f["phone_text"], " giao ", home, ", ", area, ", note: ", note), name, phone, note, area, home),
        (say(name, " ", f["phone_text"], " ship số nhà ", lot, ", ", area), name, phone, none, area, lot),
        (say(name, " ", f["phone_text"], " nhận ở ", spot, ", ", area, ", ", note), name, phone, note, area, spot),
        (say(name, ", ", f["phone_text"], ", ", area), name, phone, none, area, none),
        (say("mã đơn: ", phone, ", giao ", f["house"], " ", f["street"]), none, none, none, none, f["house"]),
        (say(name, " ", F.substring(phone, 1, 9), " giao ", f["house"], " ", f["street"], ", ", area), name, none, none, area, f["house"]),
        (say("2 số: ", name, " ", phone, ", không gọi được thì ", other["phone"], ", giao ", f["house"], " ", f["street"]), name, phone, none, none, f["house"]),
        (say(name, " 🙂 :v ship ", f["house"], " ", f["street"], " ", phone), name, phone, none, none, f["house"]),
    ]
    fields = ("input", "name", "phone", "note", "ward", "house_number")
    return ids.select("idx", _of(EDGES, i).alias("category"), *[_pick(i, *[c[k] for c in cases]).alias(x) for k, x in enumerate(fields)])


def dataset_summary(train: DataFrame, valid: DataFrame) -> DataFrame:
    """The extended profile of both splits."""
    return profile_extended(train).withColumn("split", F.lit("train")).unionByName(profile_extended(valid).withColumn("split", F.lit("valid")))


def mask_record(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``input_masked``; numbers are masked in a step of their own, as what follows names the result more than once."""
    masked = df.withColumn("__masked", mask_phone(F.col(text)))
    return masked.withColumn("input_masked", compact_text(F.col("__masked"))).drop("__masked")
