"""The registered queries and their SQL.

Names begin with the id of the operator they show. Queries read the star schema or
what Spark derives from it (messages, an administrative table), so their work grows
with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.functions import extract, merge, phone, reply, text
from orderloom.operators import admin, dataset, resolve, score
from orderloom.plans import orders as plan
from orderloom.plans.orders import read
from orderloom.sources.staging import staged

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _of(values, n: str) -> str:
    return f"{_list(values)}[CAST(({n}) % {len(values)} + 1 AS INTEGER)]"


# ---------------------------------------------------------------- SQL of the derived tables
SQL_FIELDS = f"""
m AS (SELECT o_orderkey AS i FROM orders),
f0 AS (SELECT i, '09' || lpad(CAST(i % 100 AS VARCHAR), 2, '0') || lpad(CAST((i * 37 + 123456) % 1000000 AS VARCHAR), 6, '0') AS phone,
  {_of(dataset.STREETS, 'i')} AS road, {_of(dataset.NAMES, 'i')} AS name, {_of(dataset.NOTES, 'i')} AS note FROM m),
f AS (SELECT *, substr(phone, 1, 4) AS a, substr(phone, 5, 3) AS b, substr(phone, 8, 3) AS c,
  CASE i % 4 WHEN 0 THEN CAST(i + 10 AS VARCHAR) WHEN 1 THEN CAST(i + 20 AS VARCHAR) || '/3' WHEN 2 THEN CAST(i % 9 + 1 AS VARCHAR) || 'A' ELSE CAST(i + 30 AS VARCHAR) || 'B' END AS house,
  CASE i % 5 WHEN 0 THEN 'ngõ ' || (i % 80 + 10) || ' ' || road WHEN 1 THEN 'hẻm ' || (i % 60 + 5) || ' ' || road
    WHEN 2 THEN 'ngách ' || (i % 30 + 2) || ' ngõ ' || (i % 70 + 11) || ' ' || road ELSE road END AS street FROM f0)
"""
SQL_OLD = f"""
old AS (SELECT s_suppkey AS ord, lpad(CAST(n_regionkey AS VARCHAR), 2, '0') AS province_code, {_of(plan.PROVINCES, 'n_regionkey')} AS province_name,
  s_nationkey || '-' || (s_suppkey // 3) AS ward_code, 'Phường ' || {_of(plan.SECOND, 's_suppkey // 3')} || ' ' || {_of(plan.FIRST, 's_nationkey')} AS ward_name,
  {_of(plan.WARD_TYPES, 's_suppkey')} || ' ' || {_of(plan.FIRST, 's_suppkey')} || ' ' || {_of(plan.SECOND, 's_suppkey // 11')} AS old_ward_name,
  {_of(plan.DISTRICTS, 's_nationkey')} || ' ' || s_nationkey AS old_district_name, {_of(plan.PROVINCES, 'n_regionkey')} AS old_province_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)
"""
SQL_PLACES = f"""{SQL_FIELDS}, {SQL_OLD},
lim AS (SELECT min(ord) AS lo, count(*) AS n FROM old),
msg AS (SELECT f.*, old.* FROM f, lim JOIN old ON old.ord = f.i % lim.n + lim.lo)
"""


def _short(c: str, pairs, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN starts_with({c}, '{long}') THEN '{short}' || substr({c}, {len(long) + 1})" for long, short in pairs) + f" ELSE {otherwise} END"


_TAIL_PARTS = (
    f"CASE WHEN i % 2 = 0 THEN {_short('old_ward_name', (('Phường ', 'p. '), ('Xã ', 'x. '), ('Thị trấn ', 'tt. ')), 'old_ward_name')} ELSE old_ward_name END",
    f"CASE WHEN i % 2 = 0 THEN {_short('old_district_name', (('Quận ', 'q. '), ('Huyện ', 'h. ')), 'old_district_name')} ELSE old_district_name END",
    f"CASE WHEN i % 3 = 0 AND old_province_name LIKE '%Hà Nội' THEN 'HN' WHEN i % 3 = 0 AND old_province_name LIKE '%Hồ Chí Minh' THEN 'HCM' "
    f"ELSE {_short('old_province_name', (('Thành phố ', 'TP. '), ('Tỉnh ', '')), 'old_province_name')} END",
)
_PHONE_TEXT = "CASE i % 4 WHEN 0 THEN a || '.' || b || '.' || c WHEN 1 THEN a || ' ' || b || ' ' || c WHEN 2 THEN '+84 ' || substr(phone, 2, 3) || ' ' || b || ' ' || c ELSE phone END"
#: The rendered messages: i, text, with the fields and the place.
SQL_TEXTS = f"""{SQL_PLACES},
bits AS (SELECT *, {_PHONE_TEXT} AS pt, {_TAIL_PARTS[0]} AS pw, {_TAIL_PARTS[1]} AS pd, {_TAIL_PARTS[2]} AS pp, chr(10) AS nl FROM msg),
line AS (SELECT *, pw || ', ' || pd || ', ' || pp AS tail FROM bits),
texts AS (SELECT *, CASE i % 8
  WHEN 0 THEN name || ' đặt 1 đơn' || nl || 'sđt ' || pt || nl || 'ship sn ' || house || ' ' || street || ', ' || tail || nl || 'note: ' || note
  WHEN 1 THEN name || ' lấy 2 hộp, đt ' || pt || '. Giao về số ' || house || ' ' || street || ', ' || tail || '. ' || note
  WHEN 2 THEN name || ' ' || pt || ' nhận ở chỗ mới. ĐC: ' || house || ' ' || street || ', ' || tail || '. ' || note
  WHEN 3 THEN 'đơn cho ' || name || ', phone ' || pt || ', giao ' || house || ' ' || street || ', ' || pw || ' - ' || pd || ' - ' || pp || '; ghi chú ' || note
  WHEN 4 THEN name || nl || pt || nl || 'địa chỉ: số ' || house || ', ' || street || ', ' || tail || nl || note
  WHEN 5 THEN 'Shop nhận đơn của ' || name || ': ' || pt || '; gửi ' || house || ' ' || street || ', ' || tail || '; ghi chú: ' || note
  WHEN 6 THEN name || ' mua 3 món' || nl || 'tel ' || pt || nl || 'giao ' || house || ' ' || street || ', ' || tail || nl || note
  ELSE name || ' chốt đơn, sdt ' || pt || ', giao tới ' || tail || ', ' || street || ', số nhà ' || house || '; ' || note END AS text FROM line)
"""


def _re2(pattern: str) -> str:
    """A pattern for SQL: its word breaks and word characters are those of all letters, and what it looks ahead for is read."""
    out = pattern.replace("(?=", "(?:").replace(r"[\wÀ-ỹ]", r"[\p{L}\p{N}_À-ỹ]")
    lead, tail = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
    parts = out.split(r"\b")
    return "(?i)" + parts[0] + "".join((lead if k == 0 and not parts[0] else tail) + x for k, x in enumerate(parts[1:]))


def _found(pattern: str, group: int = 1, c: str = "t") -> str:
    return f"nullif(regexp_extract({c}, '{_re2(pattern)}', {group}), '')"


_RAW = {"wr": _found(extract.WARD), "dr": _found(extract.DISTRICT), "pr": _found(extract.PROVINCE), "form": _found(extract.NAME), "called": _found(extract.NAME, 2)}
#: The rule hints of the rendered messages: i, name, province, district_hint, ward, street, house_number, noted.
SQL_HINTS = f"""{SQL_TEXTS},
clean AS (SELECT i, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM texts),
raw AS (SELECT i, t, {", ".join(f"trim({sql}) AS {n}" for n, sql in _RAW.items())} FROM clean),
hints AS (SELECT i, form || ' ' || called AS name,
  CASE WHEN regexp_matches(t, '{_re2(extract.HA_NOI)}') THEN 'Hà Nội' WHEN regexp_matches(t, '{_re2(extract.HO_CHI_MINH)}') THEN 'Hồ Chí Minh'
    ELSE trim(regexp_replace(pr, '{_re2(extract.NOTE_LABEL)}.*', ''), ' ,;.') END AS province,
  CASE WHEN starts_with(lower(dr), 'q') THEN 'Quận ' WHEN regexp_matches(lower(dr), '^(h\\.|huyện|huyen|h )') THEN 'Huyện ' ELSE 'Thị xã ' END || trim(regexp_replace(dr, '(?i){extract.DISTRICT_TYPE}', '')) AS district_hint,
  CASE WHEN starts_with(lower(wr), 'p') THEN 'Phường ' WHEN regexp_matches(lower(wr), '^(x\\.|x |xã|xa)') THEN 'Xã ' ELSE 'Thị trấn ' END || trim(regexp_replace(wr, '(?i){extract.WARD_TYPE}', '')) AS ward,
  nullif(trim(coalesce(trim({_found(extract.STREET)}) || ' ', '') || coalesce(trim({_found(extract.STREET, 2)}), '')), '') AS street,
  coalesce({_found(extract.HOUSE)}, {_found(extract.LEADING_HOUSE)}) AS house_number,
  regexp_matches(t, '{_re2(extract.LABELLED_NOTE)}') OR regexp_matches(t, '{_re2(extract.SIMPLE_NOTE)}') AS noted FROM raw)
"""


def _text(name: str, sql: str):
    """Folding of Vietnamese letters in SQL: DuckDB strips marks but keeps đ."""
    return f"replace(replace(strip_accents({sql}), 'đ', 'd'), 'Đ', 'D')"


# ---------------------------------------------------------------- flagship
@query(f"WITH {SQL_HINTS} SELECT ward, count(*) AS orders, count(*) AS with_phone, count(*) FILTER (noted) AS with_note, count(house_number) AS with_house_number FROM hints GROUP BY ward")
def entry_orders_by_ward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone, name, note and address parts of every message, counted by ward."""
    ruled = plan.rule_pass(plan.messages(spark, sf_dir)).select("is_order", F.col("hints.ward").alias("ward"), "rule.phone", "rule.note", F.col("hints.house_number").alias("house"))
    of = {"orders": F.lit(1), "with_phone": F.col("phone"), "with_note": F.col("note"), "with_house_number": F.col("house")}
    counts = ruled.groupBy("ward").agg(*[F.count(F.when(F.col("is_order"), c)).alias(n) for n, c in of.items()])
    return counts.filter("orders > 0")


# ---------------------------------------------------------------- text
@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS compact FROM documents")
def t1_compact_text(spark, sf_dir):
    return plan.documents(spark, sf_dir).select("doc_id", text.compact_text(F.col("text")).alias("compact"))


@query("SELECT doc_id, replace(replace(strip_accents(text), 'đ', 'd'), 'Đ', 'D') AS bare FROM documents")
def t2_strip_accents(spark, sf_dir):
    return plan.documents(spark, sf_dir).select("doc_id", text.strip_accents(F.col("text")).alias("bare"))


def _key_sql(low: str) -> str:
    """The key of a lowered text: runs of other than word characters are blanks, prefixes of two words and of one go."""
    spaced = f"' ' || replace(trim(regexp_replace({low}, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]+', ' ', 'g')), ' ', '  ') || ' '"
    two = "|".join(p.replace(" ", "  ") for p in text.ADMIN_PREFIXES if " " in p)
    words = f"string_split(regexp_replace({spaced}, ' (?:{two}) ', '  ', 'g'), ' ')"
    return f"array_to_string(list_filter({words}, lambda w: w <> '' AND NOT list_contains({_list(text.ADMIN_PREFIXES)}, w)), ' ')"


@query(f"SELECT doc_id, {_key_sql('lower(' + _text('', 'text') + ')')} AS key FROM documents")
def t3_normalize_key(spark, sf_dir):
    return plan.documents(spark, sf_dir).select("doc_id", text.normalize_key(F.col("text")).alias("key"))


@query(f"SELECT doc_id, {_key_sql('lower(text)')} AS key FROM documents")
def t4_normalize_text_key(spark, sf_dir):
    return plan.documents(spark, sf_dir).select("doc_id", text.normalize_text_key(F.col("text")).alias("key"))


@query("SELECT conv_id, turn, lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS scored FROM conversations")
def t5_score_text(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.score_text(F.col("text")).alias("scored"))


@query("SELECT page_id, lower(trim(url)) AS url_key FROM pages")
def t6_eval_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.eval_text(F.col("url")).alias("url_key"))


@query("SELECT p_partkey, trim(regexp_replace(lower(coalesce(p_name, '')), '\\s+', ' ', 'g')) AS name FROM part")
def t7_export_text(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.export_text(F.col("p_name")).alias("name"))


@query(f"WITH {SQL_OLD} SELECT ord, {_text('', 'lower(old_ward_name)')} AS ward, {_text('', 'lower(old_district_name)')} AS district FROM old")
def t8_place_name(spark, sf_dir):
    o = plan.old_wards(spark, sf_dir)
    return o.select("ord", text.place_name(F.col("old_ward_name")).alias("ward"), text.place_name(F.col("old_district_name")).alias("district"))


@query("SELECT c_custkey, 'W_' || regexp_replace(upper(c_name), '[^A-Z0-9]+', '_', 'g') AS code FROM customer")
def t10_ward_code(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", text.ward_code(F.col("c_name"), F.lit("")).alias("code"))


@query(f"WITH {SQL_FIELDS} SELECT i AS msg_id, regexp_replace(name, '^(chị|anh|cô|bạn|chú) ', '') AS recipient, regexp_replace(name, '^(chị|anh|cô|bạn|chú) ', '') AS bare FROM f")
def t11_t12_recipient_name(spark, sf_dir):
    f = plan.messages(spark, sf_dir)
    return f.select("msg_id", text.recipient_name(F.col("fields.name")).alias("recipient"), text.strip_honorific(F.col("fields.name")).alias("bare"))


@query(f"""WITH {SQL_OLD} SELECT ord,
  CASE WHEN ord % 2 = 0 THEN replace(replace(replace(old_ward_name, 'Phường ', 'p. '), 'Xã ', 'x.'), 'Thị trấn ', 'tt. ') ELSE replace(replace(replace(old_ward_name, 'Phường ', 'p '), 'Xã ', 'x '), 'Thị trấn ', 'tt ') END AS ward,
  CASE WHEN ord % 3 = 0 AND old_province_name LIKE '%Hà Nội%' THEN 'HN' WHEN ord % 3 = 0 AND old_province_name LIKE '%Hồ Chí Minh%' THEN 'HCM'
    ELSE replace(replace(old_province_name, 'Thành phố ', 'TP. '), 'Tỉnh ', '') END AS province FROM old""")
def t13_t14_short_forms(spark, sf_dir):
    o = plan.old_wards(spark, sf_dir)
    even = F.pmod("ord", F.lit(2)) == 0
    return o.select("ord", text.abbreviate_admin(F.col("old_ward_name"), even).alias("ward"), text.short_province(F.col("old_province_name"), F.col("ord")).alias("province"))


ALL_TYPES = ("Thành Phố Huế", "Thành phố Huế", "Thủ Đô Hà Nội", "Thủ đô Hà Nội", "Thị trấn Đo Đo", "Thị xã Xã Đoài", "Phường Huyện Sĩ", "Huyện Tỉnh Gia", "Quận 7", "Tỉnh Nghệ An", "Xã An", "", "An Tỉnh")


@query(f"""WITH {SQL_OLD}, n AS (SELECT ord, {_of(ALL_TYPES, 'ord')} AS name FROM old)
SELECT ord, name, CASE ord % 13 + 1 WHEN 1 THEN 'tp. Huế' WHEN 2 THEN 'tp. Huế' WHEN 3 THEN 'Hà Nội' WHEN 4 THEN 'Hà Nội' WHEN 5 THEN 'tt. Đo Đo' WHEN 6 THEN 'tx. Xã Đoài' WHEN 7 THEN 'p. Huyện Sĩ' WHEN 8 THEN 'h. Tỉnh Gia'
    WHEN 9 THEN 'q. 7' WHEN 10 THEN 'tỉnh Nghệ An' WHEN 11 THEN 'x.An' WHEN 12 THEN NULL ELSE 'An Tỉnh' END AS dotted,
  CASE ord % 13 + 1 WHEN 1 THEN 'tp Huế' WHEN 2 THEN 'tp Huế' WHEN 3 THEN 'Hà Nội' WHEN 4 THEN 'Hà Nội' WHEN 5 THEN 'tt Đo Đo' WHEN 6 THEN 'tx Xã Đoài' WHEN 7 THEN 'p Huyện Sĩ' WHEN 8 THEN 'h Tỉnh Gia'
    WHEN 9 THEN 'q 7' WHEN 10 THEN 'Nghệ An' WHEN 11 THEN 'x An' WHEN 12 THEN NULL ELSE 'An Tỉnh' END AS bare FROM n""")
def t13_all_types(spark, sf_dir):
    o = plan.old_wards(spark, sf_dir).select("ord", plan._of(ALL_TYPES, F.col("ord")).alias("name"))
    return o.select("ord", "name", text.abbreviate_admin(F.col("name"), F.lit(True)).alias("dotted"), text.abbreviate_admin(F.col("name"), F.lit(False)).alias("bare"))


# ---------------------------------------------------------------- phones
@query(f"WITH {SQL_FIELDS} SELECT i AS msg_id, phone FROM f")
def p1_normalize_phone(spark, sf_dir):
    return plan.messages(spark, sf_dir).select("msg_id", phone.normalize_phone(F.col("fields.phone_text")).alias("phone"))


@query(f"WITH {SQL_FIELDS} SELECT i AS msg_id, phone FROM f")
def p2_extract_phone(spark, sf_dir):
    return plan.messages(spark, sf_dir).select("msg_id", phone.extract_phone(F.col("text")).alias("phone"))


@query(f"WITH {SQL_FIELDS} SELECT i AS msg_id, CASE WHEN i % 3 = 0 THEN NULL ELSE phone END AS phone FROM f")
def p3_phone_context(spark, sf_dir):
    m = plan.messages(spark, sf_dir)
    before = F.when(F.pmod("idx", F.lit(3)) == 0, F.lit("mã đơn: ")).otherwise(F.lit("gọi "))
    return m.select("msg_id", phone.extract_phone(F.concat(before, "fields.phone_text")).alias("phone"))


@query(f"WITH {SQL_FIELDS} SELECT i AS msg_id, 'đơn ' || i || ' của ' || name || ' [PHONE], ' || street AS masked FROM f")
def p4_p5_mask_phone(spark, sf_dir):
    m = plan.messages(spark, sf_dir)
    said = F.concat(F.lit("đơn "), F.col("idx").cast("string"), F.lit(" của "), "fields.name", F.lit(" sđt: "), "fields.phone_text", F.lit(", "), "fields.street")
    return m.select("msg_id", phone.mask_phone(said).alias("masked"))


_ODD = "'a' || chr(1) || 'b ' || chr(2) || name || chr(1)"


@query(f"WITH {SQL_FIELDS} SELECT i AS msg_id, {_ODD} || ' [PHONE]' || chr(1) || chr(1) || ' mã đơn: 0912345678' AS masked, {_ODD} || '  ' || chr(1) || chr(1) || ' mã đơn: 0912345678' AS removed FROM f")
def p4_p6_control_characters(spark, sf_dir):
    """Texts that hold control characters around a number, and a blocked one."""
    m = plan.messages(spark, sf_dir)
    said = F.concat(F.lit("a\u0001b \u0002"), "fields.name", F.lit("\u0001 "), "fields.phone_text", F.lit("\u0001\u0001 mã đơn: 0912345678"))
    return m.select("msg_id", phone.mask_phone(said).alias("masked"), phone.remove_phone(said).alias("removed"))


@query(f"WITH {SQL_FIELDS} SELECT i AS msg_id, name || ' gọi  nhé' AS rest FROM f")
def p6_remove_phone(spark, sf_dir):
    m = plan.messages(spark, sf_dir)
    return m.select("msg_id", phone.remove_phone(F.concat("fields.name", F.lit(" gọi"), F.lit(" "), "fields.phone_text", F.lit("nhé"))).alias("rest"))


@query(f"WITH {SQL_FIELDS} SELECT i AS msg_id, phone || ',' || '0987654321' AS phones, CAST(2 AS INTEGER) AS phone_count FROM f")
def p7_all_phones(spark, sf_dir):
    m = plan.messages(spark, sf_dir).select("msg_id", phone.all_phones(F.concat("fields.phone_text", F.lit(" hoặc 0987.654.321"))).alias("p"))
    return m.select("msg_id", F.array_join("p", ",").alias("phones"), F.size("p").alias("phone_count"))


@query()
def p4_mask_documents(spark, sf_dir):
    return plan.documents(spark, sf_dir).select("doc_id", F.length(phone.mask_phone(F.col("text"))).alias("masked_chars"), F.size(phone.all_phones(F.col("text"))).alias("phones"))


# ---------------------------------------------------------------- extraction
@query(f"WITH {SQL_HINTS} SELECT i AS msg_id, name FROM hints")
def x1_extract_name(spark, sf_dir):
    m = plan.messages(spark, sf_dir).select("msg_id", text.compact_text(F.col("text")).alias("text"))
    return m.select("msg_id", extract.extract_name(F.col("text")).alias("name"))


@query(f"""WITH {SQL_PLACES} SELECT i AS msg_id,
  CASE WHEN old_province_name LIKE '%Hà Nội%' THEN 'Hà Nội' WHEN old_province_name LIKE '%Hồ Chí Minh%' THEN 'Hồ Chí Minh' ELSE replace(old_province_name, 'Tỉnh ', '') END AS province FROM msg""")
def x2_extract_province(spark, sf_dir):
    m = plan.messages(spark, sf_dir)
    return m.select("msg_id", extract.extract_province(F.concat(F.lit("giao "), "place.ward", F.lit(", "), "place.province")).alias("province"))


@query(f"WITH {SQL_PLACES} SELECT i AS msg_id, old_district_name AS district, CASE WHEN i % 2 = 1 AND old_ward_name LIKE 'Xã %' THEN 'Xã ã ' || substr(old_ward_name, 4) ELSE old_ward_name END AS ward FROM msg")
def x3_x4_extract_district_ward(spark, sf_dir):
    m = plan.messages(spark, sf_dir)
    said = F.concat(F.lit("giao "), text.short_ward(F.col("place.ward"), F.col("idx")), F.lit(", "), text.short_district(F.col("place.district"), F.col("idx")))
    return m.select("msg_id", extract.extract_district(said).alias("district"), extract.extract_ward(said).alias("ward"))


@query(f"WITH {SQL_FIELDS} SELECT i AS msg_id, street, house FROM f")
def x5_x6_extract_street_house(spark, sf_dir):
    m = plan.messages(spark, sf_dir)
    said = F.concat(F.lit("giao sn "), "fields.house", F.lit(" "), "fields.street", F.lit(", cảm ơn"))
    return m.select("msg_id", extract.extract_street(said).alias("street"), extract.extract_house_number(said).alias("house"))


@query(f"WITH {SQL_FIELDS} SELECT i AS msg_id, note FROM f")
def x7_extract_note(spark, sf_dir):
    m = plan.messages(spark, sf_dir)
    return m.select("msg_id", extract.extract_note(F.concat("fields.name", F.lit(" nhận; ghi chú: "), "fields.note")).alias("note"))


@query(f"WITH {SQL_HINTS} SELECT i AS msg_id, name, province, district_hint, ward, street, house_number FROM hints")
def x8_rule_hints(spark, sf_dir):
    m = plan.messages(spark, sf_dir).select("msg_id", text.compact_text(F.col("text")).alias("text"))
    return m.select("msg_id", extract.extract_name(F.col("text")).alias("name"), extract.address_hints(F.col("text")).alias("a")).select("msg_id", "name", "a.*")


@query(f"WITH {SQL_FIELDS} SELECT i AS msg_id, i % 3 > 0 AS is_order FROM f")
def x9_is_likely_order(spark, sf_dir):
    """Every third message is replaced by small talk about its street."""
    m = plan.messages(spark, sf_dir)
    chat = F.concat(F.lit("cảm ơn nhiều nhé, hẹn gặp lại lần "), F.col("idx").cast("string"))
    said = F.when(F.pmod("idx", F.lit(3)) == 0, chat).otherwise(F.col("text"))
    return plan.rule_pass(m.select("msg_id", said.alias("text"))).select("msg_id", "is_order")


@query()
def x9_likely_conversations(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("h", extract.rule_hints(F.col("text")))
    return c.select("conv_id", "turn", extract.is_likely_order(F.col("text"), phone.extract_phone(F.col("text")), F.col("h.address")).alias("is_order"))


@query(f"""WITH {SQL_HINTS}, n AS (SELECT *, (province IS NOT NULL)::INTEGER + (ward IS NOT NULL)::INTEGER + (street IS NOT NULL)::INTEGER + (house_number IS NOT NULL)::INTEGER AS signals FROM hints)
  SELECT i AS msg_id, signals, name IS NOT NULL AND noted AND signals >= 2 AS skip_model FROM n""")
def x10_x11_signals(spark, sf_dir):
    r = plan.rule_pass(plan.messages(spark, sf_dir))
    skip = extract.can_skip_model(F.col("rule.phone"), F.col("rule.name"), F.col("rule.note"), F.col("hints"), True)
    return r.select("msg_id", extract.address_signals(F.col("hints")).alias("signals"), skip.alias("skip_model"))


# ---------------------------------------------------------------- replies
def replies(spark, sf_dir) -> DataFrame:
    """A reply for each message: public or internal shape, inside prose, broken or none, by index."""
    m = plan.messages(spark, sf_dir)
    f, e = F.col("fields"), F.col("expected")
    public = F.to_json(F.struct(f["name"].alias("recipient_name"), F.lit("[PHONE]").alias("phone_number"), f["note"].alias("note"), F.struct(f["house"].alias("address_number"), f["street"].alias("street"), F.col("place.new_ward").alias("municipality"), F.col("place.new_province").alias("sub_region")).alias("address_info")))
    internal = F.to_json(F.struct(f["name"].alias("name"), f["phone"].alias("phone"), F.struct(F.col("place.province").alias("province"), F.col("place.ward").alias("ward")).alias("address")))
    i = F.pmod("idx", F.lit(5))
    text_ = F.when(i == 0, public).when(i == 1, internal).when(i == 2, F.concat(F.lit("Kết quả: "), public, F.lit(" xong"))).when(i == 3, F.lit("không có")).otherwise(F.concat(F.substring(public, 1, 20)))
    return m.select("msg_id", "idx", text_.alias("reply"), e.alias("expected"))


@query(f"WITH {SQL_FIELDS} SELECT i AS msg_id, CASE i % 5 WHEN 3 THEN 'no_json' WHEN 4 THEN 'no_json' ELSE 'ok' END AS status, CASE i % 5 WHEN 0 THEN name WHEN 2 THEN name END AS recipient_name FROM f")
def m1_recover_json(spark, sf_dir):
    r = replies(spark, sf_dir).withColumn("r", reply.recover_json(F.col("reply")))
    return r.select("msg_id", "r.status", F.col("r.order.recipient_name").alias("recipient_name"))


@query(f"WITH {SQL_FIELDS} SELECT i AS msg_id, i % 5 < 3 AS valid FROM f")
def m2_recover_json_safe(spark, sf_dir):
    return replies(spark, sf_dir).select("msg_id", reply.recover_json_safe(F.col("reply")).isNotNull().alias("valid"))


@query(f"""WITH {SQL_PLACES} SELECT i AS msg_id, CASE WHEN i % 5 < 3 THEN name END AS name, CASE WHEN i % 5 = 1 THEN phone END AS phone,
  CASE WHEN i % 5 = 1 THEN old_ward_name WHEN i % 5 IN (0, 2) THEN ward_name END AS ward FROM msg""")
def m3_reply_to_order(spark, sf_dir):
    r = replies(spark, sf_dir).withColumn("o", reply.reply_to_order(reply.recover_json(F.col("reply"))["order"]))
    return r.select("msg_id", "o.name", "o.phone", "o.address.ward")


@query(f"WITH {SQL_FIELDS} SELECT i AS msg_id, CAST(length(street) AS BIGINT) AS score FROM f")
def m4_score_with(spark, sf_dir):
    def scorer(parts):
        for pdf in parts:
            yield pdf.assign(score=pdf["street"].str.len().astype("int64"))[["msg_id", "score"]]

    return reply.score_with(plan.messages(spark, sf_dir).select("msg_id", F.col("fields.street").alias("street")), scorer, "msg_id long, score long")


# ---------------------------------------------------------------- merge
@query(f"WITH {SQL_FIELDS} SELECT i AS msg_id, phone, name, CASE WHEN i % 2 = 0 THEN note ELSE 'model note' END AS note FROM f")
def r1_precedence(spark, sf_dir):
    m = plan.messages(spark, sf_dir)
    even = F.pmod("idx", F.lit(2)) == 0
    rule = F.struct(F.col("fields.phone").alias("phone"), F.lit("khác").alias("name"), F.when(even, F.col("fields.note")).alias("note"))
    model = F.struct(F.lit("0300000000").alias("phone"), F.col("fields.name").alias("name"), F.lit("model note").alias("note"))
    return merge.apply_precedence(m.select("msg_id", rule.alias("rule"), model.alias("model"))).select("msg_id", "phone", "name", "note")


@query(f"""WITH {SQL_PLACES} SELECT i AS msg_id, old_province_name AS province, CASE WHEN i % 2 = 0 THEN old_ward_name ELSE 'Khu Phố Mới' END AS ward, street, house AS house_number FROM msg""")
def r2_merge_hints(spark, sf_dir):
    m = plan.messages(spark, sf_dir)
    even = F.pmod("idx", F.lit(2)) == 0
    none = F.lit(None).cast("string")
    addr = F.struct(none.alias("province"), none.alias("district_hint"), F.when(even, F.lit("p1")).otherwise(F.lit("Khu Phố Mới")).alias("ward"), F.lit("x").alias("street"), F.lit("số 4").alias("house_number"))
    hints = F.struct(F.col("place.province").alias("province"), F.col("place.district").alias("district_hint"), F.col("place.ward").alias("ward"), F.col("fields.street").alias("street"), F.col("fields.house").alias("house_number"))
    return m.select("msg_id", merge.merge_hints(addr, hints).alias("a")).select("msg_id", "a.province", "a.ward", "a.street", "a.house_number")


@query(f"WITH {SQL_FIELDS} SELECT i AS msg_id, house AS house_number, street FROM f")
def r3_fix_address_parts(spark, sf_dir):
    m = plan.messages(spark, sf_dir)
    none = F.lit(None).cast("string")
    whole = F.concat_ws(" ", "fields.house", "fields.street")
    inside = F.col("fields.street").rlike("^(ngõ|hẻm|ngách|đường|phố)") & (F.pmod("idx", F.lit(2)) == 0)
    addr = F.struct(none.alias("province"), none.alias("district_hint"), none.alias("ward"), F.when(~inside, whole).alias("street"), F.when(inside, whole).alias("house_number"))
    return m.select("msg_id", merge.fix_address_parts(addr).alias("a")).select("msg_id", "a.house_number", "a.street")


@query(f"WITH {SQL_PLACES} SELECT i AS msg_id, CASE WHEN position(lower(house) IN lower(street)) > 0 THEN street ELSE house || ' ' || street END || ', ' || old_ward_name || ', ' || old_province_name AS address FROM msg")
def r4_r5_format_address(spark, sf_dir):
    m = plan.messages(spark, sf_dir)
    first = merge.join_street(F.col("fields.house"), F.col("fields.street"))
    return m.select("msg_id", merge.format_address(first, F.col("place.ward"), F.upper("place.ward"), F.col("place.province"), F.lit(" ,")).alias("address"))


# ---------------------------------------------------------------- administrative table
SQL_NEW = f"""{SQL_OLD},
new AS (SELECT province_code, province_name, ward_code, ward_name, min(ord) AS pos, count(*) AS entries FROM old GROUP BY ALL),
state AS (SELECT *, pos % 5 > 0 AS is_merged FROM new)
"""


def partly_merged(spark, sf_dir) -> DataFrame:
    """The new wards, of which every fifth (by its first predecessor) stays as it was."""
    kept = F.pmod("pos", F.lit(5)) == 0
    w = plan.admin_wards(spark, sf_dir)
    return w.withColumns({"is_merged": ~kept, "merged_from_raw": F.when(kept, F.when(F.pmod("pos", F.lit(2)) == 0, "Giữ nguyên hiện trạng")).otherwise(F.col("merged_from_raw"))})


@query(f"WITH {SQL_NEW} SELECT province_name, count(*) AS wards, count(*) FILTER (is_merged) AS merged, count(*) FILTER (NOT is_merged) AS unchanged FROM state GROUP BY province_name")
def g1_g2_g19_merge_totals(spark, sf_dir):
    w = partly_merged(spark, sf_dir)
    p = w.select("province_code", "province_name").distinct()
    units = p.select(F.col("province_code").alias("ma"), F.lit("0").alias("magoc"), F.col("province_name").alias("ten"), F.lit(None).cast("string").alias("truocsapnhap"))
    wards = w.select(F.col("ward_code").alias("ma"), F.col("province_code").alias("magoc"), F.col("ward_name").alias("ten"), F.col("merged_from_raw").alias("truocsapnhap"))
    first = wards.filter("magoc = '00'")
    return admin.merge_totals(admin.assemble_units(units.unionByName(wards), first))


@query(f"WITH {SQL_OLD} SELECT ward_code, count(*) AS entries FROM old GROUP BY ward_code")
def g3_parse_predecessors_v1(spark, sf_dir):
    w = plan.admin_wards(spark, sf_dir)
    return w.select("ward_code", F.size(admin.parse_predecessors_v1(F.col("merged_from_raw"), F.col("province_name"))).cast("long").alias("entries"))


@query(f"WITH {SQL_OLD} SELECT ward_code, old_ward_name, old_district_name, province_name AS old_province_name FROM old")
def g4_g7_parse_predecessors(spark, sf_dir):
    w = plan.admin_wards(spark, sf_dir)
    return w.select("ward_code", F.explode(admin.parse_predecessors(F.col("merged_from_raw"), F.col("province_name"))).alias("e")).select("ward_code", "e.*")


# Sample openings that name no unit, and names without a unit's type.
VAGUE = ("Một phần diện tích", "phần còn lại của", "và phần", "toàn bộ", "12 ấp", "cùng", "hoặc ", "sau khi sắp xếp")


def part_names(spark, sf_dir) -> DataFrame:
    """(ord, part): the old wards' names: bare, with an opening before them, without a type, in small letters, or cut to one letter."""
    i, name = F.pmod("ord", F.lit(5)), F.col("old_ward_name")
    bare = F.regexp_replace(name, "^(Phường|Xã|Thị trấn) ", "")
    part = F.when(i == 0, F.concat_ws(" ", plan._of(VAGUE, F.floor(F.col("ord") / 5)), name)).when(i == 1, bare).when(i == 2, F.lower(bare)).when(i == 3, F.substring(bare, 1, 1)).otherwise(name)
    return plan.old_wards(spark, sf_dir).select("ord", part.alias("part"))


@query(f"WITH {SQL_OLD} SELECT ord, ord % 5 IN (0, 3) AS noise FROM old")
def g5_is_noise(spark, sf_dir):
    return part_names(spark, sf_dir).select("ord", admin.is_noise(F.col("part")).alias("noise"))


@query("SELECT doc_id, length(t) < 2 OR NOT regexp_matches(t, '^\\p{L}') OR regexp_matches(lower(t), '(?i)^(?:" + "|".join(admin.NOISE).replace("\\", "\\") + ")') AS noise FROM (SELECT doc_id, trim(coalesce(text, '')) AS t FROM documents)")
def g5_noise_documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", admin.is_noise(F.col("text")).alias("noise"))


@query(f"WITH {SQL_OLD} SELECT ord, ord % 5 IN (1, 4) AS unit FROM old")
def g6_is_unit_name(spark, sf_dir):
    return part_names(spark, sf_dir).select("ord", admin.is_unit_name(F.col("part")).alias("unit"))


@query(f"""WITH {SQL_NEW} SELECT count(*) AS wards, count(*) FILTER (is_merged) AS merged, CAST(sum(CASE WHEN is_merged AND pos % 7 > 0 THEN entries ELSE 0 END) AS BIGINT) AS entries,
  count(*) FILTER (is_merged AND pos % 7 = 0) AS merged_without_entries FROM state""")
def g8_reparse_totals(spark, sf_dir):
    """Every seventh ward's text is a description without a unit's name."""
    w = partly_merged(spark, sf_dir)
    vague = F.when(F.pmod("pos", F.lit(7)) == 0, "phần còn lại của các xã, 12 ấp").otherwise(F.col("merged_from_raw"))
    return admin.reparse(w.withColumn("merged_from_raw", vague))[1]


def _old_files(spark, sf_dir):
    """Old wards, districts and provinces as the coded tables would hold them; every seventh parent is missing."""
    o = plan.old_wards(spark, sf_dir)
    w = o.select(F.col("ord").cast("string").alias("code"), F.regexp_replace("old_ward_name", "^(Phường|Xã|Thị trấn) ", "").alias("name"), F.col("old_ward_name").alias("name_with_type"), F.when(F.pmod("ord", F.lit(7)) > 0, F.col("old_district_name")).alias("parent_code"), "ord")
    d = o.select(F.col("old_district_name").alias("code"), F.col("old_district_name").alias("name"), F.col("old_district_name").alias("name_with_type"), F.col("old_province_name").alias("parent_code")).distinct()
    p = o.select(F.col("old_province_name").alias("code"), F.col("old_province_name").alias("name"), F.col("old_province_name").alias("name_with_type")).distinct()
    return w, d, p


@query(f"WITH {SQL_OLD} SELECT CAST(ord AS VARCHAR) AS old_ward_code, old_ward_name, CASE WHEN ord % 7 > 0 THEN old_district_name END AS old_district_name, CASE WHEN ord % 7 > 0 THEN old_province_name END AS old_province_name FROM old")
def g9_denormalize_old(spark, sf_dir):
    return admin.denormalize_old(*_old_files(spark, sf_dir)).select("old_ward_code", "old_ward_name", "old_district_name", "old_province_name")


@query(f"WITH {SQL_OLD}, k AS (SELECT {_text('', 'lower(old_ward_name)')} AS key FROM old) SELECT key, count(*) AS entries FROM k GROUP BY key")
def g10_name_index(spark, sf_dir):
    return admin.name_index(admin.denormalize_old(*_old_files(spark, sf_dir)), "full").groupBy("key").agg(F.count(F.lit(1)).alias("entries"))


def classified(spark, sf_dir) -> DataFrame:
    """Predecessors of every new ward, matched against the old wards."""
    old = staged(admin.denormalize_old(*_old_files(spark, sf_dir)), "old-wards")
    w = plan.admin_wards(spark, sf_dir)
    entries = w.select("ward_code", "province_code", F.posexplode(admin.parse_predecessors(F.col("merged_from_raw"), F.col("province_name"))).alias("pos", "e")).select(
        "ward_code", "province_code", "pos", "e.old_ward_name", F.when(F.pmod("pos", F.lit(2)) == 0, F.col("e.old_district_name")).alias("district_hint")
    )
    # every eleventh old ward is asked for by a name that no file has
    gone = plan.old_wards(spark, sf_dir).filter("ord % 11 = 0").select("ward_code", "old_ward_name", "ord").hint("merge")
    entries = entries.join(gone, ["ward_code", "old_ward_name"], "left")
    entries = entries.withColumn("old_ward_name", F.when(F.col("ord").isNotNull(), F.concat(F.lit("Xã Không Có "), F.col("ord").cast("string"))).otherwise(F.col("old_ward_name"))).drop("ord")
    entries = admin.split_compound(entries).withColumn("entry_id", F.concat_ws("/", "ward_code", "pos", "sub"))
    merger = old.filter("old_province_name is not null").select(text.place_name(F.col("old_province_name")).alias("old_province_key")).distinct()
    provinces = w.select("province_code", text.place_name(F.col("province_name")).alias("old_province_key")).distinct()
    merger = merger.hint("merge").join(provinces, "old_province_key")
    cands = admin.lookup_candidates(entries, admin.name_index(old, "full"), admin.name_index(old, "short"))
    tiers = admin.classify_matches(admin.allowed_only(cands, merger))
    return admin.infer_from_siblings(tiers.hint("merge").join(entries.select("entry_id", "ward_code"), "entry_id"))


def _place(c: str) -> str:
    return _text("", f"lower(coalesce({c}, ''))")


SQL_TIERS = f"""{SQL_OLD},
known AS (SELECT ord, old_ward_name, CASE WHEN ord % 7 > 0 THEN old_district_name END AS d, CASE WHEN ord % 7 > 0 THEN old_province_name END AS p FROM old),
entries AS (SELECT ward_code, province_code, pos, old_ward_name, ward_code || '/' || pos || '/0' AS entry_id, CASE WHEN pos % 2 = 0 THEN old_district_name END AS hint,
  CASE WHEN ord % 11 = 0 THEN 'Xã Không Có ' || ord ELSE old_ward_name END AS asked FROM (SELECT *, row_number() OVER (PARTITION BY ward_code ORDER BY ord) - 1 AS pos FROM old)),
mergers AS (SELECT DISTINCT province_code, {_place('province_name')} AS pk FROM old WHERE {_place('province_name')} IN (SELECT {_place('p')} FROM known WHERE p IS NOT NULL)),
cand AS (SELECT e.*, k.ord, k.d, k.p, m.pk IS NOT NULL AS mapped_row, k.ord IS NOT NULL AND m.pk IS NOT NULL AND {_place('k.p')} = m.pk AS ok,
  {_place('hint')} AS hk, {_place('k.d')} AS dk, coalesce(k.d, 'None') || ', ' || coalesce(k.p, 'None') AS label
  FROM entries e LEFT JOIN known k ON {_place('e.asked')} = {_place('k.old_ward_name')} LEFT JOIN mergers m ON m.province_code = e.province_code),
per AS (SELECT entry_id, ward_code, province_code, asked AS old_ward_name, hint AS district_hint, bool_or(mapped_row) AS mapped,
  count(ord) AS na, count(*) FILTER (ok) AS nk, count(*) FILTER (ok AND hk <> '' AND dk = hk) AS nh,
  arg_min({{'d': d, 'p': p}}, ord) AS fa, arg_min({{'d': d, 'p': p}}, ord) FILTER (ok) AS fk, arg_min({{'d': d, 'p': p}}, ord) FILTER (ok AND hk <> '' AND dk = hk) AS fh,
  string_agg(label, '; ' ORDER BY ord) FILTER (ord IS NOT NULL) AS la, string_agg(label, '; ' ORDER BY ord) FILTER (ok) AS lk, string_agg(label, '; ' ORDER BY ord) FILTER (ok AND hk <> '' AND dk = hk) AS lh
  FROM cand GROUP BY ALL),
tier AS (SELECT *, CASE WHEN na = 0 THEN 'not_found' WHEN mapped AND nh = 1 THEN 'district_hint' WHEN mapped AND nh > 1 THEN 'ambiguous_district_hint' WHEN mapped AND na = 1 AND nk = 1 THEN 'exact'
  WHEN mapped AND nk = 1 THEN 'filtered' WHEN mapped AND nk > 1 THEN 'ambiguous_region' WHEN mapped THEN 'not_allowed' WHEN na = 1 THEN 'exact' ELSE 'ambiguous' END AS c0 FROM per),
pick AS (SELECT *, CASE WHEN c0 IN ('district_hint', 'ambiguous_district_hint') THEN fh WHEN mapped AND c0 <> 'not_allowed' THEN fk WHEN NOT mapped THEN fa END AS c,
  coalesce(CASE WHEN c0 = 'ambiguous_district_hint' THEN lh WHEN c0 = 'ambiguous_region' THEN lk WHEN c0 IN ('not_allowed', 'ambiguous') THEN la END, '') AS all_options FROM tier),
sure AS (SELECT ward_code, c.d AS sd, c.p AS sp, count(*) AS n FROM pick WHERE c0 IN {admin.SURE} AND c.d IS NOT NULL AND c.p IS NOT NULL GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER w AS rn, lead(n) OVER w AS nn FROM sure WINDOW w AS (PARTITION BY ward_code ORDER BY n DESC, sd, sp)) WHERE rn = 1 AND n >= 2 AND (nn IS NULL OR n > nn)),
classified AS (SELECT entry_id, province_code, pick.ward_code, old_ward_name, district_hint, all_options, CASE WHEN c0 = 'not_allowed' AND sd IS NOT NULL THEN sd ELSE c.d END AS old_district_name,
  CASE WHEN c0 = 'not_allowed' AND sd IS NOT NULL THEN sp ELSE c.p END AS old_province_name, CASE WHEN c0 = 'not_allowed' AND sd IS NOT NULL THEN 'inferred_from_siblings' ELSE c0 END AS conf
  FROM pick LEFT JOIN top ON pick.ward_code = top.ward_code)
"""


@query(f"WITH {SQL_TIERS} SELECT * FROM classified")
def g11_g15_classify_matches(spark, sf_dir):
    return classified(spark, sf_dir).withColumn("all_options", F.array_join("all_options", "; "))


@query(f"WITH {SQL_TIERS} SELECT conf, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 4) AS share FROM classified GROUP BY conf")
def g16_tier_stats(spark, sf_dir):
    return admin.tier_stats(classified(spark, sf_dir))


@query(f"WITH {SQL_TIERS} SELECT ward_code, old_ward_name, conf, CASE WHEN all_options = '' THEN 0 ELSE len(string_split(all_options, '; ')) END AS options FROM classified WHERE conf LIKE '%ambiguous%' OR conf = 'not_allowed'")
def g17_ambiguous_audit(spark, sf_dir):
    return admin.ambiguous_audit(classified(spark, sf_dir)).select("ward_code", "old_ward_name", "conf", F.size("all_options").alias("options"))


@query(f"WITH {SQL_TIERS} SELECT ward_code, old_ward_name FROM classified WHERE conf = 'not_found'")
def g18_not_found_audit(spark, sf_dir):
    return admin.not_found_audit(classified(spark, sf_dir)).select("ward_code", "old_ward_name")


# ---------------------------------------------------------------- resolution
def records(spark, sf_dir) -> DataFrame:
    return staged(resolve.flatten_wards(plan.admin_wards(spark, sf_dir)), "records")


@query(f"WITH {SQL_OLD} SELECT 'new' AS source, province_name, count(DISTINCT ward_code) AS n FROM old GROUP BY province_name UNION ALL SELECT 'old', province_name, count(*) FROM old GROUP BY province_name")
def n1_flatten_admin(spark, sf_dir):
    return records(spark, sf_dir).groupBy("source", "province_name").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {SQL_OLD}, p AS (SELECT DISTINCT {_place('old_ward_name')} AS a, {_place('ward_name')} AS b FROM old)," + """
cell AS (SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: 0) AS row FROM p
  UNION ALL SELECT a, b, i + 1, list_reduce(list_transform(range(1, length(b) + 1), lambda j: [CASE WHEN substr(a, i + 1, 1) = substr(b, CAST(j AS INTEGER), 1) THEN row[CAST(j AS INTEGER)] + 1 ELSE row[CAST(j + 1 AS INTEGER)] END]),
    lambda acc, v: list_append(acc, greatest(v[1], acc[len(acc)])), [0]) FROM cell WHERE i < length(a))
SELECT a, b, round(200.0 * row[len(row)] / (length(a) + length(b)), 4) AS ratio FROM cell WHERE i = length(a)""")
def n2_indel_ratio(spark, sf_dir):
    """Names of old wards and of the new wards that took them in."""
    from orderloom.functions.fuzzy import indel_ratio

    pairs = plan.old_wards(spark, sf_dir).select(text.place_name(F.col("old_ward_name")).alias("a"), text.place_name(F.col("ward_name")).alias("b")).distinct()
    return pairs.select("a", "b", F.round(indel_ratio(F.col("a"), F.col("b")), 4).alias("ratio"))


SQL_RECORDS = f"""{SQL_OLD},
rec AS (SELECT province_name, province_name AS p, '' AS d, ward_name AS w FROM old UNION SELECT province_name, old_province_name, old_district_name, old_ward_name FROM old),
keyed AS (SELECT province_name, {_key_sql("lower(" + _text('', 'p') + ")")} AS pk, {_key_sql("lower(" + _text('', 'd') + ")")} AS dk, {_key_sql("lower(" + _text('', 'w') + ")")} AS wk FROM rec)
"""


def _bare_key(c: str) -> str:
    return _key_sql("lower(" + _text("", f"coalesce({c}, '')") + ")")


def _said_key(c: str) -> str:
    return _key_sql(f"lower(coalesce({c}, ''))")


def _mix_sql(p: str, d: str, w: str, hp: str, hd: str) -> str:
    """The weighted score of three levels."""
    return f"CASE WHEN {hp} AND {hd} THEN {p} * 0.42e0 + {d} * 0.28e0 + {w} * 0.30e0 WHEN {hp} THEN {p} * 0.55e0 + {w} * 0.45e0 WHEN {hd} THEN {d} * 0.38e0 + {w} * 0.62e0 ELSE {w} END"


_SORTED = "array_to_string(list_sort(string_split({}, ' ')), ' ')"
#: Ratios of pairs ``b`` (q, r) by the longest common subsequence: of the keys, and of their sorted words once that is 60.
SQL_SCORES = f"""
jobs AS (SELECT q AS x, r AS y FROM b UNION SELECT {_SORTED.format('q')}, {_SORTED.format('r')} FROM b),
cell AS (SELECT x, y, 0 AS i, list_transform(range(0, length(y) + 1), lambda v: 0) AS row FROM jobs
  UNION ALL SELECT x, y, i + 1, list_reduce(list_transform(range(1, length(y) + 1), lambda j: [CASE WHEN substr(x, i + 1, 1) = substr(y, CAST(j AS INTEGER), 1) THEN row[CAST(j AS INTEGER)] + 1 ELSE row[CAST(j + 1 AS INTEGER)] END]),
    lambda acc, v: list_append(acc, greatest(v[1], acc[len(acc)])), [0]) FROM cell WHERE i < length(x)),
ratios AS (SELECT x, y, 200e0 * row[len(row)] / (length(x) + length(y)) AS v FROM cell WHERE i = length(x)),
sc AS (SELECT q, r, CASE WHEN q = r THEN 100e0 WHEN one.v >= 60 THEN two.v ELSE one.v END AS s FROM b JOIN ratios one ON one.x = q AND one.y = r JOIN ratios two ON two.x = {_SORTED.format('q')} AND two.y = {_SORTED.format('r')})
"""


@query(f"WITH RECURSIVE {SQL_RECORDS}, k AS (SELECT DISTINCT wk FROM keyed WHERE wk <> ''), b AS (SELECT a.wk AS q, c.wk AS r FROM k a, k c), {SQL_SCORES} SELECT q, r, round(s, 4) AS score FROM sc WHERE s >= 72")
def n3_n4_field_scores(spark, sf_dir):
    r = records(spark, sf_dir).select(F.col("ward_key").alias("k"))
    keys = [r.select(F.lit("ward").alias("level"), F.col("k").alias(side)) for side in ("q", "r")]
    return resolve.key_pairs(*keys, {"ward": 72.0}).select("q", "r", F.round("score", 4).alias("score"))


@query(f"""WITH {SQL_RECORDS}, lv AS (SELECT dk AS key, 0 AS level, count(DISTINCT pk) AS n, bool_or(pk IN ('ha noi', 'ho chi minh')) AS city, min(province_name) AS province_name FROM keyed WHERE dk <> '' GROUP BY dk
  UNION ALL SELECT wk, 1, count(DISTINCT pk), bool_or(pk IN ('ha noi', 'ho chi minh')), min(province_name) FROM keyed WHERE wk <> '' GROUP BY wk)
  SELECT key, arg_min(province_name, level) AS province_name FROM lv WHERE n = 1 AND city GROUP BY key""")
def n6_unique_municipalities(spark, sf_dir):
    return resolve.unique_municipalities(records(spark, sf_dir)).select("key", "province_name")


_LEVELS = ("p", "d", "w")
#: The flattened records in their order, with keys.
SQL_FLAT = f"""
pool AS (SELECT *, min(ord) OVER (PARTITION BY ward_code) AS pos, row_number() OVER (PARTITION BY ward_code ORDER BY ord) AS opos FROM old),
rec0 AS (SELECT DISTINCT 'new' AS source, province_name, ward_name, CAST(NULL AS VARCHAR) AS od, province_code, ward_code, pos, 0 AS opos, province_name AS p, '' AS d, ward_name AS w FROM pool
  UNION ALL SELECT 'old', province_name, ward_name, old_district_name, province_code, ward_code, pos, opos, old_province_name, old_district_name, old_ward_name FROM pool),
rec AS (SELECT *, row_number() OVER (ORDER BY province_code, pos, opos) AS no, {", ".join(f"{_bare_key(c)} AS r{c}, {_said_key(c)} AS rt{c}" for c in _LEVELS)} FROM rec0)
"""


def said_places(spark, sf_dir) -> DataFrame:
    """What a message might name as its municipality: a district, a ward with a letter lost, a ward's words turned round."""
    k = F.col("ord")
    turned = F.concat_ws(" ", F.lit("Phường"), plan._of(plan.SECOND, F.floor(k / 11)), plan._of(plan.FIRST, k))
    lost = F.concat(F.substring("old_ward_name", 1, 5), F.substring("old_ward_name", 7, 100))
    return plan.old_wards(spark, sf_dir).select("ord", F.when(k % 3 == 0, F.col("old_district_name")).when(k % 3 == 1, lost).otherwise(turned).alias("said"))


@query(f"""WITH RECURSIVE {SQL_OLD}, {SQL_FLAT},
lv AS ({" UNION ALL ".join(f"SELECT r{c} AS key, {i} AS level, count(DISTINCT rp) AS n, arg_min(province_name, no) FILTER (rp IN ('ha noi', 'ho chi minh')) AS province_name, min(no) AS no FROM rec WHERE r{c} <> '' GROUP BY r{c}" for i, c in enumerate("dw"))}),
u AS (SELECT key, arg_min(province_name, level) AS province_name, arg_min(no, level) AS no FROM lv WHERE n = 1 AND province_name IS NOT NULL GROUP BY key),
said AS (SELECT ord, CASE ord % 3 WHEN 0 THEN old_district_name WHEN 1 THEN substr(old_ward_name, 1, 5) || substr(old_ward_name, 7, 100) ELSE 'Phường ' || {_of(plan.SECOND, 'ord // 11')} || ' ' || {_of(plan.FIRST, 'ord')} END AS said FROM old),
k AS (SELECT ord, said, {_bare_key('said')} AS q FROM said),
b AS (SELECT DISTINCT q, key AS r FROM k, u WHERE q <> ''),
{SQL_SCORES},
best AS (SELECT q, province_name FROM b JOIN ratios ON x = q AND y = r JOIN u ON u.key = r WHERE v >= 88 QUALIFY row_number() OVER (PARTITION BY q ORDER BY q = r DESC, v DESC, no) = 1)
SELECT ord, said, province_name AS inferred FROM k LEFT JOIN best ON best.q = k.q""")
def n7_infer_province(spark, sf_dir):
    return resolve.infer_province(said_places(spark, sf_dir), "said", resolve.unique_municipalities(records(spark, sf_dir)))


def addresses(spark, sf_dir) -> DataFrame:
    """An address for each message: as given, accentless, with a typo, without province, or without ward."""
    m = plan.messages(spark, sf_dir)
    i = F.pmod("idx", F.lit(7))
    ward = F.col("place.ward")
    typo = F.concat(F.substring(ward, 1, 4), F.substring(ward, 6, 100))
    return m.select(
        F.col("msg_id").alias("addr_id"), F.when(i != 3, F.col("place.province")).alias("province"), F.when(i != 4, F.col("place.district")).alias("district_hint"),
        F.when(i == 1, text.strip_accents(ward)).when(i == 2, typo).when(i == 5, F.lit(None).cast("string")).otherwise(ward).alias("ward"),
        F.col("fields.street").alias("street"), F.when(i != 6, F.col("fields.house")).alias("house_number"),
    )


def _ranked_sql(addr: str, places: str = SQL_PLACES) -> str:
    """Every distinct address key against every record, ranked: qp, qd, qw, tp, td, tw (keys), the record, score, ties, rank."""
    return f"""RECURSIVE {places}, {SQL_FLAT},
addr AS ({addr}),
asked AS (SELECT i, p, d, w, {", ".join(f"{_bare_key(c)} AS q{c}, {_said_key(c)} AS t{c}" for c in _LEVELS)} FROM addr),
q AS (SELECT DISTINCT qp, tp, qd, td, qw, tw FROM asked WHERE w IS NOT NULL),
b AS ({" UNION ".join(f"SELECT {x}{c} AS q, {y}{c} AS r FROM (SELECT DISTINCT {x}{c} FROM q WHERE {x}{c} <> ''), (SELECT DISTINCT {y}{c} FROM rec WHERE {y}{c} <> '')" for c in _LEVELS for x, y in (("q", "r"), ("t", "rt")))}),
{SQL_SCORES},
hit AS (SELECT q.*, rec.*, CASE WHEN qp = '' THEN 100e0 ELSE sp.s END AS ps, CASE WHEN qd = '' THEN 100e0 ELSE coalesce(sd.s, 0e0) END AS ds, CASE WHEN qw = '' THEN 100e0 ELSE sw.s END AS ws
  FROM q JOIN rec ON true LEFT JOIN sc sw ON sw.q = qw AND sw.r = rw LEFT JOIN sc sp ON sp.q = qp AND sp.r = rp LEFT JOIN sc sd ON sd.q = qd AND sd.r = rd
  WHERE (qw = '' OR sw.s >= 72) AND (qp = '' OR sp.s >= 78) AND (qd = '' OR rd = '' OR sd.s >= 72)),
tied AS (SELECT hit.*, round({_mix_sql('ps', 'ds', 'ws', "qp <> ''", "qd <> ''")}, 2) AS score, (tp = rtp)::INTEGER + CASE WHEN td <> '' THEN (td = rtd)::INTEGER ELSE 0 END + (tw = rtw)::INTEGER AS exact_matches,
  {", ".join(f"CASE WHEN t{c} = '' OR t{c} = rt{c} THEN 100e0 WHEN rt{c} = '' THEN 0e0 ELSE x{c}.s END AS z{c}" for c in _LEVELS)}
  FROM hit {" ".join(f"LEFT JOIN sc x{c} ON x{c}.q = t{c} AND x{c}.r = rt{c}" for c in _LEVELS)}),
full_ AS (SELECT *, {_mix_sql('zp', 'zd', 'zw', "tp <> ''", "td <> ''")} AS tie_score FROM tied),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qp, tp, qd, td, qw, tw ORDER BY score DESC, exact_matches DESC, tie_score DESC, od IS NULL, source <> 'new', no) AS rank FROM full_)
"""


SQL_RANKED = _ranked_sql(f"""SELECT i, CASE WHEN i % 7 <> 3 THEN old_province_name END AS p, CASE WHEN i % 7 <> 4 THEN old_district_name END AS d,
  CASE i % 7 WHEN 1 THEN {_text('', 'old_ward_name')} WHEN 2 THEN substr(old_ward_name, 1, 4) || substr(old_ward_name, 6, 100) WHEN 5 THEN NULL ELSE old_ward_name END AS w FROM msg""")
BLANK_WARDS = ("Phường", "xã", "TT.", "Thị trấn")


@query(f"""WITH {_ranked_sql(f"SELECT ord AS i, CASE WHEN ord % 3 > 0 THEN old_province_name END AS p, CASE WHEN ord % 2 = 0 THEN old_district_name END AS d, {_of(BLANK_WARDS, 'ord')} AS w FROM old", SQL_OLD)}
SELECT tp AS qt_province, td AS qt_district, tw AS qt_ward, CAST(rank AS INTEGER) AS rank, province_name, ward_name, source, score, exact_matches, round(tie_score, 4) AS tie_score FROM ranked WHERE rank <= 5""")
def n8_blank_wards(spark, sf_dir):
    """Addresses whose ward is an administrative type alone, with and without province and district."""
    k = F.col("ord")
    said = plan.old_wards(spark, sf_dir).select(F.when(k % 3 > 0, F.col("old_province_name")).alias("province"), F.when(k % 2 == 0, F.col("old_district_name")).alias("district_hint"), plan._of(BLANK_WARDS, k).alias("ward"))
    ranked = resolve.first_candidates(resolve.query_keys(said.distinct()), records(spark, sf_dir))
    return ranked.select("qt_province", "qt_district", "qt_ward", "rank", "province_name", "ward_name", "source", "score", "exact_matches", F.round("tie_score", 4).alias("tie_score"))


@query(f"""WITH {SQL_RANKED} SELECT qp AS q_province, qd AS q_district, qw AS q_ward, tw AS qt_ward, CAST(rank AS INTEGER) AS rank, province_name, ward_name, source, score, exact_matches, round(tie_score, 4) AS tie_score FROM ranked WHERE rank <= 5""")
def n8_n12_candidates(spark, sf_dir):
    spellings = addresses(spark, sf_dir).filter("ward is not null").select(*resolve.SPELLING).distinct()
    ranked = resolve.first_candidates(resolve.query_keys(staged(spellings, "spellings")), records(spark, sf_dir))
    return ranked.select("q_province", "q_district", "q_ward", "qt_ward", "rank", "province_name", "ward_name", "source", "score", "exact_matches", F.round("tie_score", 4).alias("tie_score"))


@query(f"""WITH {SQL_RANKED}, top AS (SELECT * FROM ranked WHERE rank <= 5), best AS (SELECT * FROM top WHERE rank = 1),
others AS (SELECT b.qp, b.tp, b.qd, b.td, b.qw, b.tw, count(*) AS n, bool_or(t.rank > 1 AND t.score >= b.score - 0.01 AND (t.province_name <> b.province_name OR t.ward_name <> b.ward_name)) AS vague
  FROM best b JOIN top t USING (qp, tp, qd, td, qw, tw) GROUP BY ALL),
f1 AS (SELECT i, house FROM msg),
j AS (SELECT asked.*, f1.house, b.province_name AS bp, b.ward_name AS bw, b.score, b.source, o.n, o.vague, b.score IS NOT NULL AS found FROM asked JOIN f1 USING (i)
  LEFT JOIN best b ON asked.w IS NOT NULL AND b.qp = asked.qp AND b.tp = asked.tp AND b.qd = asked.qd AND b.td = asked.td AND b.qw = asked.qw AND b.tw = asked.tw
  LEFT JOIN others o ON asked.w IS NOT NULL AND o.qp = asked.qp AND o.tp = asked.tp AND o.qd = asked.qd AND o.td = asked.td AND o.qw = asked.qw AND o.tw = asked.tw)
SELECT i AS addr_id, CASE WHEN found THEN bp ELSE p END AS province, CASE WHEN found THEN bw ELSE w END AS ward, found AND score >= 84 AND NOT vague AS is_normalized, CASE WHEN found THEN round(score / 100, 4) ELSE 0e0 END AS confidence,
  CASE WHEN found THEN CASE source WHEN 'new' THEN 'new_address' ELSE 'old_address_mapping' END END AS matched_by,
  array_to_string(list_filter([CASE WHEN w IS NULL THEN 'missing_ward' END, CASE WHEN w IS NOT NULL AND NOT found THEN 'admin_normalization_not_found' END, CASE WHEN found AND score < 84 THEN 'low_admin_match_confidence' END,
    CASE WHEN found AND vague THEN 'ambiguous_admin_match' END, CASE WHEN found AND i % 7 = 6 THEN 'missing_house_number' END], lambda x: x IS NOT NULL), ',') AS warnings, CAST(coalesce(n, 0) AS INTEGER) AS n_candidates FROM j""")
def n14_normalize_addresses(spark, sf_dir):
    out = resolve.resolve_records(addresses(spark, sf_dir), records(spark, sf_dir))
    return out.select("addr_id", "resolved.province", "resolved.ward", "resolved.is_normalized", "resolved.confidence", "resolved.matched_by", F.array_join("resolved.warnings", ",").alias("warnings"), F.size("resolved.candidates").alias("n_candidates"))


@query()
def r6_r8_parse_messages(spark, sf_dir):
    out = plan.parse_messages(plan.messages(spark, sf_dir), records(spark, sf_dir))
    return out.select("msg_id", "recipient_name", "phone_number", "note", "address_raw", "address_new", "address_info.*")


@query()
def r6_r8_parse_with_replies(spark, sf_dir):
    model = replies(spark, sf_dir).select("msg_id", reply.reply_to_order(reply.recover_json(F.col("reply"))["order"]).alias("model"))
    out = plan.parse_messages(plan.messages(spark, sf_dir), records(spark, sf_dir), model)
    return out.select("msg_id", "recipient_name", "phone_number", "note", "address_raw", "address_new", "address_info.*")


# ---------------------------------------------------------------- scoring
def predictions(spark, sf_dir) -> DataFrame:
    """Expected and predicted orders of two runs: fields fail by index, one row in eleven as a whole."""
    m = plan.messages(spark, sf_dir)
    e = F.col("expected")
    runs = m.withColumn("run", F.explode(F.array(F.lit("a"), F.lit("b"))))
    i = F.col("idx") + F.when(F.col("run") == "b", 1).otherwise(0)
    out = F.struct(
        F.when(F.pmod(i, F.lit(3)) > 0, e["recipient_name"]).alias("recipient_name"), F.when(F.pmod(i, F.lit(5)) > 0, e["phone_number"]).otherwise(F.lit("0900000000")).alias("phone_number"),
        F.when(F.pmod(i, F.lit(4)) > 0, e["note"]).otherwise(F.concat(e["note"], F.lit(" nhé"))).alias("note"), e["address_new"].alias("address_new"), e["address_info"].alias("address_info"),
    )
    return runs.select(
        "run", F.col("msg_id").alias("id"), F.when(F.pmod("idx", F.lit(4)) == 0, "new").otherwise("old").alias("category"), (F.pmod(i * 7919, F.lit(5000)) / 1000.0 + 0.5).alias("latency_seconds"),
        (F.pmod(i, F.lit(11)) > 0).alias("ok"), F.col("text").alias("input"), e.alias("expected"), out.alias("prediction"), F.col("idx").alias("seq"),
    )


SQL_PRED = f"""{SQL_PLACES},
pred AS (SELECT run, i AS id, i + (run = 'b')::INTEGER AS j, regexp_replace(name, '^(chị|anh|cô|bạn|chú) ', '') AS en, phone AS ep, note AS eo, province_name AS pr, ward_name AS wa, street AS st, house AS ho FROM msg, (VALUES ('a'), ('b')) r(run)),
ok AS (SELECT * FROM pred WHERE j % 11 > 0)
"""


#: Each scored cell: run, field, both sides as the scorer sees them, and the words that they share.
SQL_CELLS = f"""{SQL_PRED},
cells AS (SELECT run, id, unnest([{{'field': 'name', 'e': lower(en), 'p': CASE WHEN j % 3 > 0 THEN lower(en) ELSE '' END}}, {{'field': 'phone', 'e': ep, 'p': CASE WHEN j % 5 > 0 THEN ep ELSE '0900000000' END}},
  {{'field': 'note', 'e': lower(eo), 'p': CASE WHEN j % 4 > 0 THEN lower(eo) ELSE lower(eo) || ' nhé' END}}, {{'field': 'address.province', 'e': lower(pr), 'p': lower(pr)}}, {{'field': 'address.ward', 'e': lower(wa), 'p': lower(wa)}},
  {{'field': 'address.street', 'e': lower(st), 'p': lower(st)}}, {{'field': 'address.house_number', 'e': lower(ho), 'p': lower(ho)}}], recursive := true) FROM ok),
f1 AS (SELECT *, CASE WHEN e = p THEN 1.0 WHEN e = '' OR p = '' THEN 0.0 WHEN starts_with(p, e || ' ') THEN 2.0 * len(string_split(e, ' ')) / (len(string_split(e, ' ')) + len(string_split(p, ' '))) ELSE 0.0 END AS f FROM cells),
counts AS (SELECT run, field, count(*) FILTER (e = p) AS exact_count, count(*) FILTER (e = p AND e <> '') AS tp, count(*) FILTER (e <> p AND p <> '') AS fp, count(*) FILTER (e <> p AND e <> '') AS fn, count(*) AS total, avg(f) AS tf FROM f1 GROUP BY run, field),
rates AS (SELECT *, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS p, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS r FROM counts),
metrics AS (SELECT run, field, round(exact_count / CAST(total AS DOUBLE), 4) AS exact_accuracy, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1,
  round(tf, 4) AS token_f1_avg, exact_count, total FROM rates)
"""


@query(f"WITH {SQL_CELLS} SELECT run, field, exact_count, total FROM counts")
def e1_e3_exact_fields(spark, sf_dir):
    f = score.to_fields(predictions(spark, sf_dir)).filter("ok")
    return f.groupBy("run", "field").agg(F.count_if(score.exact(F.col("expected"), F.col("predicted"))).alias("exact_count"), F.count(F.lit(1)).alias("total"))


@query(f"WITH {SQL_CELLS} SELECT run, field, exact_count, total FROM counts")
def e1_mixed_shapes(spark, sf_dir):
    """Predictions as JSON text, in the public shape or, for every other message, in the internal one."""
    p = predictions(spark, sf_dir)
    said, info = F.col("prediction"), F.col("prediction.address_info")
    place = F.struct(info["sub_region"].alias("province"), info["municipality"].alias("ward"), info["street"].alias("street"), info["address_number"].alias("house_number"))
    inner = F.struct(said["recipient_name"].alias("name"), said["phone_number"].alias("phone"), said["note"].alias("note"), place.alias("address"))
    text = F.when(F.pmod("id", F.lit(2)) == 0, F.to_json(inner)).otherwise(F.to_json(said))
    f = score.json_fields(p.withColumns({"expected": F.to_json("expected"), "prediction": text})).filter("ok")
    return f.groupBy("run", "field").agg(F.count_if(score.exact(F.col("expected"), F.col("predicted"))).alias("exact_count"), F.count(F.lit(1)).alias("total"))


@query(f"WITH {SQL_CELLS} SELECT run, field, tp, fp, fn FROM counts")
def e4_confusion(spark, sf_dir):
    return score.confusion(score.to_fields(predictions(spark, sf_dir)).filter("ok"), "run", "field").select("run", "field", "tp", "fp", "fn")


@query(f"WITH {SQL_CELLS} SELECT * FROM metrics")
def e5_e7_field_metrics(spark, sf_dir):
    return score.field_metrics(predictions(spark, sf_dir))


@query("""WITH t AS (SELECT conv_id, turn, lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS s FROM conversations),
p AS (SELECT a.conv_id, a.turn, list_filter(string_split(a.s, ' '), lambda w: w <> '') AS e, list_filter(string_split(b.s, ' '), lambda w: w <> '') AS p FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
ew AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(e) AS w FROM p) GROUP BY ALL), pw AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(p) AS w FROM p) GROUP BY ALL),
c AS (SELECT conv_id, turn, sum(least(ew.n, pw.n)) AS shared FROM ew JOIN pw USING (conv_id, turn, w) GROUP BY ALL)
SELECT p.conv_id, p.turn, round(CASE WHEN len(e) = 0 AND len(p) = 0 THEN 1.0 ELSE 2.0 * coalesce(shared, 0) / (len(e) + len(p)) END, 6) AS f1 FROM p LEFT JOIN c ON p.conv_id = c.conv_id AND p.turn = c.turn""")
def e6_token_f1(spark, sf_dir):
    d, b = read(spark, sf_dir, "conversations"), read(spark, sf_dir, "conversations")
    nxt = b.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return d.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(score.token_f1(F.col("text"), F.col("reply")), 6).alias("f1"))


@query(f"WITH {SQL_PRED} SELECT run, count(*) FILTER (j % 3 > 0 AND j % 5 > 0 AND j % 4 > 0) AS exact_count, count(*) AS total, round(count(*) FILTER (j % 3 > 0 AND j % 5 > 0 AND j % 4 > 0) / CAST(count(*) AS DOUBLE), 4) AS accuracy FROM ok GROUP BY run")
def e8_full_exact(spark, sf_dir):
    return score.full_exact(predictions(spark, sf_dir))


def event_runs(spark, sf_dir) -> DataFrame:
    """A run for each type of event, of which one in eleven fails, and one in which all fail."""
    e = read(spark, sf_dir, "events")
    cols = F.col("event_id").alias("id"), F.col("value").alias("latency_seconds")
    ok = F.pmod("event_id", F.lit(11)) > 0
    runs = e.select(F.col("event_type").alias("run"), *cols, ok.alias("ok"))
    return runs.unionByName(e.filter(~ok).select(F.lit("down").alias("run"), *cols, F.lit(False).alias("ok")))


SQL_RUNS = "WITH ev AS (SELECT event_type AS run, value, event_id % 11 > 0 AS ok FROM events UNION ALL SELECT 'down', value, false FROM events WHERE event_id % 11 = 0) "


@query(SQL_RUNS + """SELECT run, coalesce(round(avg(value) FILTER (ok), 4), 0) AS mean, coalesce(round(quantile_cont(CAST(value AS DOUBLE), 0.5) FILTER (ok), 4), 0) AS p50, coalesce(round(quantile_cont(CAST(value AS DOUBLE), 0.95) FILTER (ok), 4), 0) AS p95,
  coalesce(round(quantile_cont(CAST(value AS DOUBLE), 0.99) FILTER (ok), 4), 0) AS p99, coalesce(round(min(value) FILTER (ok), 4), 0) AS min, coalesce(round(max(value) FILTER (ok), 4), 0) AS max FROM ev GROUP BY run""")
def e9_e10_latency_summary(spark, sf_dir):
    return score.latency_summary(event_runs(spark, sf_dir))


@query(SQL_RUNS + "SELECT run, coalesce(round(count(*) FILTER (ok) * 60 / sum(value) FILTER (ok), 4), 0) AS orders_per_minute, round(count(*) FILTER (ok) / 3600.0 * 60, 4) AS orders_per_minute_wall FROM ev GROUP BY run")
def e11_throughput(spark, sf_dir):
    return score.throughput(event_runs(spark, sf_dir), 3600.0)


@query(SQL_RUNS + "SELECT run, count(*) AS total, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed FROM ev GROUP BY run")
def e12_run_summary(spark, sf_dir):
    return score.run_summary(event_runs(spark, sf_dir))


@query(f"WITH {SQL_FIELDS} SELECT count(*) AS total, count(*) FILTER (i % 5 < 3) AS valid, round(count(*) FILTER (i % 5 < 3) / CAST(count(*) AS DOUBLE), 4) AS json_valid_rate FROM f")
def e13_json_valid_rate(spark, sf_dir):
    return score.json_valid_rate(replies(spark, sf_dir).withColumn("parsed", reply.recover_json_safe(F.col("reply"))))


def label_fields(spark, sf_dir) -> DataFrame:
    """Labels as expectations and a length rule as prediction; not every document is labelled."""
    d, lab = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    both = d.join(lab, "doc_id", "left")
    guess = F.when(F.col("n_chars") > 500, "1").when(F.col("n_chars") > 100, "0")
    cells = F.array(F.struct(F.lit("quality").alias("field"), F.col("quality").cast("string").alias("expected"), guess.alias("predicted")), F.struct(F.lit("toxic").alias("field"), F.col("toxic").cast("string").alias("expected"), F.lit("0").alias("predicted")))
    return both.select("doc_id", F.explode(cells).alias("c")).select("doc_id", "c.*")


SQL_LABELS = """c AS (SELECT 'quality' AS field, CAST(quality AS VARCHAR) AS e, CASE WHEN n_chars > 500 THEN '1' WHEN n_chars > 100 THEN '0' END AS p FROM documents LEFT JOIN labels USING (doc_id)
  UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), '0' FROM documents LEFT JOIN labels USING (doc_id)),
o AS (SELECT field, count(*) AS total, count(*) FILTER (e IS NOT DISTINCT FROM p) AS exact, count(*) FILTER (e IS NULL AND p IS NOT NULL) AS hallucinated, count(*) FILTER (e IS NOT NULL AND p IS NULL) AS missed FROM c GROUP BY field)"""


@query(f"WITH {SQL_LABELS} SELECT *, round(exact / CAST(total AS DOUBLE), 4) AS accuracy FROM o")
def e14_null_outcomes(spark, sf_dir):
    return score.null_outcomes(label_fields(spark, sf_dir))


_NOT_READ = "i % 5 = 4"
_EVAL_CELLS = (  # field, truth, prediction
    ("recipient_name", "CASE WHEN i % 6 > 0 THEN who END", "CASE WHEN i % 6 > 0 THEN upper(who) || chr(9) ELSE 'x' END"), ("phone_number", "'[PHONE]'", "CASE WHEN i % 3 > 0 THEN '[phone] ' END"),
    ("note", "CASE WHEN i % 4 > 0 THEN note END", "CASE WHEN i % 4 > 0 THEN chr(10) || note END"), ("address_raw", "raw", "raw || '.'"), ("address_info.address_number", "house", "house"), ("address_info.street", "street", "NULL"),
    ("address_info.neighborhood", "NULL", "CASE WHEN i % 7 = 0 THEN ward_name END"), ("address_info.municipality", "ward_name", "ward_name"), ("address_info.sub_region", "province_name", "'  ' || upper(province_name)"), ("address_info.country", "'VNM'", "'vnm'"),
)


@query(f"""WITH {SQL_PLACES}, t AS (SELECT *, regexp_replace(name, '^(chị|anh|cô|bạn|chú) ', '') AS who, house || ' ' || street || ', ' || ward_name || ', ' || province_name AS raw FROM msg WHERE NOT ({_NOT_READ})),
c AS ({" UNION ALL ".join(f"SELECT '{f}' AS field, trim(lower({e}), ' ' || chr(9) || chr(10)) AS e, trim(lower({p}), ' ' || chr(9) || chr(10)) AS p FROM t" for f, e, p in _EVAL_CELLS)})
SELECT field, count(*) AS total, count(*) FILTER (e IS NOT DISTINCT FROM p) AS exact, count(*) FILTER (e IS NULL AND p IS NOT NULL) AS hallucinated, count(*) FILTER (e IS NOT NULL AND p IS NULL) AS missed,
  round(count(*) FILTER (e IS NOT DISTINCT FROM p) / CAST(count(*) AS DOUBLE), 4) AS accuracy FROM c GROUP BY field""")
def e14_ten_fields(spark, sf_dir):
    """Responses against predictions that differ by index, by case, by white space; one reply in five cannot be read."""
    m = plan.messages(spark, sf_dir)
    e, i, none = F.col("expected"), F.col("idx"), F.lit(None).cast("string")
    info = e["address_info"]
    truth = F.struct(F.when(F.pmod(i, F.lit(6)) > 0, e["recipient_name"]).alias("recipient_name"), F.lit("[PHONE]").alias("phone_number"), F.when(F.pmod(i, F.lit(4)) > 0, e["note"]).alias("note"), e["address_new"].alias("address_raw"), info.alias("address_info"))
    guess = F.struct(
        F.when(F.pmod(i, F.lit(6)) > 0, F.concat(F.upper(e["recipient_name"]), F.lit("\t"))).otherwise("x").alias("recipient_name"), F.when(F.pmod(i, F.lit(3)) > 0, "[phone] ").alias("phone_number"),
        F.when(F.pmod(i, F.lit(4)) > 0, F.concat(F.lit("\n"), e["note"])).alias("note"), F.concat(e["address_new"], F.lit(".")).alias("address_raw"),
        F.struct(
            info["address_number"].alias("address_number"), none.alias("street"), F.when(F.pmod(i, F.lit(7)) == 0, info["municipality"]).alias("neighborhood"), info["municipality"].alias("municipality"),
            F.concat(F.lit("  "), F.upper(info["sub_region"])).alias("sub_region"), F.lit("vnm").alias("country"),
        ).alias("address_info"),
    )
    rows = m.select(truth.alias("response"), F.when(F.pmod(i, F.lit(5)) != 4, guess).alias("prediction"))
    return score.null_outcomes(score.to_eval_fields(rows))


@query(f"WITH {SQL_LABELS} SELECT CAST(sum(exact) AS BIGINT) AS exact, CAST(sum(total) AS BIGINT) AS total, round(sum(exact) / CAST(sum(total) AS DOUBLE), 4) AS accuracy FROM o")
def e15_micro_average(spark, sf_dir):
    return score.micro_average(score.null_outcomes(label_fields(spark, sf_dir)))


@query(f"WITH {SQL_FIELDS} SELECT i AS id FROM f WHERE i % 5 >= 3 ORDER BY i LIMIT 5")
def e16_invalid_sample(spark, sf_dir):
    r = replies(spark, sf_dir).select(F.col("msg_id").alias("id"), reply.recover_json_safe(F.col("reply")).alias("parsed"))
    return score.invalid_sample(r).select("id")


@query(f"""WITH {SQL_PRED} SELECT run, id, unnest(list_concat(CASE WHEN j % 3 = 0 THEN ['name'] ELSE [] END, CASE WHEN j % 5 = 0 AND ep <> '0900000000' THEN ['phone'] ELSE [] END, CASE WHEN j % 4 = 0 THEN ['note'] ELSE [] END)) AS field FROM pred""")
def e17_error_rows(spark, sf_dir):
    return score.error_rows(predictions(spark, sf_dir)).select("run", "id", "field")


def with_clean_runs(preds: DataFrame) -> DataFrame:
    """Besides the runs one that is right throughout and one that fails throughout."""
    a = preds.filter("run = 'a'")
    known = preds.schema["prediction"].dataType
    right = a.withColumns({"run": F.lit("right"), "prediction": F.col("expected").cast(known)})
    return preds.unionByName(right).unionByName(a.withColumns({"run": F.lit("down"), "ok": F.lit(False)}))


@query(f"""WITH {SQL_PRED}, bad AS (SELECT run, j % 3 = 0 OR (j % 5 = 0 AND ep <> '0900000000') OR j % 4 = 0 AS wrong FROM pred)
SELECT run, count(*) FILTER (wrong) AS mismatches FROM (SELECT * FROM bad UNION ALL SELECT 'right', false FROM bad WHERE run = 'a' UNION ALL SELECT 'down', wrong FROM bad WHERE run = 'a') GROUP BY run""")
def e18_mismatch_count(spark, sf_dir):
    return score.mismatch_count(with_clean_runs(predictions(spark, sf_dir)))


@query(f"""WITH {SQL_PRED}, r AS (SELECT run, j % 11 > 0 AS ok, j % 3 > 0 AND (j % 5 > 0 OR ep = '0900000000') AND j % 4 > 0 AS same FROM pred), every AS (SELECT * FROM r UNION ALL SELECT 'right', ok, true FROM r WHERE run = 'a' UNION ALL SELECT 'down', false, same FROM r WHERE run = 'a')
SELECT run, count(*) FILTER (ok AND same) AS exact_count, count(*) FILTER (ok) AS total, coalesce(round(count(*) FILTER (ok AND same) / nullif(CAST(count(*) FILTER (ok) AS DOUBLE), 0), 4), 0) AS accuracy FROM every GROUP BY run""")
def e8_clean_runs(spark, sf_dir):
    return score.full_exact(with_clean_runs(predictions(spark, sf_dir)))


@query(f"""WITH {SQL_PRED}, wrong AS (SELECT run, id, unnest(list_concat(CASE WHEN j % 3 = 0 THEN [{{'field': 'name', 'expected': en, 'predicted': NULL, 'k': 0}}] ELSE [] END,
  CASE WHEN j % 5 = 0 AND ep <> '0900000000' THEN [{{'field': 'phone', 'expected': ep, 'predicted': '0900000000', 'k': 1}}] ELSE [] END,
  CASE WHEN j % 4 = 0 THEN [{{'field': 'note', 'expected': eo, 'predicted': eo || ' nhé', 'k': 2}}] ELSE [] END), recursive := true) FROM pred),
r AS (SELECT *, dense_rank() OVER (PARTITION BY run ORDER BY id) AS row_rank, row_number() OVER (PARTITION BY run, id ORDER BY k) AS field_rank FROM wrong)
SELECT run, id, field, expected, predicted, row_rank, field_rank FROM r WHERE row_rank <= 6 AND field_rank <= 4""")
def e19_examples(spark, sf_dir):
    return score.examples(predictions(spark, sf_dir))


@query(f"""WITH {SQL_PRED}, c AS (SELECT count(*) AS shared, count(*) FILTER ((a.j % 3 > 0) = (b.j % 3 > 0) AND (a.j % 5 > 0) = (b.j % 5 > 0) AND (a.j % 4 > 0) = (b.j % 4 > 0) OR a.id % 17 = 0) AS same
  FROM pred a JOIN pred b ON a.id = b.id AND a.run = 'a' AND b.run = 'b') SELECT *, round(same / CAST(shared AS DOUBLE), 4) AS same_ratio, same / CAST(shared AS DOUBLE) > 0.98 AS suspicious FROM c""")
def e20_e21_compare_runs(spark, sf_dir):
    """Every seventeenth message has no prediction in either run, which counts as the same."""
    p = predictions(spark, sf_dir).withColumn("prediction", F.when(F.pmod("id", F.lit(17)) > 0, F.col("prediction")))
    return score.suspicious(score.compare_runs(p.filter("run = 'a'"), p.filter("run = 'b'")))


def _summary(spark, sf_dir) -> DataFrame:
    """Latencies and full matches of both runs; what they read of a prediction is written once, as messages would be made for each again."""
    rows = staged(score.exact_rows(predictions(spark, sf_dir), "id", "latency_seconds"), "exact-rows")
    return score.latency_summary(rows).hint("merge").join(score.count_exact(rows), "run")


SQL_SUMMARY = f"""{SQL_PRED}, s AS (SELECT run, round(quantile_cont((j * 7919 % 5000) / 1000.0 + 0.5, 0.95), 4) AS p95,
  round(count(*) FILTER (j % 3 > 0 AND j % 5 > 0 AND j % 4 > 0) / CAST(count(*) AS DOUBLE), 4) AS accuracy FROM ok GROUP BY run)"""


@query(f"WITH {SQL_SUMMARY} SELECT (SELECT run FROM s ORDER BY p95, run LIMIT 1) AS fastest, (SELECT run FROM s ORDER BY accuracy DESC, run DESC LIMIT 1) AS most_exact")
def e22_best_runs(spark, sf_dir):
    return score.best_runs(_summary(spark, sf_dir))


@query(f"WITH {SQL_SUMMARY} SELECT round((a.p95 - b.p95) / a.p95, 4) AS p95_gain, round(b.accuracy - a.accuracy, 4) AS accuracy_gain FROM s a, s b WHERE a.run = 'a' AND b.run = 'b'")
def e23_gains(spark, sf_dir):
    return score.gains(_summary(spark, sf_dir), "a", "b")


@query(f"WITH {SQL_CELLS} SELECT field, max(exact_accuracy) FILTER (run = 'a') AS a, max(exact_accuracy) FILTER (run = 'b') AS b FROM metrics GROUP BY field")
def e24_field_by_run(spark, sf_dir):
    return score.field_by_run(score.field_metrics(predictions(spark, sf_dir)), ["a", "b"])


@query("SELECT event_id AS id, event_type AS run FROM events ORDER BY event_id LIMIT 20 OFFSET 5")
def e25_take(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("run"))
    return score.take(e, 25, 5)


# ---------------------------------------------------------------- datasets
def sft(spark, sf_dir) -> DataFrame:
    """(input_masked, response): a record a message; every ninth occurs twice."""
    m = dataset.mask_record(plan.messages(spark, sf_dir))
    e, i = F.col("expected"), F.col("idx")
    none = F.lit(None).cast("string")
    info = e["address_info"]
    r = F.struct(
        F.when(F.pmod(i, F.lit(6)) > 0, e["recipient_name"]).alias("recipient_name"), F.lit("[PHONE]").alias("phone_number"), F.when(F.pmod(i, F.lit(4)) > 0, e["note"]).otherwise(none).alias("note"),
        e["address_new"].alias("address_raw"), info.alias("address_info"),
    )
    twice = F.explode(F.when(F.pmod(i, F.lit(9)) == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return m.select("input_masked", r.alias("response"), twice.alias("copy")).drop("copy")


@query("SELECT count(*) AS records, count(DISTINCT text) AS unique_records, count(*) - count(DISTINCT text) AS duplicate_rows FROM documents")
def d1_d2_duplicate_stats(spark, sf_dir):
    return dataset.duplicate_stats(read(spark, sf_dir, "documents").select("text"))


_HASH60 = "('0x' || substr(sha256('{}:' || {}), 1, 15))::BIGINT"
#: Groups of equal events in the order of their hash; ``kept``: what a greedy walk puts into train.
SQL_SPLIT = f"""e AS (SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS tens FROM events),
g AS (SELECT event_type, tens, count(*) AS n, {_HASH60.format(1, "('{\"event_type\": \"' || event_type || '\", \"tens\": ' || tens || '}')")} AS h FROM e GROUP BY ALL),
l AS (SELECT list([n] ORDER BY h) AS sizes, CAST(round(sum(n) * 0.8e0) AS BIGINT) AS goal FROM g),
walk AS (SELECT list_reduce(sizes, lambda acc, v: CASE WHEN acc[1] + v[1] <= goal THEN list_append(list_concat([acc[1] + v[1]], acc[2:]), 1) ELSE list_append(acc, 0) END, [0]) AS w FROM l),
kept AS (SELECT g.*, w[CAST(row_number() OVER (ORDER BY h) + 1 AS INTEGER)] = 1 AS train FROM g, walk)"""


def event_groups(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") / 10).cast("long").alias("tens"))


@query("""WITH t AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations)
SELECT conv_id, '{"a": {"roles": [' || string_agg('{"n": ' || n || ', "who": "' || role || '"}', ', ' ORDER BY turn) || ']}, "by": {' || string_agg('"' || lpad(CAST(turn AS VARCHAR), 3, '0') || '": {"a": null, "z": "' || role || '"}', ', ' ORDER BY turn) || '}, "conv_id": ' || conv_id || '}' AS key
FROM t GROUP BY conv_id""")
def d1_nested_keys(spark, sf_dir):
    """Records with structs inside arrays and maps, whose members stand in another order."""
    c = read(spark, sf_dir, "conversations")
    said = F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").alias("n"))))  # turns of one conversation
    rows = c.groupBy("conv_id").agg(said.alias("t")).select(
        F.map_from_entries(F.reverse(F.transform("t", lambda t: F.struct(F.lpad(t["turn"].cast("string"), 3, "0").alias("k"), F.struct(t["role"].alias("z"), F.lit(None).cast("string").alias("a")).alias("v"))))).alias("by"),
        F.struct(F.transform("t", lambda t: F.struct(t["role"].alias("who"), t["n"].alias("n"))).alias("roles")).alias("a"), "conv_id",
    )
    return rows.select("conv_id", dataset.canonical_key(rows).alias("key"))


@query(f"WITH {SQL_SPLIT} SELECT CASE WHEN train THEN 'train' ELSE 'valid' END AS split, event_type, tens, n AS records FROM kept")
def d3_split_groups(spark, sf_dir):
    train, valid = dataset.split_groups(event_groups(spark, sf_dir), 0.8, exact=True)
    both = train.withColumn("split", F.lit("train")).unionByName(valid.withColumn("split", F.lit("valid")))
    return both.groupBy("split", "event_type", "tens").agg(F.count(F.lit(1)).alias("records"))


@query(f"""WITH {SQL_SPLIT}, s AS (SELECT CAST(sum(n) FILTER (h < 922337203685477580) AS DOUBLE) AS t, CAST(sum(n) AS DOUBLE) AS a FROM g)
SELECT round(t / a, 4) AS train_ratio, round(1 - t / a, 4) AS valid_ratio, CAST(0 AS BIGINT) AS cross_split_overlap FROM s""")
def d4_split_stats(spark, sf_dir):
    return dataset.split_stats(*dataset.split_groups(event_groups(spark, sf_dir), 0.8))


@query("SELECT doc_id FROM documents WHERE doc_id % 10 > 0 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 10 = 0)")
def d5_drop_leakage(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    valid = F.pmod("doc_id", F.lit(10)) == 0  # the two sides of a split
    return dataset.drop_leakage(d.filter(~valid), d.filter(valid), "text").select("doc_id")


SQL_MASKED = f"""{SQL_TEXTS},
masked AS (SELECT *, trim(regexp_replace(regexp_replace(replace(text, pt, '[PHONE]'), '(?:sđt|đt|phone|tel|sdt) \\[PHONE\\]', '[PHONE]'), '\\s+', ' ', 'g')) AS said FROM texts),
sft AS (SELECT *, regexp_replace(name, '^(chị|anh|cô|bạn|chú) ', '') AS who FROM masked UNION ALL SELECT *, regexp_replace(name, '^(chị|anh|cô|bạn|chú) ', '') FROM masked WHERE i % 9 = 0)
"""
_STYLES = ", ".join(f"count(*) FILTER (regexp_matches(said, '{_re2(chr(92) + 'b' + x + '(?:' + chr(92) + '.|' + chr(92) + 's)')}')) AS {x}_dot_or_space_inputs" for x in "xhpq")


@query(f"""WITH {SQL_MASKED} SELECT count(*) AS records, count(*) FILTER (contains(said, '[PHONE]')) AS masked_phone_records, count(*) FILTER (i % 6 = 0) AS recipient_name_null, count(*) FILTER (i % 4 = 0) AS note_null,
  CAST(0 AS BIGINT) AS address_raw_null, {_STYLES}, count(*) AS neighborhood_null, CAST(0 AS BIGINT) AS municipality_null, CAST(0 AS BIGINT) AS sub_region_null, CAST(0 AS BIGINT) AS street_null,
  CAST(0 AS BIGINT) AS address_number_null, count(DISTINCT record) AS unique_records, count(*) - count(DISTINCT record) AS duplicate_rows
  FROM (SELECT *, concat_ws('|', said, CASE WHEN i % 6 > 0 THEN who ELSE '' END, CASE WHEN i % 4 > 0 THEN note ELSE '' END, house, street, ward_name, province_name) AS record FROM sft)""")
def d6_profile(spark, sf_dir):
    return dataset.profile(sft(spark, sf_dir))


@query()
def d7_d21_dataset_summary(spark, sf_dir):
    return dataset.dataset_summary(*dataset.split_groups(sft(spark, sf_dir), 0.8))


@query("SELECT conv_id, count(*) AS turns, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def d8_chat_roles(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    said = F.array_sort(F.collect_list(F.struct("turn", "role")))  # turns of one conversation
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), said.alias("m")).select("conv_id", "turns", F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"))


@query(f"""WITH {SQL_MASKED} SELECT CAST(3 AS INTEGER) AS n, said AS user, '{{"recipient_name":' || CASE WHEN i % 6 > 0 THEN '"' || who || '"' ELSE 'null' END || ',"phone_number":"[PHONE]","note":' || CASE WHEN i % 4 > 0 THEN '"' || note || '"' ELSE 'null' END
  || ',"address_raw":"' || house || ' ' || street || ', ' || ward_name || ', ' || province_name || '","address_info":{{"address_number":"' || house || '","street":"' || street || '","neighborhood":null,"municipality":"' || ward_name
  || '","sub_region":"' || province_name || '","country":"VNM"}}}}' AS assistant FROM sft""")
def d8_to_chat(spark, sf_dir):
    return dataset.to_chat(sft(spark, sf_dir), "Trích xuất đơn hàng.").select(F.size("messages").alias("n"), F.col("messages")[1]["content"].alias("user"), F.col("messages")[2]["content"].alias("assistant"))


@query(f"""WITH {SQL_OLD} SELECT old_province_name, old_district_name, old_ward_name, min(province_name) AS province_name, min(ward_name) AS ward_name FROM old
  GROUP BY 1, 2, 3 HAVING count(DISTINCT province_name || '|' || ward_name) = 1""")
def d10_unambiguous_entries(spark, sf_dir):
    return dataset.unambiguous_entries(records(spark, sf_dir))


@query(f"""WITH {SQL_OLD}, {SQL_FLAT}, r AS (SELECT source AS stratum, row_number() OVER (PARTITION BY source ORDER BY ward_code, opos, no) AS id FROM rec WHERE source = 'new' OR coalesce(od, '') <> ''),
h AS (SELECT stratum, stratum || id AS id FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_HASH60.format(1, 'id')}, id) AS rn FROM h)
SELECT id, stratum, row_number() OVER (ORDER BY {_HASH60.format(2, 'id')}, id) AS place FROM k WHERE rn <= CASE stratum WHEN 'old' THEN 165 ELSE 55 END""")
def d11_d12_stratified_pick(spark, sf_dir):
    """Entries by name: their stratum and number in it."""
    from orderloom.operators.order import numbered

    old, new = dataset.sampling_pools(records(spark, sf_dir))
    pool = numbered(old.unionByName(new), "ward_code", "ord", by="source")
    named = F.concat("source", (F.col("no") + 1).cast("string"))
    return dataset.stratified_pick(pool.select(named.alias("id"), F.col("source").alias("stratum")), {"old": 165, "new": 55})


@query(f"WITH {SQL_FIELDS} SELECT i AS msg_id, phone, CASE i % 4 WHEN 0 THEN a || '.' || b || '.' || c WHEN 1 THEN a || ' ' || b || ' ' || c WHEN 2 THEN '+84 ' || substr(phone, 2, 3) || ' ' || b || ' ' || c ELSE phone END AS phone_text, house, street, name, note FROM f")
def d13_synth_fields(spark, sf_dir):
    return plan.messages(spark, sf_dir).select("msg_id", "fields.phone", "fields.phone_text", "fields.house", "fields.street", "fields.name", "fields.note")


@query(f"WITH {SQL_TEXTS} SELECT i AS msg_id, text FROM texts")
def d14_render_order(spark, sf_dir):
    return plan.messages(spark, sf_dir).select("msg_id", "text")


_TUNED = (
    ("name || ' đt ' || ph || ' về ' || ad", " note: "), ("'đơn của ' || name || ', phone ' || ph || ', nhận ở ' || ad", "; ghi chú "), ("name || nl || ph || nl || 'địa chỉ ' || ad", "\n"),
    ("'Shop gửi giúp ' || name || ': ' || ph || '; tới ' || ad", "; ghi chú: "), ("name || ' xin đổi chỗ nhận. ĐC: ' || ad || '. ' || ph", ". "), ("name || ' lấy thêm 1 hộp' || nl || 'sđt ' || ph || nl || 'ship ' || ad", "\nnote: "),
    ("'giao về ' || ad || ', cho ' || name || ', sđt ' || ph", ", ghi chú: "), ("'nơi nhận: ' || ad || nl || 'khách: ' || name || nl || 'gọi: ' || ph", "\nnote: "), ("'gửi ' || ad || ' | ' || name || ' | ' || ph", " | "),
    ("'ĐC ' || ad || ' - ' || name || ' - ' || ph", " - "), ("'Tên: ' || name || ' | ĐT: ' || told || ' | Nơi nhận: ' || ad", " | Ghi chú: "), ("'Họ tên: ' || name || nl || 'SĐT: ' || told || nl || 'Nơi nhận: ' || ad", "\nGhi chú: "),
    ("ph || ' - ' || name || ' - ' || ad", " - "),
)


@query(f"""WITH {SQL_TEXTS}, tuned AS (SELECT i, name, nl, house || ' ' || street || ', ' || tail AS ad, CASE WHEN i % 7 > 0 THEN pt ELSE '' END AS ph, CASE WHEN i % 7 > 0 THEN pt ELSE 'chưa có' END AS told, CASE WHEN i % 4 > 0 THEN note END AS note FROM texts)
  SELECT i AS msg_id, CASE i % 13 {" ".join(f"WHEN {k} THEN {t} || coalesce('{n}' || note, '')" for k, (t, n) in enumerate(_TUNED))} END AS text FROM tuned""")
def d14_render_tuning_order(spark, sf_dir):
    """Every seventh message lacks the phone, every fourth the note."""
    m, f, i = plan.messages(spark, sf_dir), F.col("fields"), F.col("idx")
    tail = F.concat_ws(", ", text.short_ward(F.col("place.ward"), i), text.short_district(F.col("place.district"), i), text.short_province(F.col("place.province"), i))
    some = F.struct(f["name"].alias("name"), F.when(F.pmod(i, F.lit(7)) > 0, f["phone_text"]).alias("phone_text"), F.when(F.pmod(i, F.lit(4)) > 0, f["note"]).alias("note"))
    address = F.concat(f["house"], F.lit(" "), f["street"], F.lit(", "), tail)
    return m.select("msg_id", "idx", some.alias("some"), address.alias("address")).select("msg_id", dataset.render_tuning_order(F.col("some"), F.col("address"), F.col("idx")).alias("text"))


_EDGE_SQL = (
    "name || ' ' || pt || ' giao ' || home || ', ' || area || ', note: ' || note", "name || ' ' || pt || ' ship số nhà ' || lot || ', ' || area", "name || ' ' || pt || ' nhận ở ' || spot || ', ' || area || ', ' || note",
    "name || ', ' || pt || ', ' || area", "'mã đơn: ' || phone || ', giao ' || house || ' ' || street", "name || ' ' || substr(phone, 1, 9) || ' giao ' || house || ' ' || street || ', ' || area",
    "'2 số: ' || name || ' ' || phone || ', không gọi được thì ' || phone2 || ', giao ' || house || ' ' || street", "name || ' 🙂 :v ship ' || house || ' ' || street || ' ' || phone",
)


@query(f"""WITH {SQL_FIELDS.replace('SELECT o_orderkey AS i FROM orders', 'SELECT DISTINCT o_orderkey // 8 AS i FROM orders')},
e AS (SELECT o_orderkey AS idx, o_orderkey % 8 AS k, f.*, {_PHONE_TEXT.replace('i % 4', 'f.i % 4')} AS pt, {_of(dataset.AREAS, 'f.i')} AS area, {_of(dataset.BUILDINGS, 'f.i')} AS home, {_of(dataset.ESTATES, 'f.i')} AS lot, {_of(dataset.LANDMARKS, 'f.i')} AS spot,
  '09' || lpad(CAST((f.i + 3) % 100 AS VARCHAR), 2, '0') || lpad(CAST(((f.i + 3) * 37 + 123456) % 1000000 AS VARCHAR), 6, '0') AS phone2 FROM orders JOIN f ON f.i = o_orderkey // 8)
SELECT idx, {_of(dataset.EDGES, 'idx')} AS category, CASE k {" ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(_EDGE_SQL))} END AS input, CASE WHEN k <> 4 THEN name END AS name, CASE WHEN k NOT IN (4, 5) THEN phone END AS phone,
  CASE WHEN k IN (0, 2) THEN note END AS note, CASE WHEN k IN (0, 1, 2, 3, 5) THEN area END AS ward, CASE k WHEN 0 THEN home WHEN 1 THEN lot WHEN 2 THEN spot WHEN 3 THEN NULL ELSE house END AS house_number FROM e""")
def d20_edge_records(spark, sf_dir):
    return dataset.edge_records(plan.messages(spark, sf_dir).select("idx"))


@query(f"""WITH {SQL_FIELDS} SELECT i AS idx, CASE WHEN i % 8 NOT IN (4, 5) THEN '09' || lpad(CAST((i // 8) % 100 AS VARCHAR), 2, '0') || lpad(CAST(((i // 8) * 37 + 123456) % 1000000 AS VARCHAR), 6, '0') END AS phone FROM f""")
def d20_edge_phones(spark, sf_dir):
    """The phones that extraction finds in the edge cases."""
    return dataset.edge_records(plan.messages(spark, sf_dir).select("idx")).select("idx", phone.extract_phone(F.col("input")).alias("phone"))


@query(f"WITH {SQL_PLACES} SELECT i AS msg_id, house || ' ' || street || ', ' || ward_name || ', ' || province_name AS address_new FROM msg")
def d14_d15_expected_order(spark, sf_dir):
    return plan.messages(spark, sf_dir).select("msg_id", "expected.address_new")


# Fixed values, as the rule has them: written out here, so that the table of the library is checked.
_SHORT_DOT = (
    ("Thành Phố ", "tp. "), ("Thành phố ", "tp. "), ("Thủ Đô ", ""), ("Thủ đô ", ""), ("Thị trấn ", "tt. "), ("Thị xã ", "tx. "), ("Phường ", "p. "), ("Huyện ", "h. "), ("Quận ", "q. "), ("Tỉnh ", "tỉnh "), ("Xã ", "x."),
)
_SHORT_BARE = (
    ("Thành Phố ", "tp "), ("Thành phố ", "tp "), ("Thủ Đô ", ""), ("Thủ đô ", ""), ("Thị trấn ", "tt "), ("Thị xã ", "tx "), ("Phường ", "p "), ("Huyện ", "h "), ("Quận ", "q "), ("Tỉnh ", ""), ("Xã ", "x "),
)


def _abbreviated(c: str, dotted: bool) -> str:
    return _short(c, _SHORT_DOT if dotted else _SHORT_BARE, c)


def _line(*parts: str, sep: str = ", ") -> str:
    return f" || '{sep}' || ".join(parts)


_DOT, _BARE = ({c: _abbreviated(c, dotted) for c in ("w", "d", "p")} for dotted in (True, False))
_WAYS = (
    _line("a", "w", "d", "p"), _line("a", _DOT["w"], _DOT["d"], _DOT["p"]), _line("a", _BARE["w"], _BARE["d"], _BARE["p"]), _line("a", "w", "p"), _line("a", "d", "p"), _line("a", "w", "d"),
    f"lower({_line('a', 'w', 'd', 'p')})", _text("", _line("a", "w", "d", "p")), f"lower({_text('', _line('a', _BARE['w'], _BARE['d'], 'p'))})", _line("p", "d", "w", "a"),
    _line("a", "w", "d", "p", sep=" - "), _line("a", "w", "d", "p", sep=" "), _line("a", _DOT["w"], "d", "p"), _line("a", "w", _DOT["d"], "p"), _line("w", "d", "p"), _line("a", _DOT["w"], _BARE["p"]),
)


@query(f"""WITH {SQL_PLACES}, parts AS (SELECT i, house || ' ' || street AS a, old_ward_name AS w, old_district_name AS d, old_province_name AS p FROM msg),
ways AS (SELECT i, CASE i % 16 {" ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_WAYS))} END AS t FROM parts)
SELECT i AS msg_id, CASE WHEN i % 20 = 14 THEN upper(t) ELSE t END AS address_text FROM ways""")
def d16_perturb_address(spark, sf_dir):
    m = plan.messages(spark, sf_dir).select("msg_id", "idx", "fields.house", "fields.street", "place.ward", "place.district", "place.province")
    return dataset.perturb_address(m).select("msg_id", "address_text")


_ROLES = (  # text with its phone as [PHONE], and who receives
    ("who || ' ơi ship cho mình tới ' || a || ', số [PHONE]'", "NULL"), ("who || ' ơi em chốt đơn này, giao ' || a || ' [PHONE]'", "NULL"), ("'shop ' || who || ' gửi giúp tới ' || other || ' [PHONE], ' || a", "bare"),
    ("'nhân viên chốt đơn là ' || who || ', khách ' || other || ' [PHONE], ' || a", "bare"), ("'liên hệ shop ' || who || ' nếu cần, giao ' || a || ' [PHONE]'", "NULL"),
    ("who || ' ơi giao hộ cho ' || other || ' ở ' || a || ' [PHONE]'", "bare"), ("'người gửi ' || who || ', người nhận ' || other || ' [PHONE], ' || a", "bare"), ("who || ' sale, ship cho ' || other || ' [PHONE] về ' || a", "bare"),
    ("who || ' ơi giao cho ' || other || ' số [PHONE] tại ' || a", "bare"), ("who || ' ơi ship cho ' || other || ' ' || a || ' [PHONE]'", "bare"), ("who || ' ơi đi giao giúp đơn [PHONE] ' || a", "NULL"),
    ("who || ' ơi đến ' || a || ' giao giúp'", "NULL"), ("'đơn của ' || other || ' [PHONE], ' || who || ' giao nhé, ' || a", "bare"),
)


@query(f"""WITH {SQL_FIELDS}, r AS (SELECT i, name AS who, {_of(dataset.NAMES, 'i + 4')} AS other, house || ' ' || street AS a FROM f), b AS (SELECT *, regexp_replace(other, '^(chị|anh|cô|bạn|chú) ', '') AS bare FROM r),
t AS (SELECT i, CASE i % 13 {" ".join(f"WHEN {k} THEN {x}" for k, (x, _) in enumerate(_ROLES))} END AS said, CASE i % 13 {" ".join(f"WHEN {k} THEN {n}" for k, (_, n) in enumerate(_ROLES))} END AS recipient_name FROM b)
SELECT i AS idx, said AS input_masked, recipient_name, contains(said, '[PHONE]') AS has_phone FROM t""")
def d17_role_records(spark, sf_dir):
    return dataset.role_records(plan.messages(spark, sf_dir).select("idx")).drop("response")


_LATER = SQL_FIELDS.replace("m AS (SELECT o_orderkey AS i", "m2 AS (SELECT o_orderkey + 11 AS i").replace("f0 AS", "g0 AS").replace("FROM m)", "FROM m2)").replace("f AS (SELECT *", "g AS (SELECT *").replace("FROM f0)", "FROM g0)")


@query(f"""WITH {SQL_FIELDS}, {_LATER}, c AS (SELECT f.i AS i, f.name AS n, f.house || ' ' || f.street AS old, g.house || ' ' || g.street AS fresh FROM f JOIN g ON g.i = f.i + 11)
SELECT i AS idx, CASE i % 5 WHEN 0 THEN n || ' [PHONE] đổi từ ' || old || ' sang ' || fresh WHEN 1 THEN 'không giao ' || old || ' nữa, giao ' || fresh || ' cho ' || n || ' [PHONE]' WHEN 2 THEN n || ' [PHONE], địa chỉ cũ ' || old || '; địa chỉ mới ' || fresh
  WHEN 3 THEN 'sửa giúp ' || n || ' [PHONE]: ' || fresh || ' (trước là ' || old || ')' ELSE '[PHONE] ' || n || ' chuyển về ' || fresh || ', bỏ ' || old END AS input_masked, regexp_replace(n, '^(chị|anh|cô|bạn|chú) ', '') AS recipient_name, fresh AS address_raw FROM c""")
def d18_correction_records(spark, sf_dir):
    return dataset.correction_records(plan.messages(spark, sf_dir).select("idx")).drop("response")


def _styled(c: str, gone: str, also_bare: str = "") -> str:
    return (f"CASE WHEN k IN ({gone}) THEN NULL WHEN k IN (1, 7, 13) THEN {_abbreviated(c, True)} WHEN k IN (2, 8{also_bare}) THEN {_abbreviated(c, False)} "
            f"WHEN k IN (3, 14) THEN lower({c}) WHEN k = 12 THEN {_text('', c)} ELSE {c} END")


_STREET = f"CASE WHEN k = 9 THEN NULL WHEN k = 12 THEN {_text('', 'street')} ELSE street END"
_LABELLED = "(?i)(?:sđt|sdt|đt|dt|phone|tel|điện\\s*thoại|dien\\s*thoai)\\s*[:：#-]?\\s*\\[PHONE\\]"


@query(f"""WITH {SQL_FIELDS}, {SQL_OLD}, {SQL_FLAT}, {_LATER},
entry AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY no) - 1 AS e, CASE WHEN source = 'old' THEN w END AS n, CASE WHEN source = 'old' THEN od ELSE ward_name END AS m, CASE WHEN source = 'old' THEN p ELSE province_name END AS r
  FROM rec WHERE source = 'new' OR coalesce(od, '') <> ''),
sizes AS (SELECT source, count(*) AS cnt FROM entry GROUP BY source),
placed AS (SELECT f.*, i % 16 AS k, row_number() OVER (ORDER BY i) - 1 AS o, count(*) OVER () AS total, {_PHONE_TEXT} AS pt, chr(10) AS nl FROM f),
kinds AS (SELECT *, CASE WHEN o % 10 = 0 THEN 'role' WHEN o % 20 = 5 THEN 'correction' WHEN o < floor(total * 0.7e0) THEN 'old' ELSE 'new' END AS kind FROM placed),
drawn AS (SELECT kinds.*, n AS n0, m AS m0, r AS r0 FROM kinds JOIN sizes ON source = kind JOIN entry ON entry.source = kind AND entry.e = {_HASH60.format(1, "o")} % cnt),
parts AS (SELECT *, {_styled('n0', '4')} AS n, {_styled('m0', '5', ', 11, 15')} AS m, {_styled('r0', '6, 15', ', 11')} AS r, {_STREET} AS st, CASE k WHEN 10 THEN house WHEN 12 THEN 'so ' || house ELSE 'số ' || house END AS ht FROM drawn),
lines AS (SELECT *, concat_ws(' ', ht, st) AS front, CASE WHEN k IN (3, 10, 11) THEN ' ' ELSE ', ' END AS sep FROM parts),
raws AS (SELECT *, CASE WHEN k IN (13, 14) THEN concat_ws(sep, r, m, n, front) ELSE concat_ws(sep, front, n, m, r) END AS ad, pt AS ph, pt AS told FROM lines),
tuned AS (SELECT *, CASE i % 13 {" ".join(f"WHEN {k} THEN {t} || coalesce('{n}' || note, '')" for k, (t, n) in enumerate(_TUNED))} END AS text FROM raws),
said AS (SELECT *, trim(regexp_replace(regexp_replace(replace(CASE WHEN i % 20 = 14 THEN upper({_text('', 'text')}) ELSE text END, pt, '[PHONE]'), '{_LABELLED}', '[PHONE]', 'g'), '\\s+', ' ', 'g')) AS masked FROM tuned),
b AS (SELECT * EXCLUDE (a, b), name AS who, {_of(dataset.NAMES, 'i + 4')} AS other, house || ' ' || street AS a, regexp_replace({_of(dataset.NAMES, 'i + 4')}, '^(chị|anh|cô|bạn|chú) ', '') AS bare FROM kinds WHERE kind = 'role'),
c AS (SELECT q.*, q.name AS n, q.house || ' ' || q.street AS old, g.house || ' ' || g.street AS fresh, g.house AS gh, g.street AS gs FROM kinds q JOIN g ON g.i = q.i + 11 WHERE kind = 'correction')
SELECT i AS idx, kind, masked AS input_masked, regexp_replace(name, '^(chị|anh|cô|bạn|chú) ', '') AS recipient_name, note, ad AS address_raw, house AS address_number, st AS street, n AS neighborhood, m AS municipality, r AS sub_region FROM said
UNION ALL SELECT i, kind, CASE i % 13 {" ".join(f"WHEN {k} THEN {x}" for k, (x, _) in enumerate(_ROLES))} END, CASE i % 13 {" ".join(f"WHEN {k} THEN {n}" for k, (_, n) in enumerate(_ROLES))} END, NULL, a, house, street, NULL, NULL, NULL FROM b
UNION ALL SELECT i, kind, CASE i % 5 WHEN 0 THEN n || ' [PHONE] đổi từ ' || old || ' sang ' || fresh WHEN 1 THEN 'không giao ' || old || ' nữa, giao ' || fresh || ' cho ' || n || ' [PHONE]' WHEN 2 THEN n || ' [PHONE], địa chỉ cũ ' || old || '; địa chỉ mới ' || fresh
  WHEN 3 THEN 'sửa giúp ' || n || ' [PHONE]: ' || fresh || ' (trước là ' || old || ')' ELSE '[PHONE] ' || n || ' chuyển về ' || fresh || ', bỏ ' || old END, regexp_replace(n, '^(chị|anh|cô|bạn|chú) ', ''), NULL, fresh, gh, gs, NULL, NULL, NULL FROM c""")
def d19_generate(spark, sf_dir):
    out = dataset.generate(plan.messages(spark, sf_dir).select("idx"), *dataset.sampling_pools(records(spark, sf_dir)))
    return out.select("idx", "kind", "input_masked", "response.recipient_name", "response.note", "response.address_raw", "response.address_info.address_number", "response.address_info.street", *[f"response.address_info.{c}" for c in ("neighborhood", "municipality", "sub_region")])


@query(f"""WITH {SQL_TEXTS} SELECT i AS msg_id, trim(regexp_replace(regexp_replace(replace(text, pt, '[PHONE]'), '(?:sđt|đt|phone|tel|sdt) \\[PHONE\\]', '[PHONE]'), '\\s+', ' ', 'g')) AS input_masked FROM texts""")
def d22_mask_record(spark, sf_dir):
    return dataset.mask_record(plan.messages(spark, sf_dir)).select("msg_id", "input_masked")


# ---------------------------------------------------------------- streams
@query("SELECT date_trunc('minute', ts) AS minute, count(*) AS orders FROM events GROUP BY 1")
def w3_orders_per_minute(spark, sf_dir):
    from orderloom.streaming.stream import orders_per_minute

    return orders_per_minute(read(spark, sf_dir, "events"))
