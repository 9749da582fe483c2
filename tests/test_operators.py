"""Table operators against brute force on small inputs."""

import contextlib
import json
import random
import re
from io import StringIO
from pathlib import Path

from pyspark.sql import functions as F

from orderloom.functions import extract
from orderloom.functions.phone import mask_phone
from orderloom.functions.text import compact_text
from orderloom.operators import admin, dataset, resolve, score
from orderloom.plans import orders as plan
from orderloom.plans import queries
from orderloom.sources import io, staging
from orderloom.streaming import stream


def ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def test_resolution_against_a_scan(spark, data):
    records = resolve.flatten_admin(plan.admin_table(spark, data)).cache()
    recs = records.orderBy("ord").collect()
    rng = random.Random(3)
    rows = []
    for i in range(60):
        r = rng.choice(recs)
        ward = r.old_ward_name or r.ward_name
        if i % 3 == 0:
            ward = ward[:-1]
        rows.append((i, (r.old_province_name or r.province_name) if i % 4 else None, r.old_district_name if i % 5 else None, None if i == 7 else ("Phường" if i == 9 else ward), "s", None if i % 6 else "1"))
    df = spark.createDataFrame(rows, "addr_id long, province string, district_hint string, ward string, street string, house_number string")
    keyed = {r.addr_id: r for r in resolve.query_keys(df).collect()}
    got = {r.addr_id: r.resolved for r in resolve.resolve_records(df, records).collect()}

    def srt(s):
        return " ".join(sorted(s.split()))

    def field(q, c):
        if not q or q == c:
            return 100.0
        if not c:
            return 0.0
        r = ratio(q, c)
        return ratio(srt(q), srt(c)) if r >= 60 else r

    def mix(p, d, w, hp, hd):
        return p * 0.42 + d * 0.28 + w * 0.30 if hp and hd else p * 0.55 + w * 0.45 if hp else d * 0.38 + w * 0.62 if hd else w

    assert len(got) == len(rows)
    for row in rows:
        k, out = keyed[row[0]], got[row[0]]
        if not row[3]:
            assert out.warnings == ["missing_ward"] and not out.is_normalized
            continue
        best = []
        for r in recs:
            p, d, w = field(k.q_province, r.province_key), field(k.q_district, r.district_key), field(k.q_ward, r.ward_key)
            if (k.q_province and p < 78) or (k.q_district and r.district_key and d < 72) or w < 72:
                continue
            tie = mix(field(k.qt_province, r.province_text_key), field(k.qt_district, r.district_text_key), field(k.qt_ward, r.ward_text_key), k.qt_province, k.qt_district)
            same = (k.qt_province == r.province_text_key) + (k.qt_district == r.district_text_key if k.qt_district else 0) + (k.qt_ward == r.ward_text_key)
            best.append((-round(mix(p, d, w, k.q_province, k.q_district), 2), -same, -tie, r.old_district_name is None, r.source != "new", r.ord, r))
        best.sort(key=lambda b: b[:6])
        assert [(c.ward_name, c.old_ward_name, c.score) for c in out.candidates] == [(b[6].ward_name, b[6].old_ward_name, -b[0]) for b in best[:5]], row
        if best:
            assert out.ward == best[0][6].ward_name


def test_predecessors(spark):
    rows = ["Phường A, Xã Bình (huyện C, tỉnh D)", "Xã An (phần còn lại sau khi sáp nhập), và Xã Bé", "giữ nguyên", None, "một phần diện tích, Xã Gò; 12 ha", "Xã X (thành phố Y)"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    got = [[tuple(e) for e in r.e] for r in df.select("i", admin.parse_predecessors(F.col("t"), F.lit("P")).alias("e")).orderBy("i").collect()]
    assert got[0] == [("Phường A", None, "P"), ("Xã Bình", "huyện C", "tỉnh D")]
    assert got[1] == [("Xã An", None, "P"), ("Xã Bé", None, "P")] and got[2] == [] and got[3] == []
    assert got[5] == [("Xã X", None, "thành phố Y")]


def test_confidence_tiers(spark):
    old = spark.createDataFrame([(1, "xa a", "Huyện 1", "Tỉnh P", 1), (1, "xa b", "Huyện 1", "Tỉnh P", 2), (1, "xa b", "Huyện 2", "Tỉnh P", 3), (1, "xa c", "Huyện 1", "Tỉnh Q", 4), (1, "xa d", "Huyện 3", "Tỉnh Q", 5), (1, "xa d", "Huyện 4", "Tỉnh P", 6)], "x int, key string, old_district_name string, old_province_name string, ord long").drop("x")
    short = old.withColumn("key", F.regexp_replace("key", "^xa ", ""))
    entries = spark.createDataFrame([("1", "p", "Xã A", None), ("2", "p", "Xã B", "Huyện 2"), ("3", "p", "Xã B", None), ("4", "p", "Xã C", None), ("5", "p", "Xã D", None), ("6", "p", "Xã Z", None), ("7", "n", "Xã B", None), ("8", "n", "Xã A", None), ("9", "p", "Phường A", None)], "entry_id string, province_code string, old_ward_name string, district_hint string")
    merger = spark.createDataFrame([("p", "tinh p")], "province_code string, old_province_key string")
    tiers = admin.classify_matches(admin.allowed_only(admin.lookup_candidates(entries, old, short), merger))
    got = {r.entry_id: (r.conf, r.old_district_name) for r in tiers.collect()}
    assert got == {"1": ("exact", "Huyện 1"), "2": ("district_hint", "Huyện 2"), "3": ("ambiguous_region", "Huyện 1"), "4": ("not_allowed", None), "5": ("filtered", "Huyện 4"), "6": ("not_found", None), "7": ("ambiguous", "Huyện 1"), "8": ("exact", "Huyện 1"), "9": ("exact", "Huyện 1")}
    filled = {r.entry_id: r.conf for r in admin.infer_from_siblings(tiers.withColumn("ward_code", F.lit("w"))).collect()}
    assert filled["4"] == "inferred_from_siblings"


def test_token_f1(spark):
    cases = [(None, None, 1.0), ("", "a", 0.0), ("a b b", "b b c", 2 / 3), ("A  b", "a B", 1.0), ("x", "y", 0.0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = [r.f for r in df.select("i", score.token_f1(F.col("a"), F.col("b")).alias("f")).orderBy("i").collect()]
    assert all(abs(g - c[2]) < 1e-9 for g, c in zip(got, cases, strict=True))


def test_splits(spark):
    df = spark.createDataFrame([(f"t{i % 70}", i % 70) for i in range(200)], "a string, b int")
    for exact in (False, True):
        train, valid = dataset.split_groups(df, 0.8, exact=exact)
        a, b = [{r.a for r in x.collect()} for x in (train, valid)]
        assert not a & b and train.count() + valid.count() == 200
        if exact:
            assert 150 <= train.count() <= 160
    stats = dataset.split_stats(*dataset.split_groups(df)).first()
    assert stats.cross_split_overlap == 0 and abs(stats.train_ratio + stats.valid_ratio - 1) < 1e-3


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x: y, z")], "a int, b string")
    io.write_jsonl(df, f"{tmp_path}/j")
    assert sorted(map(tuple, io.read_jsonl(spark, f"{tmp_path}/j", "a int, b string").collect()), key=str) == [(1, None), (2, "x: y, z")]
    io.write_jsonl(df.coalesce(1), f"{tmp_path}/s", compact=False)
    assert {r.value for r in spark.read.text(f"{tmp_path}/s").collect()} == {'{"a": 1, "b": null}', '{"a": 2, "b": "x: y, z"}'}
    (tmp_path / "m.json").write_text('{"01": ["Tỉnh  A", "Tỉnh B"], "02": []}')
    assert {tuple(r) for r in io.read_merger_map(spark, f"{tmp_path}/m.json").collect()} == {("01", "tinh a"), ("01", "tinh b")}
    (tmp_path / "c.json").write_text('{"7": {"name": "X", "parent_code": "1"}, "3": {"name": "Y"}}')
    rows = io.read_code_map(spark, f"{tmp_path}/c.json", "name:string,parent_code:string").orderBy("ord").collect()
    assert [(r.code, r.name, r.parent_code) for r in rows] == [("7", "X", "1"), ("3", "Y", None)]
    bad = io.split_province_reply(spark.createDataFrame([('{"ma":"1"}.synt.[{"ten":"A"}]',), ("junk",)], "s string"), "s").collect()
    assert (bad[0].province.ma, bad[0].wards[0].ten, bad[1].province, bad[1].wards) == ("1", "A", None, [])
    import os

    pairs = {"r1": ("x", "y"), "r2": (), "smoke": ("x",), "smoketest (q8": ("smoke",)}
    for k, (folder, stems) in enumerate(pairs.items()):
        (tmp_path / "runs" / folder).mkdir(parents=True)
        (tmp_path / "runs" / folder / "z_predictions.jsonl").write_text("{}")
        for j, stem in enumerate(stems):
            for kind in ("predictions.jsonl", "summary.json"):
                at = tmp_path / "runs" / folder / f"{stem}_{kind}"
                at.write_text("{}")
                os.utime(at, (10_000 + 100 * k + j, 10_000 + 100 * k + j))

    def runs(**how):
        return [(r.folder, r.run) for r in io.discover_runs(spark, f"{tmp_path}/runs", **how).orderBy("recency").collect()]

    assert runs() == [("smoketest (q8", "smoke"), ("r1", "y"), ("r1", "x")]
    assert runs(latest=1) == [("smoketest (q8", "smoke")] and runs(include=("(q8", "none")) == [("smoketest (q8", "smoke")] and runs(include=("(Q8",)) == []


def test_admin_json_round_trip(spark, data, tmp_path):
    wards = plan.admin_wards(spark, data)
    io.write_admin_json(wards, f"{tmp_path}/admin")
    back = spark.read.schema(io.ADMIN).json(f"{tmp_path}/admin")
    assert resolve.flatten_admin(back).count() == resolve.flatten_admin(plan.admin_table(spark, data)).count()


def test_streams(spark, data, tmp_path):
    msgs = plan.messages(spark, data).select("msg_id", "text").limit(40)
    msgs.write.parquet(f"{tmp_path}/in")
    records = resolve.flatten_admin(plan.admin_table(spark, data)).cache()
    source = spark.readStream.schema("msg_id long, text string").parquet(f"{tmp_path}/in")
    stream.parse_stream(source, records, f"{tmp_path}/out", f"{tmp_path}/ck", once=True).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 40


def test_stream_scores_spellings_once(spark, data, tmp_path, monkeypatch):
    records = resolve.flatten_admin(plan.admin_table(spark, data)).cache()
    msgs = plan.messages(spark, data).select("msg_id", "text").orderBy("msg_id").limit(30).collect()
    asked, scored = stream.resolve_spellings, []
    monkeypatch.setattr(stream, "resolve_spellings", lambda s, r: (scored.append(s.count()), asked(s, r))[1])
    root = spark.conf.get("spark.checkpoint.dir", None)

    def run(rows):
        spark.createDataFrame(rows, "msg_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema("msg_id long, text string").parquet(f"{tmp_path}/in")
        stream.parse_stream(source, records, f"{tmp_path}/out", f"{tmp_path}/ck", once=True).awaitTermination()

    def staged_folders():
        at = Path((root or next(iter(staging._UNSET.values()), "file:///none")).removeprefix("file://"))
        return sorted(x.name for x in at.iterdir()) if at.exists() else []

    before = staged_folders()
    run(msgs[:10])
    run(msgs[:10])  # nothing new
    assert len(scored) == 1
    for k in (10, 20):
        run(msgs[k : k + 10])
    assert len(list((tmp_path / "ck-spellings").iterdir())) <= 2 and len(scored) <= 3
    assert staged_folders() == before
    cols = ["msg_id", "recipient_name", "phone_number", "note", "address_raw", "address_new"]
    whole = plan.parse_messages(spark.createDataFrame(msgs[:30], "msg_id long, text string"), records)
    want = {str(r) for r in whole.select(*cols, "address_info").collect()}
    got = [str(r) for r in spark.read.parquet(f"{tmp_path}/out").select(*cols, "address_info").collect()]
    assert set(got) == want and len(got) == 40


def test_other_streams(spark, data, tmp_path):
    events = spark.readStream.schema(spark.read.parquet(f"{data}/events.parquet").schema).parquet(f"{data}/events.parqu*t")
    q = stream.orders_per_minute(events).writeStream.format("memory").queryName("minutes").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck2").start()
    q.awaitTermination()
    want = {tuple(r) for r in stream.orders_per_minute(spark.read.parquet(f"{data}/events.parquet")).collect()}
    assert {tuple(r) for r in spark.table("minutes").collect()} == want
    spark.sql("select * from values ('a', timestamp'2024-01-01 00:00:00'), ('a', timestamp'2024-01-01 00:10:00'), ('b', timestamp'2024-01-01 00:05:00') t(text, ts)").write.parquet(f"{tmp_path}/dup")
    twice = spark.readStream.schema("text string, ts timestamp").parquet(f"{tmp_path}/dup")
    q = stream.dedupe_stream(twice).writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck3").start()
    q.awaitTermination()
    assert spark.table("once").count() == 2


def test_generated_records(spark, data):
    ids = plan.messages(spark, data).select("idx").limit(60)
    roles = dataset.role_records(ids).collect()
    assert all(r.has_phone == ("[PHONE]" in r.input_masked) for r in roles) and any(r.recipient_name is None for r in roles)
    assert all("[PHONE]" in r.input_masked for r in dataset.correction_records(ids).collect())
    assert all(r.response.recipient_name == r.recipient_name and (r.response.phone_number is not None) == r.has_phone for r in roles)
    assert dataset.curated(spark).count() == 10


def test_entry():
    import __spark_entry__ as e

    names = set(e.queries())
    assert set(e.oracle_sql()) <= names and len(names) > 80


def test_names_of_all_templates(spark, data):
    got = {r.msg_id: r.name for r in queries.QUERIES["x1_extract_name"](spark, data).collect()}
    rows = plan.messages(spark, data).select("msg_id", "idx", "text", "fields.name").collect()
    assert len(got) == len(rows) == plan.read(spark, data, "orders").count() and {r.idx % 8 for r in rows} == set(range(8))
    for r in rows:
        found = re.search(extract.NAME, r.text, re.IGNORECASE)
        want = f"{found[1]} {found[2]}" if found else None
        assert got[r.msg_id] == want, r.text
        if " " in r.name:
            assert got[r.msg_id] == r.name, r.text


def test_take_of_events_against_its_sql(spark):
    """The events alone, without the rows of the run that fails throughout: row 0 would stand there twice."""
    import duckdb

    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    want = con.execute(queries.SQL["e25_take"]).fetchall()
    assert [tuple(r) for r in queries.e25_take(spark, sf_dir).collect()] == want


def test_split_sides_read_a_written_table(spark, data):
    """A filter on the key of a record must not carry all that makes the record into both sides."""
    train, valid = dataset.split_groups(queries.sft(spark, data), 0.8)
    for side in (train, valid):
        made = side._jdf.queryExecution().optimizedPlan().toString()
        assert "Relation" in made and "pythonUDF" not in made and "Generate" not in made


def test_messages_are_spread_over_tasks(spark):
    """The keys of orders are few bytes, one split, but many messages."""
    assert plan.messages(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() == 3


def test_documents_of_one_row_group_are_dealt_over_tasks(spark):
    """A scan reads a row group in one task, however many documents it holds."""
    keys = queries.t4_normalize_text_key(spark, "/root/testdata/sf0.01")
    assert keys.rdd.getNumPartitions() == 4
    assert keys.count() == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()


def test_equal_cells_are_counted_before_they_are_normalised(spark):
    """Cells that say the same reach full normalisation once."""
    cells = [("a", "x", "x"), ("a", "y y", "y y"), ("a", None, " "), ("a", "\u3000", "\u3000"), ("a", "\uff21 b", "a  b"), ("a", "p q", "p r"), ("b", "p", None), ("b", "", "z")]
    df = spark.createDataFrame(cells * 3, "field string, expected string, predicted string")
    got = score.confusion(df, "field")
    assert "Aggregate" in got._jdf.queryExecution().optimizedPlan().toString().split("ArrowEvalPython")[-1]
    rows = {r.field: (r.exact_count, r.tp, r.fp, r.fn, r.total, round(r.token_f1_avg, 6)) for r in got.collect()}
    assert rows == {"a": (15, 9, 3, 3, 18, round(5.5 / 6, 6)), "b": (0, 0, 3, 3, 6, 0.0)}


def test_many_wards_are_looked_up_where_messages_are_dealt(spark, monkeypatch):
    """Too many wards to broadcast give the same messages, without a sort of all orders."""
    few = sorted(plan.messages(spark, "/root/testdata/sf0.01").select("msg_id", "text").collect())
    monkeypatch.setattr(plan, "WARDS_TO_BROADCAST", 0)
    many = plan.messages(spark, "/root/testdata/sf0.01").select("msg_id", "text")
    steps = many._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in steps and "Sort " not in steps
    assert sorted(many.collect()) == few


def test_run_summary_makes_predictions_once(spark, data):
    """Latencies and full matches read one written table, not messages made anew for each."""
    made = queries._summary(spark, data)
    assert "orders.parquet" not in "".join(made.inputFiles())
    assert {(r.run, r.accuracy) for r in made.collect()} == {(r.run, r.accuracy) for r in queries.e8_full_exact(spark, data).collect()}


def test_examples_let_tasks_keep_their_own_first_rows(spark):
    rows = [(run, i, "c", True, (None, "x"), (str(i), "x")) for run in "ab" for i in range(50)]
    preds = spark.createDataFrame(rows, "run string, id long, category string, ok boolean, expected struct<name:string,phone:string>, prediction struct<name:string,phone:string>")
    got = score.examples(preds, rows=6)
    assert "WindowGroupLimit" in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.run, r.id, r.field, r.row_rank, r.field_rank) for r in got.collect()) == [(run, i, "name", i + 1, 1) for run in "ab" for i in range(6)]


def test_rule_parts_are_found_once(spark, data):
    """The gate reads the parts that were found; it does not find them anew."""
    ruled = plan.rule_pass(plan.messages(spark, data)).select("msg_id", "hints", "is_order")
    assert ruled._jdf.queryExecution().optimizedPlan().toString().count(extract.WARD) == 1


def test_leads_and_parts_between_numbers_change_no_match(spark):
    from orderloom.functions import phone

    said = ["Chị Mai NGÕ 3 Đường Lê Lợi, p. 7, Q 1, HN", "sđt: 0912 345 678, 0912345678", "mã đơn: 0912345678 +84 912345678", "(0912345678)", "", "x", "Thu COD 5k. Ghi chú: a; b", "tp.hcm h Củ Chi Kiệt 3 phố Huế", "số nhà 5 12/3 hẻm"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string")
    for pattern in extract.LEADS:
        pair = [F.regexp_extract_all("t", F.lit(f"(?iU){p}"), F.lit(0)) for p in (pattern, extract.led(pattern))]
        assert df.filter(~pair[0].eqNullSafe(pair[1])).count() == 0, pattern
    found = df.select("t", F.split("t", phone.FOUND, -1).alias("want"), F.regexp_extract_all("t", F.lit(phone.BEFORE), F.lit(1)).alias("got")).collect()
    for r in found:  # a text that ends with a number may give one more empty part
        assert r.got[: len(r.want)] == r.want and not any(r.got[len(r.want):]), r


def _plan(df, mode):
    out = StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def test_messages_are_made_by_methods_short_enough_to_be_compiled(spark, data):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan shows its code only once it has run
    try:
        for df in (plan.messages(spark, data), queries.e8_full_exact(spark, data)):
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", _plan(df, "codegen"))]
            assert sizes and max(sizes) < 8000  # longer ones run uncompiled
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_profile_makes_each_record_once(spark):
    info = dict.fromkeys(("neighborhood", "municipality", "sub_region", "street", "address_number", "country"))
    rows = [("x. [PHONE]", dict(recipient_name="a", note=None, address_raw="b", address_info=info)), ("x. [PHONE]", dict(recipient_name="a", note=None, address_raw="b", address_info=info)), ("Q 1", None), (None, None)]
    df = spark.createDataFrame(rows, f"input_masked string, response {dataset.RESPONSE}")
    out = dataset.profile(df)
    assert _plan(out, "simple").count("Scan ExistingRDD") == 1
    r = out.first()
    assert (r["records"], r["unique_records"], r["duplicate_rows"], r["masked_phone_records"], r["x_dot_or_space_inputs"], r["q_dot_or_space_inputs"]) == (4, 3, 1, 2, 2, 1)
    assert (r["recipient_name_null"], r["note_null"], r["street_null"]) == (2, 4, 4)
    assert [v for v in dataset.profile(df.limit(0)).first()] == [0] * len(out.columns)


def test_equal_sides_count_as_their_normal_forms(spark):
    cells = [(None, None), ("", " 　"), ("a", "a"), ("ﬁ", "fi"), ("A  b", "a b"), ("a", None), (None, "a"), ("a b", "b c"), (" ", " ")]
    df = spark.createDataFrame([("r", e, p) for e, p in cells], "run string, expected string, predicted string")
    r = score.confusion(df, "run").first()
    assert (r["exact_count"], r["tp"], r["fp"], r["fn"], r["total"]) == (6, 3, 2, 2, 9)
    assert abs(r["token_f1_avg"] - 6.5 / 9) < 1e-9
    assert [x[0] for x in df.select(score.exact(F.col("expected"), F.col("predicted"))).collect()] == [True] * 5 + [False] * 3 + [True]


def test_json_text_of_signs_with_escapes(spark):
    from orderloom.functions.jsontext import row_text

    texts = ["plain ăđ", 'a"b', "a\\b", "a\nb\tc\u0001", "", "\u007f 🙂"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [json.loads(r[0])["t"] for r in df.select(row_text(df.schema)).collect()] == texts


def test_numbers_are_masked_one_by_one(spark):
    cases = {
        "sđt 0912345678 ạ": "[PHONE] ạ", "0912345678 và 0912345678": "[PHONE] và [PHONE]", "mã đơn: 0912345678, gọi 0987654321": "mã đơn: 0912345678, gọi [PHONE]",
        "x90912345678 0912345678": "x90912345678 [PHONE]", "01 09123456 78": "01 09123456 78", "MÃ ĐƠN 0912345678": "MÃ ĐƠN 0912345678", "ſố nhà 0912345678 TEL: (+84) 912.345.678": "số nhà 0912345678 [PHONE]",
        "Điện thoại 0912345678": "[PHONE]",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(compact_text(mask_phone(F.col("t")))).collect()] == list(cases.values())


def test_triples_meet_one_record_of_each_class(spark, data, monkeypatch):
    known = resolve.flatten_admin(plan.admin_table(spark, data))
    records = staging.staged(known.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn("ord", F.col("ord") * 7 + F.col("copy")).drop("copy"), "copies")
    spellings = plan.old_wards(spark, data).filter("ord % 7 = 0").select(
        F.when(F.col("ord") % 4 > 0, F.col("old_province_name")).alias("province"), F.when(F.col("ord") % 5 > 0, F.col("old_district_name")).alias("district_hint"),
        F.when(F.col("ord") % 3 > 0, F.col("old_ward_name")).otherwise("Phường").alias("ward"),
    ).distinct()
    keyed = staging.staged(resolve.query_keys(spellings), "keyed")
    columns = [*resolve.TRIPLE, "rank", "ord", "ward_code", "score", "exact_matches", "tie_score"]
    every = resolve.rank_candidates(resolve.candidates(keyed, records)).filter("rank <= 5").select(columns).collect()
    met, candidates = [], resolve.candidates
    monkeypatch.setattr(resolve, "candidates", lambda q, r: (met.append(r.count()), candidates(q, r))[1])
    first = resolve.first_candidates(keyed, records).select(columns).collect()
    assert len(every) > len(spellings.collect()) and sorted(map(tuple, first), key=str) == sorted(map(tuple, every), key=str)
    resolve.resolve_spellings(spellings, records).count()
    assert met[0] == met[1] <= known.count()
