"""Round trips through scans, sinks and streams, as registered queries with SQL.

Each query writes what it derives from the star schema to a fresh path and returns what
it reads back, so that the SQL compares both directions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from orderloom.functions import text
from orderloom.operators import dataset, score
from orderloom.plans import orders as plan
from orderloom.plans.orders import read
from orderloom.plans.queries import SQL_FIELDS, SQL_NEW, SQL_OLD, SQL_PRED, SQL_TEXTS, partly_merged, predictions, query, records, replies
from orderloom.sources import io
from orderloom.sources.staging import fresh_path


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS collapsed FROM documents")
def t9_collapse_ws(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.collapse_ws(F.col("text")).alias("collapsed"))


@query(f"WITH {SQL_TEXTS} SELECT i AS msg_id, text, CASE WHEN i % 5 > 0 THEN note END AS note FROM texts")
def s1_s8_jsonl(spark, sf_dir):
    path = fresh_path(spark, "jsonl")
    io.write_jsonl(plan.messages(spark, sf_dir).select("msg_id", "text", F.when(F.pmod("idx", F.lit(5)) > 0, F.col("fields.note")).alias("note")), path)
    back = io.read_jsonl(spark, path, "msg_id long, text string, note string, _corrupt_record string")
    return back.filter("_corrupt_record is null").select("msg_id", "text", "note")


@query(f"""WITH {SQL_FIELDS} SELECT '{{"msg_id": ' || i || ', "phone": "' || phone || '", "street": ' || CASE WHEN i % 5 > 0 THEN '"' || street || '"' ELSE 'null' END || '}}' AS value FROM f""")
def s8_spaced_jsonl(spark, sf_dir):
    path = fresh_path(spark, "spaced")
    m = plan.messages(spark, sf_dir).select("msg_id", "fields.phone", F.when(F.pmod("idx", F.lit(5)) > 0, F.col("fields.street")).alias("street"))
    io.write_jsonl(m, path, compact=False)
    return spark.read.text(path)


@query(r"""SELECT conv_id, md5('{"conv_id": ' || conv_id || ', "said": [' || string_agg('{"who": "' || role || '", "x": {"text": "' || repeat('\"a, b: \\ c\" ', 40) || '", "none": null}}', ', ' ORDER BY turn) || ']}') AS line FROM conversations GROUP BY conv_id""")
def s8_spaced_nested(spark, sf_dir):
    """Nested rows whose strings hold quotes, separators and backslashes."""
    path = fresh_path(spark, "spaced-nested")
    odd = F.lit('"a, b: \\ c" ' * 40)
    said = F.sort_array(F.collect_list(F.struct("turn", "role")))  # turns of one conversation
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(said.alias("t"))
    rows = rows.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("who"), F.struct(odd.alias("text"), F.lit(None).cast("string").alias("none")).alias("x"))).alias("said"))
    io.write_jsonl(rows, path, compact=False)
    lines = spark.read.text(path)
    return lines.select(F.get_json_object("value", "$.conv_id").cast("long").alias("conv_id"), F.md5("value").alias("line"))


def touch(spark, path: str, text: str) -> None:
    """A small file of a given name, through Spark's file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


_RUN_FILES = "r AS (SELECT n_nationkey AS k, 'model-' || n_regionkey || CASE WHEN n_nationkey % 6 = 1 THEN '(q8)' ELSE '' END AS folder, 'run ' || n_nationkey AS run FROM nation)"


@query(f"WITH {_RUN_FILES} SELECT folder, run, contains(folder, '(q8)') OR contains(run, ' 1') AS chosen FROM r WHERE k % 5 > 0")
def s7_discover_runs(spark, sf_dir):
    """A pair of files for each nation, some in one folder; every fifth lacks its predictions. Besides, a
    folder ``smoke``, which is left out, below a root whose name only begins so."""
    root = fresh_path(spark, "smoketest-runs")
    for n in read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect():  # 25 rows
        k, folder = n.n_nationkey, f"model-{n.n_regionkey}{'(q8)' if n.n_nationkey % 6 == 1 else ''}"
        touch(spark, f"{root}/{folder}/run {k}_summary.json", "{}")
        if k % 5:
            touch(spark, f"{root}/{folder}/run {k}_predictions.jsonl", "{}")
    for kind in ("summary.json", "predictions.jsonl"):
        touch(spark, f"{root}/smoke/run 3_{kind}", "{}")
    chosen = io.discover_runs(spark, root, include=("(q8)", "/run 1")).select("folder", "run", F.lit(True).alias("chosen"))
    return io.discover_runs(spark, root).select("folder", "run").join(chosen.hint("merge"), ["folder", "run"], "left").select("folder", "run", F.coalesce("chosen", F.lit(False)).alias("chosen"))


@query(f"""WITH {SQL_NEW} SELECT province_code, ward_code, ward_name, is_merged, CAST(entries AS INTEGER) AS entries, row_number() OVER (PARTITION BY province_code ORDER BY pos) - 1 AS place FROM state""")
def s2_s11_admin_json(spark, sf_dir):
    path = fresh_path(spark, "admin")
    io.write_admin_json(partly_merged(spark, sf_dir), path)
    back = io.read_admin_json(spark, path, lines=True).select("province_code", F.posexplode("wards").alias("place", "w"))
    return back.select("province_code", "w.ward_code", "w.ward_name", "w.is_merged", F.size("w.merged_from").alias("entries"), F.col("place").cast("long").alias("place"))


@query(f"WITH {SQL_OLD} SELECT CAST(ord AS VARCHAR) AS code, old_ward_name AS name, old_district_name AS parent, row_number() OVER (ORDER BY ord) - 1 AS ord FROM old")
def s3_code_map(spark, sf_dir):
    """The format is one object a file, so its size is that of an administrative table."""
    path = fresh_path(spark, "codes")
    entry = F.struct(F.col("ord").cast("string").alias("key"), F.struct(F.col("old_ward_name").alias("name"), F.col("old_district_name").alias("parent")).alias("value"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", entry.alias("e")))), lambda x: x["e"])
    plan.old_wards(spark, sf_dir).agg(F.to_json(F.map_from_entries(ordered)).alias("value")).write.text(path)
    return io.read_code_map(spark, path, "name string, parent string").select("code", "name", "parent", F.col("ord").cast("long").alias("ord"))


@query(f"WITH {SQL_OLD} SELECT DISTINCT province_code, lower(replace(replace(strip_accents(old_province_name), 'đ', 'd'), 'Đ', 'D')) AS old_province_key FROM old")
def s4_merger_map(spark, sf_dir):
    path = fresh_path(spark, "mergers")
    lists = plan.old_wards(spark, sf_dir).groupBy("province_code").agg(F.collect_set("old_province_name").alias("names"))
    lists.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("province_code", "names")))).alias("value")).write.text(path)
    return io.read_merger_map(spark, path)


def units(spark, sf_dir):
    """The new wards as rows of the unit list."""
    w = partly_merged(spark, sf_dir)
    return w.select(F.col("ward_code").alias("ma"), F.col("province_code").alias("magoc"), F.col("ward_name").alias("ten"), F.lit(None).cast("string").alias("malk"), F.col("merged_from_raw").alias("truocsapnhap"), "pos")


@query(f"WITH {SQL_NEW} SELECT ward_code AS ma, province_code AS magoc, ward_name AS ten FROM new")
def s5_unit_list(spark, sf_dir):
    """One array a file and a file a province, as the list is fetched."""
    path = fresh_path(spark, "units")
    u = units(spark, sf_dir).groupBy("magoc").agg(F.to_json(F.collect_list(F.struct("ma", "magoc", "ten", "malk", "truocsapnhap"))).alias("value"))
    u.select("value", F.col("magoc").alias("part")).write.partitionBy("part").text(path)
    return io.read_units(spark, f"{path}/part=*").select("ma", "magoc", "ten")


@query(f"""WITH {SQL_NEW}, p AS (SELECT province_code, any_value(province_name) AS name, count(*) AS n FROM new GROUP BY province_code)
SELECT province_code, CASE WHEN province_code <> '03' THEN name END AS province, CASE WHEN province_code IN ('02', '03') THEN 0 ELSE n END AS wards FROM p""")
def s6_composite_reply(spark, sf_dir):
    """Replies of one province have broken wards, those of another no separator."""
    w = partly_merged(spark, sf_dir).groupBy("province_code", "province_name").agg(F.collect_list(F.struct(F.col("ward_code").alias("ma"), F.col("ward_name").alias("ten"))).alias("w"))
    head, tail = F.to_json(F.struct(F.col("province_code").alias("ma"), F.col("province_name").alias("ten"))), F.to_json("w")
    broken = F.when(F.col("province_code") == "02", F.substring(tail, 1, 10)).otherwise(tail)
    reply = F.concat(head, F.when(F.col("province_code") == "03", F.lit(" ")).otherwise(F.lit(".synt.")), broken)
    out = io.split_province_reply(w.select("province_code", reply.alias("reply")), "reply")
    return out.select("province_code", F.col("province.ten").alias("province"), F.size("wards").cast("long").alias("wards"))


@query(f"WITH {SQL_FIELDS} SELECT count(*) AS total, count(*) FILTER (i % 5 < 3) AS valid, round(count(*) FILTER (i % 5 < 3) / CAST(count(*) AS DOUBLE), 4) AS json_valid_rate FROM f")
def s9_summary(spark, sf_dir):
    from orderloom.functions.reply import recover_json_safe

    path = fresh_path(spark, "summary")
    io.write_summary(score.json_valid_rate(replies(spark, sf_dir).withColumn("parsed", recover_json_safe(F.col("reply")))), path)
    return io.read_jsonl(spark, path, "total long, valid long, json_valid_rate double")


@query(f"""WITH {SQL_PRED} SELECT run, id, unnest(list_concat(CASE WHEN j % 3 = 0 THEN ['name'] ELSE [] END, CASE WHEN j % 5 = 0 AND ep <> '0900000000' THEN ['phone'] ELSE [] END, CASE WHEN j % 4 = 0 THEN ['note'] ELSE [] END)) AS field FROM pred""")
def s10_error_table(spark, sf_dir):
    path = fresh_path(spark, "errors")
    io.write_errors(score.error_rows(predictions(spark, sf_dir)), path)
    return spark.read.parquet(path).select("run", "id", "field")


@query(f"""WITH {SQL_TEXTS}, told AS (SELECT i, note, trim(regexp_replace(regexp_replace(replace(text, pt, '[PHONE]'), '(?:sđt|đt|phone|tel|sdt) \\[PHONE\\]', '[PHONE]'), '\\s+', ' ', 'g')) AS said FROM texts)
SELECT CASE WHEN i % 5 = 0 THEN 'valid' ELSE 'train' END AS split, 'system,user,assistant' AS roles, said AS user, '{{"note":"' || note || '"}}' AS assistant FROM told""")
def d9_package_splits(spark, sf_dir):
    path = fresh_path(spark, "chat")
    m = dataset.mask_record(plan.messages(spark, sf_dir))
    side = F.when(F.pmod("idx", F.lit(5)) == 0, F.lit("valid")).otherwise(F.lit("train"))
    dataset.package_splits(m.select(side.alias("split"), "input_masked", F.struct(F.col("fields.note").alias("note")).alias("response")), path, "Trích xuất đơn hàng.")
    said = spark.read.schema("messages array<struct<role:string,content:string>>, split string").json(path)
    return said.select(
        "split", F.array_join(F.transform("messages", lambda x: x["role"]), ",").alias("roles"), F.col("messages")[1]["content"].alias("user"), F.col("messages")[2]["content"].alias("assistant")
    )


# ---------------------------------------------------------------- streams
@query(f"WITH {SQL_FIELDS} SELECT i AS msg_id, phone AS phone_number FROM f")
def w1_parse_stream(spark, sf_dir):
    """The messages as a stream of files, parsed batch by batch."""
    from orderloom.streaming.stream import parse_stream

    source, out = fresh_path(spark, "stream-in"), fresh_path(spark, "stream-out")
    plan.messages(spark, sf_dir).select("msg_id", "text").write.parquet(source)
    stream = spark.readStream.schema("msg_id long, text string").parquet(source)
    parse_stream(stream, records(spark, sf_dir), out, fresh_path(spark, "stream-state"), once=True).awaitTermination()
    return spark.read.parquet(f"{out}/batch=*").select("msg_id", "phone_number")


@query("SELECT DISTINCT event_type || ' ' || CAST(floor(value) AS BIGINT) AS text FROM events")
def w2_dedupe_stream(spark, sf_dir):
    """The events' types and rounded values as texts; the watermark spans the table, so each text stays once."""
    from orderloom.streaming.stream import dedupe_stream

    source, out = fresh_path(spark, "events-in"), fresh_path(spark, "events-out")
    said = F.concat_ws(" ", "event_type", F.floor("value").cast("string"))
    read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), said.alias("text")).write.parquet(source)
    kept = dedupe_stream(spark.readStream.schema("ts timestamp, text string").parquet(source), "36500 days")
    query = kept.select("text").writeStream.format("parquet").option("checkpointLocation", fresh_path(spark, "events-state")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema("text string").parquet(out)
