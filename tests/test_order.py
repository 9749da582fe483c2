"""Numbering, selection by rank, greedy fill, and JSON text."""

import json
import random

import pytest
from pyspark.sql import functions as F

from orderloom.functions import phone
from orderloom.functions.jsontext import row_text
from orderloom.operators import dataset, order, score
from orderloom.sources import io


def test_numbers_in_order(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), rng.randint(0, 20)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, v int").repartition(7)
    got = {r.id: r.no for r in order.numbered(df, "v", "id").collect()}
    assert got == {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    got = {r.id: r.no for r in order.numbered(df, -F.col("v"), "id", by="g").collect()}
    for g in ("a", "b", None):
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))
        assert [got[r[0]] for r in mine] == list(range(len(mine)))
    assert order.numbered(df.limit(0), "v").count() == 0
    plan = order.numbered(df, "v", "id", by="g")._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_percentiles_by_rank(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.choice([1.5, 1.5, rng.random() * 9])) for i in range(301)] + [(900, "one", 4.0), (901, "none", None)]
    df = spark.createDataFrame(rows, "id long, run string, x double").repartition(5)
    got = {r.run: (r.p50, r.p95, r.p99) for r in order.percentiles_by(df, "run", "x", "id").collect()}
    want = {r.run: tuple(r.p) for r in df.groupBy("run").agg(F.percentile("x", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p")).collect() if r.p}
    assert got.keys() == want.keys() and all(a == pytest.approx(b) for k in want for a, b in zip(got[k], want[k], strict=True))


def greedy(sizes, goal):
    full, out = 0, []
    for n in sizes:
        if full + n <= goal:
            full += n
            out.append(True)
        else:
            out.append(False)
    return out


@pytest.mark.parametrize("bits", [0, 3])
def test_greedy_fill(spark, bits):
    rng = random.Random(bits)
    for goal in (5, 40, 333, 10_000):
        groups = [(rng.getrandbits(60), rng.choice([1, 1, 2, 7, 60])) for _ in range(80)]
        df = spark.createDataFrame(groups, "k long, n long").withColumn("bucket", F.shiftright("k", 60 - bits))
        got = {r.k for r in df.filter(order.greedy_fill(df, goal)).collect()}
        groups.sort()
        assert got == {k for (k, _), fits in zip(groups, greedy([n for _, n in groups], goal), strict=True) if fits}


def test_exact_split_tries_later_groups(spark):
    rows = [("a",)] * 6 + [("b",)] * 2 + [("c",)] * 2
    df = spark.createDataFrame(rows, "t string")
    for seed in range(1, 6):
        train, valid = dataset.split_groups(df, 0.5, seed, exact=True)
        assert train.count() == 4 and {r.t for r in train.collect()} == {"b", "c"} and valid.count() == 6
    assert [x.count() for x in dataset.split_groups(df.limit(0), exact=True)] == [0, 0]


NESTED = "z int, a array<struct<q:string,b:map<string,struct<y:int,c:boolean>>>>, s struct<n:string,d:double>"


def test_json_text_is_that_of_python(spark):
    rows = [
        (1, [{"q": 'say "a, b": \\ \n é', "b": {"k:2": {"y": 1, "c": True}, "k,1": {"y": None, "c": None}}}, {"q": None, "b": {}}], {"n": "", "d": 1.5}),
        (None, [], None), (3, None, {"n": None, "d": None}),
    ]
    df = spark.createDataFrame(rows, NESTED)
    for ordered in (True, False):
        got = [r.t for r in df.select(row_text(df.schema, ordered=ordered).alias("t")).collect()]
        for (z, a, s), line in zip(rows, got, strict=True):
            assert json.loads(line) == {"z": z, "a": a, "s": s}
            if ordered:
                assert line == json.dumps({"z": z, "a": a, "s": s}, sort_keys=True, ensure_ascii=False)
    twice = spark.createDataFrame([r for r in rows for _ in range(2)], NESTED)
    assert dataset.duplicate_stats(twice).first().unique_records == 3


def test_long_strings_are_written_spaced(spark, tmp_path):
    long = 'x"y, z: ' * 130_000
    io.write_jsonl(spark.createDataFrame([(1, long, None)], "id long, t string, n string"), f"{tmp_path}/s", compact=False)
    line = spark.read.text(f"{tmp_path}/s").first().value
    assert line == json.dumps({"id": 1, "t": long, "n": None})


def test_masks_beside_control_characters(spark):
    texts = ["a\u0001b 0912345678", "\u0001", "0912345678\u0001", "sđt: 0912 345 678\u0001\u0001x 091234567", "", None, "mã đơn: 0912345678 và 0987654321", "1" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.m for r in df.orderBy("i").select(phone.mask_phone(F.col("t")).alias("m")).collect()]
    assert got == ["a\u0001b [PHONE]", "\u0001", "[PHONE]\u0001", "[PHONE]\u0001\u0001x 091234567", "", "", "mã đơn: 0912345678 và [PHONE]", "1" * 5000]


def test_nothing_predicted_twice_is_the_same(spark):
    rows = [(1, {"a": "x"}, 1), (2, None, 2), (3, None, 3)]
    left = spark.createDataFrame(rows, "id long, prediction struct<a:string>, seq long")
    right = spark.createDataFrame([(1, {"a": "y"}, 1), (1, {"a": "x"}, 2), (2, None, 3), (3, {"a": "x"}, 4)], "id long, prediction struct<a:string>, seq long")
    r = score.compare_runs(left, right).first()
    assert (r.shared, r.same) == (3, 2)
