"""Benchmark decontamination by size-partitioned MinHash containment search.

Native DataFrame operations only. Test items are partitioned by the number m of
their five-word shingles (powers of two). A partition fixes how many shingles an
item may miss and still be contained, and from that the length k of its bottom-k
MinHash sketch. Long documents are not sketched whole, where a short item would
vanish: each of their shingles is looked up among the sketches. An item with at
least k - missing sketch shingles in a document is a candidate - a necessary
condition for containment, so none is lost - and is verified by counting all its
shingles, as text, in the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm.common import columns, quoted, table, written

SHINGLE = 5
PERCENT = 80
#: Items, and documents, for each task that makes a small table of them.
ROWS_PER_TASK = 20_000
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; null text gives an empty array."""
    clean = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.length(clean) > 0, F.split(clean, " ")).otherwise(F.array().cast("array<string>"))


def shingle_hashes(words: Column, n: int) -> Column:
    at = F.sequence(F.lit(0), F.size(words) - n)
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.xxhash64(*[words[i + j] for j in range(n)])))


def shingle_texts(words: Column, n: int) -> Column:
    at = F.sequence(F.lit(0), F.size(words) - n)
    return F.when(F.size(words) >= n, F.array_distinct(F.transform(at, lambda i: F.concat_ws(" ", *[words[i + j] for j in range(n)]))))


def item_shingles(benchmark: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """item_id, n (words a shingle), grams (distinct shingles as text), m.

    An item of fewer words than a shingle is one shingle of all its words; an item
    without words is left out.
    """
    items = columns(benchmark, "item_id", "text").dropDuplicates().withColumn("words", words_of(F.col("text"))).filter(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(shingle))
    grams = F.coalesce(*[F.when(n == k, shingle_texts(F.col("words"), k)) for k in range(1, shingle + 1)])
    return items.select("item_id", n.alias("n"), grams.alias("grams")).withColumn("m", F.size("grams"))


def sketches(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """item_id, n, m, need, h: one row for each shingle of each bottom-k sketch."""
    upper = F.pow(F.lit(2), F.ceil(F.log2("m"))).cast("int")  # the partition's upper size
    missing = F.col("m") - F.ceil(F.col("m") * percent / F.lit(100)).cast("int")
    spare = upper - F.ceil(upper * percent / F.lit(100)).cast("int")
    hashed = items.withColumn(
        "hashes", F.sort_array(F.array_distinct(F.transform("grams", lambda g: F.xxhash64(F.lit(11), g))))
    ).withColumns({"missing": missing, "k": F.least(F.col("m"), 2 * spare + 8)})
    kept = hashed.withColumn("grams", F.filter("grams", lambda g: F.xxhash64(F.lit(11), g) <= F.col("hashes")[F.col("k") - 1]))
    one = kept.select("item_id", "n", "m", F.greatest(F.size("grams") - F.col("missing"), F.lit(1)).alias("need"), F.explode("grams").alias("gram"))
    ws = F.split("gram", " ")
    h = F.coalesce(*[F.when(F.col("n") == k, F.xxhash64(*[ws[j] for j in range(k)])) for k in range(1, SHINGLE + 1)])
    return one.select("item_id", "n", "m", "need", h.alias("h"))


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a written table of known row count: broadcast below ``limit`` rows of fixed width, else merge."""
    return df.hint("broadcast" if rows <= limit else "merge")


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """Pairs (doc_id, item_id, item_shingles, shared, containment) of at least ``percent``.

    Containment is the share of the item's distinct shingles that occur in the
    document. Words are runs of letters and digits in lower case. Null and empty
    texts match nothing on either side; equal items are separate rows; of two texts
    under one item_id the one that is contained most counts; rows that
    repeat a doc_id are searched each for itself and reported once, by the text that holds
    most of the item; rows without an id are reported with a null, once for each different text;
    empty tables give no rows; extra columns are ignored.
    """
    found = contained_rows(docs, benchmark, percent, shingle)
    by = ("no_id", "id", "item_id")
    nameless = F.when(F.col("no_id"), F.col("body"))
    best = found.groupBy(*by, nameless.alias("own")).agg(F.max(F.struct((F.col("shared") / F.col("item_shingles")).alias("c"), "item_shingles", "shared")).alias("b"))
    return best.select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "item_id", "b.item_shingles", "b.shared", F.round(F.col("b.shared") / F.col("b.item_shingles"), 4).alias("containment")
    )


def row_keys(docs: DataFrame) -> DataFrame:
    """Adds what tells rows apart in joins: whether the id is missing, the id (0 then), the hash of the text."""
    return docs.withColumns({"no_id": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0)), "body": F.xxhash64("text")})


KEYS = ["no_id", "id", "body"]


def contained_rows(docs: DataFrame, benchmark: DataFrame, percent: int, shingle: int) -> DataFrame:
    """KEYS of rows of ``docs`` with item_id, item_shingles and shared of each item text that they contain."""
    rows = row_keys(columns(docs, "doc_id", "text")).select(*KEYS, "text")
    few = max(6, benchmark.select("item_id").count() // ROWS_PER_TASK)
    items = written(item_shingles(benchmark, shingle), "bench-items", parts=few)
    sketch = written(sketches(items, percent), "bench-sketches", parts=few)
    sizes = [r["n"] for r in items.select("n").distinct().collect()]  # at most ``shingle`` values
    n_sketch = sketch.count()

    worded = rows.select(*KEYS, words_of(F.col("text")).alias("words"))
    hits = None
    for n in sorted(sizes):
        probe = worded.select(*KEYS, F.explode(shingle_hashes(F.col("words"), n)).alias("h"))
        found = probe.join(small(sketch.filter(F.col("n") == n), n_sketch), "h")
        hits = found if hits is None else hits.unionByName(found)
    none = "no_id boolean, id long, body long, item_id long, item_shingles int, shared int"
    if hits is None:
        return docs.sparkSession.createDataFrame([], none)
    # (document, sketch shingle) pairs are few; the partial aggregate removes repeats where they arise
    pairs = hits.groupBy(*KEYS, "item_id", "need", "h").agg(F.first("n").alias("n")).groupBy(*KEYS, "item_id").agg(
        F.count(F.lit(1)).alias("got"), F.min("need").alias("need")
    ).filter("got >= need").select(*KEYS, "item_id")
    pairs = written(pairs, "bench-pairs", parts=max(6, rows.select("id").count() // ROWS_PER_TASK))

    # exact check: each candidate's document once, its items' shingles beside it
    texts = rows.join(pairs.select(*KEYS).distinct().hint("merge"), KEYS, "left_semi")
    grams = texts.withColumn("words", words_of(F.col("text"))).select(*KEYS, *[shingle_texts(F.col("words"), n).alias(f"grams{n}") for n in sorted(sizes)])
    both = pairs.hint("merge").join(grams, KEYS).join(small(items, items.count(), 20_000), "item_id")
    have = F.coalesce(*[F.when(F.col("n") == n, F.col(f"grams{n}")) for n in sorted(sizes)])
    shared = both.select(*KEYS, "item_id", F.col("m").alias("item_shingles"), F.size(F.array_intersect("grams", have)).alias("shared"))
    return shared.filter(F.col("shared") * 100 >= F.col("item_shingles") * percent)


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that contain no item, all their columns kept.

    Null and empty texts stay; of a repeated id all rows go once one of its texts contains
    an item; of rows without an id those whose own text does; an empty benchmark keeps all,
    an empty table gives no rows; extra columns of any name are kept.
    """
    found = contained_rows(docs, benchmark, percent, SHINGLE)
    key = F.struct("no_id", F.when(F.col("no_id"), F.col("body")).otherwise(F.col("id")).alias("k"))
    bad = written(found.select(key.alias("key")).distinct(), "bench-bad", parts=max(6, docs.select("doc_id").count() // ROWS_PER_TASK))
    whole = docs.select(F.struct(*quoted(docs)).alias("row"), F.col("doc_id"), F.col("text"))
    left = row_keys(whole).withColumn("key", key).join(bad.hint("merge"), "key", "left_anti")
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) AS g FROM w WHERE len(ws) >= 5),
v AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark),
b AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) AS g FROM v WHERE len(ws) >= 5),
m AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id)
SELECT doc_id, item_id, CAST(any_value(n) AS INTEGER) AS item_shingles, CAST(count(*) AS INTEGER) AS shared,
       round(count(*) / CAST(any_value(n) AS DOUBLE), 4) AS containment
FROM d JOIN b USING (g) JOIN m USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) * 100 >= any_value(n) * 80
"""
