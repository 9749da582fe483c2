"""Mixing sources to target weights with a multivariate-hypergeometric tree.

The documents of a source, in the order of a keyed hash, form a line of blocks of about
``block_words`` words. As many whole times as its target holds a source is taken with all
its blocks; of the part of a time that is left, blocks are drawn. A binary tree over the
output shards splits the exact numbers of blocks of each source, those to be taken whole,
those to be drawn and those to be spared: at a node the left half receives a multivariate
hypergeometric draw of what the node has, the right half the rest. Each source's blocks
are permuted; a shard has the next ones of the permuted order, as many as its numbers say,
and draws the first of those that may be drawn. The blocks of a shard are ordered by a
keyed hash within it.

Blocks hold whole documents and so differ in words: drawn ones are taken in permuted order,
then spared ones, until the target is met to the word; one document a source is cut there.
A draw depends on the seed and the node alone, so tasks draw again what they need: nothing
is broadcast, and a lost task gives the same answer again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderloom.llm.common import U, columns, lean, mix, quoted, table, written

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
BLOCK_WORDS = 1024
#: Words of a shard, and the least number of shards.
SHARD_WORDS, SHARDS = 16_000_000, 8
ROWS_PER_BUCKET = 20_000
#: Blocks of the drawing order whose words are summed before the sums are.
BLOCKS_PER_BUCKET = 4096
#: Blocks of all sources up to which a draw stays within the generator's range; beyond, blocks grow.
MOST_BLOCKS = 500_000_000


def word_count(text):
    """Number of maximal runs outside the six ASCII spaces; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    return columns(docs, "doc_id", "text", "source").select("doc_id", "source", word_count(F.col("text")).alias("size"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, rank, source_size, target) with one row per source.

    Sources rank by code point, null last; their weights are ``weights`` repeating.
    Targets share the total size by weight. One that passes ``max_epochs`` times
    its source's size stops there and the excess is shared again by weight: the
    end of that is a level L with target = min(cap, weight * L), found here from
    running sums over the sources in the order in which they reach their caps.
    The windows span the sources' summary, never documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    every = Window.partitionBy(F.lit(0))
    ranked = per.withColumn("rank", rank).withColumns({"weight": w, "cap": F.col("source_size") * float(max_epochs)})
    by_cap = every.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    known = ranked.withColumn("level", level)
    # the first source whose cap the level does not reach fixes the level for it and all later ones
    held = F.min(F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level")))).over(every)
    return known.withColumn("final", held["level"]).select(
        "source", "rank", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("final"), F.col("cap"))).alias("target")
    )


def line_places(sizes: DataFrame, n_rows: int, seed: int) -> DataFrame:
    """Adds ``place``: where each document begins on its source's permuted line.

    A prefix sum in two levels: documents fall by keyed hash into buckets of about
    ``ROWS_PER_BUCKET`` rows, so a source that holds a third of all rows is spread
    over as many tasks as it needs.
    """
    bits = max(0, int(np.ceil(np.log2(max(1, n_rows / ROWS_PER_BUCKET)))))
    keyed = sizes.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn(
        "bucket", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    )
    per = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    per = per.withColumn("base", F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size"))
    inner = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    per = per.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), "base").hint("merge")
    return placed.join(per, placed["source"].eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2"))).select(
        "doc_id", "source", "size", (F.col("base") + F.col("inner")).alias("place")
    )


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where ``index`` goes in a permutation of range(size), by its key: a Feistel network, walked on until it is inside."""
    out, todo = index.astype(U), np.arange(len(index))
    half = ((np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(U)
    mask = (U(1) << half) - U(1)
    size, key = size.astype(U), mix(key.astype(U))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for step in range(4):
            left, right = right, left ^ (mix(right + k + U(step)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


class QuotaTree:
    """Exact numbers of blocks of each source divided among ``shards`` leaves.

    ``whole``, ``drawn``, ``spare``: of each source, blocks that are taken whatever
    is drawn, that are to be drawn, and that are to be left.
    """

    def __init__(self, whole: list[int], drawn: list[int], spare: list[int], shards: int, seed: int):
        self.have, self.shards, self.seed = np.array([whole, drawn, spare], np.int64), shards, seed
        self._left: dict[tuple[int, int], np.ndarray] = {}

    def left(self, lo: int, hi: int, have: np.ndarray) -> np.ndarray:
        """What of ``have`` the shards [lo, mid) receive, mid being the middle."""
        if (lo, hi) not in self._left:
            mid, total = (lo + hi) // 2, int(have.sum())
            rng = np.random.Generator(np.random.PCG64([self.seed, lo, hi]))
            draw, left_total = np.zeros(have.size, np.int64), round(total * (mid - lo) / (hi - lo))
            rest = total
            for s, good in enumerate(have.ravel().tolist()):  # a multivariate draw is a chain of plain ones
                rest -= good
                if good and left_total:
                    draw[s] = rng.hypergeometric(good, rest, left_total) if rest else left_total
                left_total -= int(draw[s])
            self._left[lo, hi] = draw.reshape(have.shape)
        return self._left[lo, hi]

    def place(self, source: np.ndarray, last: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, taken) of blocks by their number ``at`` in their source's permuted order:
        among those taken whole, or with ``last`` among those to be drawn and left."""
        leaf, taken = np.zeros(len(at), np.int64), ~last
        none = np.zeros(self.have.shape[1], np.int64)
        todo = [(0, self.shards, self.have, none, none, np.arange(len(at)))]
        while todo:
            lo, hi, have, whole, draws, rows = todo.pop()
            if not len(rows):
                continue
            of, is_last = source[rows], last[rows]
            if hi - lo == 1:
                leaf[rows] = lo
                taken[rows] |= at[rows] < (draws + have[1])[of]
                continue
            got, mid = self.left(lo, hi, have), (lo + hi) // 2
            ends = whole + got[0], draws + got[1] + got[2]
            goes = at[rows] < np.where(is_last, ends[1][of], ends[0][of])
            todo += [(lo, mid, got, whole, draws, rows[goes]), (mid, hi, have - got, *ends, rows[~goes])]
        return leaf, taken


def block_plan(size: int, target: int, block: int) -> tuple[int, int, int]:
    """(whole, drawn, spare) blocks of a source of ``size`` words."""
    times, rest = divmod(target, size) if size else (0, 0)
    blocks = -(-size // block)
    drawn = min(blocks, (2 * rest + block) // (2 * block))
    return times * blocks, drawn, blocks - drawn


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
    block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, shards: int = SHARDS, seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """(pieces, places).

    pieces: shard, position (order in the shard), source, rank, place, doc_id, copy
    (0-based), n_words - the first words of a copy of a document, nearly always all, that
    the mix takes; (rank, place) tells rows apart, whatever their ids.
    places: doc_id, source, rank, place, size, source_size, target for every row.

    A document without words gives no piece and target rows all the same; no
    document is taken more than ``max_epochs`` times; equal seeds give equal mixes;
    rows that repeat a doc_id are separate documents that tie in the permuted
    order (which of them a cut falls in is then open; both have the same id and
    source). An empty table gives empty results. Extra columns are ignored. ``shards``:
    the least number of shards, which are more where they would pass ``shard_words``.
    """
    n_rows = docs.select("doc_id").count()
    sizes = written(sized(docs), "mix-sizes", parts=max(6, n_rows // 5_000))
    targets = written(source_targets(sizes, weights, max_epochs), "mix-targets")
    placed = line_places(sizes, n_rows, seed)
    t = targets.select(F.col("source").alias("s2"), "rank", "source_size", "target").hint("merge")
    placed = written(placed.join(t, placed["source"].eqNullSafe(F.col("s2"))).drop("s2"), "mix-places", parts=max(6, n_rows // ROWS_PER_BUCKET))

    # two numbers per source: the summary that every task of the tree starts from
    want = F.round("target").cast("long")
    known = targets.select("rank", "source_size", want.alias("want")).orderBy("rank").collect()
    blocks = sum(-(-r["want"] // block_words) for r in known)
    block = block_words * max(1, -(-blocks // MOST_BLOCKS))
    plans = [block_plan(r["source_size"], r["want"], block) for r in known]
    leaves = max(shards, -(-blocks * block_words // shard_words))

    worded = placed.filter("size > 0").withColumn("want", want).withColumns({"times": F.expr("want div source_size"), "block": F.expr(f"place div {block}")})
    copies = worded.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), "times")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = QuotaTree(*([p[k] for p in plans] for k in range(3)), leaves, seed)
        line = np.array([-(-r["source_size"] // block) for r in known], np.int64)
        whole = np.array([p[0] for p in plans], np.int64)
        for batch in batches:
            source, at, copy, times = (batch.column(c).to_numpy() for c in ("rank", "block", "copy", "times"))
            last = copy == times
            number = np.where(last, at, copy * line[source] + at)
            turn = permuted(number, np.where(last, line[source], whole[source]), 2 * source + last + 1000 * seed)
            leaf, taken = tree.place(source, last, turn)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(taken), pa.array(turn)], [*batch.schema.names, "shard", "drawn", "turn"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in copies.schema)
    dealt = written(copies.mapInArrow(lean(deal), f"{schema}, shard long, drawn boolean, turn long"), "mix-dealt", parts=max(6, n_rows // ROWS_PER_BUCKET))

    # of the last time: drawn blocks in permuted order, then the others, as far as the target goes
    part = dealt.filter("copy = times").withColumn("bucket", F.expr(f"turn div {BLOCKS_PER_BUCKET}"))
    per = part.groupBy("rank", "drawn", "bucket").agg(F.sum("size").alias("words"))
    per = per.withColumn("base", F.sum("words").over(Window.partitionBy("rank").orderBy(F.desc("drawn"), "bucket")) - F.col("words")).drop("words")
    inner = Window.partitionBy("rank", "drawn", "bucket").orderBy("turn", "place").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(per.hint("merge"), ["rank", "drawn", "bucket"])
    left = F.col("want") - F.col("times") * F.col("source_size") - F.col("base") - F.col("inner")
    cols = ("shard", "source", "rank", "place", "doc_id", "copy", "block", "n_words")
    part = part.withColumn("n_words", F.least("size", left)).filter("n_words > 0").select(*cols)
    taken = dealt.filter("copy < times").withColumn("n_words", F.col("size")).select(*cols).unionByName(part)
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "rank", "copy", "block"), "rank", "copy", "block", "place")
    pieces = taken.withColumn("position", F.row_number().over(order))
    pieces = pieces.select("shard", "position", "source", "rank", "place", "doc_id", "copy", "n_words")
    return pieces, placed.select("doc_id", "source", "rank", "place", "size", "source_size", "target")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents: a row, with all columns, for each copy that is taken.

    A copy taken in part (where a source's target falls: one document a source) has
    its first words, joined by one space, and their ``n_chars``. Rows come shard by
    shard in the order of the mix (a copy where its first piece is). Rows that repeat a
    doc_id are told apart by number; rows without an id stay if they are taken; null and
    empty texts are never taken; an empty table gives no rows; extra columns of any name
    are kept.
    """
    pieces, places = mix_sources(docs, **how)
    took = pieces.groupBy("rank", "place", "copy").agg(F.sum("n_words").alias("take"), F.min(F.struct("shard", "position")).alias("at"))
    mine = places.filter("size > 0").select("doc_id", "source", "rank", "place", "size").join(took.hint("merge"), ["rank", "place"])
    repeats = columns(docs, "doc_id").groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count() > 0
    # a row travels as one struct, so that its columns can have any names
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.struct(*quoted(docs)).alias("row"), F.col("doc_id").alias("id"), word_count(F.col("text")).alias("words"), source.alias("from"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("words") == F.col("size"))
    if repeats:
        rows = rows.withColumn("no", F.row_number().over(Window.partitionBy("id", "words", "from").orderBy("row.text")))
        mine = mine.withColumn("nth", F.dense_rank().over(Window.partitionBy("doc_id", "size", "source").orderBy("place")))
        same = same & (F.col("no") == F.col("nth")) & F.col("from").eqNullSafe(F.col("source"))
    out = rows.join(mine.hint("merge"), same)
    old = {c: F.col("row").getField(c) for c in docs.columns}
    cut = F.array_join(F.slice(F.regexp_extract_all(old["text"], F.lit(WORDS), 0), 1, F.col("take").cast("int")), " ")
    out = out.withColumn("taken_text", F.when(F.col("take") < F.col("words"), cut).otherwise(old["text"]))
    fixed = {"text": F.col("taken_text")}
    if "n_chars" in docs.columns:
        fixed["n_chars"] = F.when(F.col("take") < F.col("words"), F.length("taken_text").cast(docs.schema["n_chars"].dataType)).otherwise(old["n_chars"])
    # the files hold the shards one after the other, each in the order of its blocks
    dealt = out.repartitionByRange("at.shard").sortWithinPartitions("at.shard", "at.position")
    return dealt.select(*[fixed.get(c, old[c]).alias(c) for c in docs.columns])


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document, and where the mix has it:
    pieces (copies, the last one often in part), shards, first_shard and first_position (null if none).

    Documents without words and rows without or with repeated ids as in ``mix_sources``, one row for
    each row of ``docs``; an empty table gives no rows; extra columns are ignored.
    """
    pieces, places = mix_sources(docs, **how)
    took = pieces.groupBy(F.col("rank").alias("r2"), F.col("place").alias("p2")).agg(
        F.sum("n_words").alias("n"), F.count(F.lit(1)).alias("pieces"), F.count_distinct("shard").alias("shards"), F.min(F.struct("shard", "position")).alias("first")
    )
    # a place on a source's line belongs to one document with words; those without take nothing
    mine = (places["rank"] == F.col("r2")) & (places["place"] == F.col("p2")) & (places["size"] > 0)
    out = places.join(took.hint("merge"), mine, "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "size", "source_size", "target", F.coalesce("n", zero).alias("taken"), F.coalesce("pieces", zero).alias("pieces"),
        F.coalesce("shards", zero).alias("shards"), F.col("first.shard").alias("first_shard"), F.col("first.position").cast("long").alias("first_position"),
    )


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))
