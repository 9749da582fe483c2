"""SimHash near-dedup: binary trie self-join.

A text's fingerprint has 64 bits, each the majority of that bit among the hashes of
its shingles. Two fingerprints are linked when few bits differ. The links are found
by walking a binary trie of the distinct fingerprints against itself: pairs of nodes
are followed down together, the bits in which their paths differ are added up, and a
pair over the budget is dropped with all that lies below it.

The upper part of the walk is done by Spark on a table of node pairs, some bits a
step, until both nodes of a pair hold few enough fingerprints. Their fingerprints
then travel packed, a row for each node pair, and numpy walks the rest. Only classes
matter: pairs whose nodes are of one class by then are not followed, and a node pair
returns at most one link for each of its fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm.common import columns, lean, table, utf8, written
from orderloom.llm.graph import components
from orderloom.llm.neardup import SETS_PER_TASK, hinted

WORDS, SEED, BUDGET = 3, 42, 3
#: Bits that a step of the walk in Spark adds.
STEP = 4
#: Fingerprints of a node that one task takes: at most, at least, and as a share of all.
MOST, LEAST, SHARE = 1 << 18, 1 << 10, 16
#: Node pairs that one task walks.
PAIRS_PER_TASK = 8
#: Comparisons up to which two nodes are compared one by one, and node pairs followed at once.
FEW, FRONT = 64, 1 << 15
#: Shingles hashed at once.
CHUNK = 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The unsigned fingerprint of one text; zero if it has no words."""
    w = text.lower().split()
    if not w:
        return 0
    k = min(words, len(w))
    flat = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(size + 1) - 1
    begins, ends = ends - size, ends[k - 1 :]
    total = np.zeros(2048, np.int64)
    for at in range(0, len(ends), CHUNK):
        pieces = [flat[a:b] for a, b in zip(begins[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=False)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(pieces))
        total += np.bincount((h.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048)
    ones = (total.reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * ones > len(ends), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of each row of ``docs``; ``fp`` is the fingerprint as a signed long."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, offsets = utf8(part.column("text"))
            raw, cut = memoryview(data), offsets.tolist()
            fp = np.array([fingerprint(bytes(raw[a:b]), words) for a, b in zip(cut, cut[1:], strict=False)], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return columns(docs, "doc_id", "text").mapInArrow(lean(run), "doc_id long, fp long")


# --------------------------------------------------------------- the walk in Spark
def prefix(fp: Column, depth: int) -> Column:
    """The node at ``depth`` above a fingerprint: its upper bits as a number."""
    return F.shiftrightunsigned(fp, 64 - depth) if depth else F.lit(0).cast("long")


def node_pairs(fps: DataFrame, budget: int, block: int, step: int = STEP) -> list[tuple[int, DataFrame]]:
    """(depth, node pairs) at which the walk in Spark ends: rows (a, b, d) with a <= b,
    d differing bits so far and at most ``block`` fingerprints under either node."""
    spark = fps.sparkSession
    n = fps.count()
    open_, depth, ended = spark.createDataFrame([(0, 0, 0)], "a long, b long, d int"), 0, []
    if n <= block:
        return [(0, open_)]
    while depth < 64:
        depth += step
        nodes = written(fps.groupBy(prefix(F.col("fp"), depth).alias("p")).agg(F.count(F.lit(1)).alias("n")), "trie-nodes")
        n_nodes = nodes.count()
        side = nodes.withColumn("up", F.shiftrightunsigned("p", step))
        left, right = (hinted(side.withColumnsRenamed({"p": x, "up": u, "n": c}), n_nodes) for x, u, c in (("x", "a", "nx"), ("y", "b", "ny")))
        pairs = open_.join(left, "a").join(right, "b").filter("a < b or x <= y")
        pairs = pairs.withColumn("d", F.col("d") + F.expr(f"bit_count((x ^ y) & {(1 << step) - 1})").cast("int")).filter(F.col("d") <= budget)
        pairs = written(pairs.select(F.col("x").alias("a"), F.col("y").alias("b"), "d", F.greatest("nx", "ny").alias("n")), "trie-pairs")
        ended.append((depth, pairs.filter(F.col("n") <= block).select("a", "b", "d")))
        open_ = pairs.filter(F.col("n") > block).select("a", "b", "d")
        if open_.isEmpty():
            break
    return ended


def packed_nodes(fps: DataFrame, depth: int, pairs: DataFrame) -> DataFrame:
    """(p, fps): the sorted fingerprints under each node of ``pairs``."""
    ids = written(pairs.select(F.col("a").alias("p")).unionByName(pairs.select(F.col("b").alias("p"))).distinct(), "trie-ids")

    def pack(group: pa.Table) -> pa.Table:
        return pa.table({"p": group.column("p")[:1], "fps": pa.array([np.sort(group.column("fp").to_numpy().view(np.uint64)).tobytes()], pa.binary())})

    under = fps.select(prefix(F.col("fp"), depth).alias("p"), "fp").join(hinted(ids, ids.count()), "p", "left_semi")
    return written(under.groupBy("p").applyInArrow(lean(pack), "p long, fps binary"), "trie-packed")


# --------------------------------------------------------------- the walk in numpy
class Classes:
    """Classes of numbered things, joined many pairs at once; ``root`` is each one's least member."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> bool:
        """Joins i[k] with j[k]; tells whether any class changed."""
        changed = False
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return changed
            changed, i, j, a, b = True, i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (up := self.root[self.root]) is not None and (up != self.root).any():
                self.root = up


def linked(a: np.ndarray, b: np.ndarray | None, depth: int, differ: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): links that join the classes of sorted fingerprints under two nodes at
    ``depth`` whose paths differ in ``differ`` bits, or under one node (``b`` None)."""
    own = b is None
    every = a if own else np.concatenate([a, b])
    shift = 0 if own else len(a)
    classes = Classes(len(every))
    ones: dict[int, np.ndarray] = {}
    breaks = np.arange(len(every))  # how often the class changes up to each place
    z = np.zeros(1, np.int64)
    stack = [(depth, z, z + len(a), z + shift, z + len(every), z + differ)]
    while stack:
        level, lo1, hi1, lo2, hi2, d = stack.pop()
        one = (breaks[hi1 - 1] == breaks[lo1]) & (breaks[hi2 - 1] == breaks[lo2]) & (classes.root[lo1] == classes.root[lo2])
        lo1, hi1, lo2, hi2, d = (x[~one] for x in (lo1, hi1, lo2, hi2, d))
        if len(lo1) > FRONT:
            half = len(lo1) // 2
            stack += [(level, *(x[s] for x in (lo1, hi1, lo2, hi2, d))) for s in (slice(half), slice(half, None))]
            continue
        small = ((hi1 - lo1) * (hi2 - lo2) <= FEW) | (level == 64)
        if small.any():
            l1, n1, l2, n2 = lo1[small], (hi1 - lo1)[small], lo2[small], (hi2 - lo2)[small]
            size = n1 * n2
            k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            wide = np.repeat(n2, size)
            i, j = np.repeat(l1, size) + k // wide, np.repeat(l2, size) + k % wide
            near = (i < j) & (np.bitwise_count(every[i] ^ every[j]) <= budget)
            if near.any() and classes.join(i[near], j[near]):
                breaks = np.concatenate([[0], np.cumsum(classes.root[1:] != classes.root[:-1])])
        lo1, hi1, lo2, hi2, d = (x[~small] for x in (lo1, hi1, lo2, hi2, d))
        if not len(lo1):
            continue
        if level not in ones:
            ones[level] = np.concatenate([[0], np.cumsum((every >> np.uint64(63 - level)) & np.uint64(1))]).astype(np.int64)
        mid1, mid2 = (hi - (ones[level][hi] - ones[level][lo]) for lo, hi in ((lo1, hi1), (lo2, hi2)))
        same, below = lo1 == lo2, []
        for x in (0, 1):
            for y in (0, 1):
                p1, q1, p2, q2 = (mid1 if x else lo1), (hi1 if x else mid1), (mid2 if y else lo2), (hi2 if y else mid2)
                go = (p1 < q1) & (p2 < q2) & (d + (x != y) <= budget) & ~(same & (x > y))
                below.append([t[go] for t in (p1, q1, p2, q2, d + (x != y))])
        if sum(len(t[0]) for t in below):
            stack.append((level + 1, *(np.concatenate(t) for t in zip(*below, strict=True))))
    moved = np.flatnonzero(classes.root != np.arange(len(every)))
    return every[moved], every[classes.root[moved]]


def pair_links(rows: DataFrame, depth: int, budget: int) -> DataFrame:
    """Links (u, v) of rows (a, b, d, fa, fb): node pairs with their packed fingerprints."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                a, b, d = (part.column(c)[i].as_py() for c in ("a", "b", "d"))
                fa, fb = (np.frombuffer(part.column(c)[i].as_buffer(), np.uint64) for c in ("fa", "fb"))
                u, v = linked(fa, None if a == b else fb, depth, d, budget)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return rows.mapInArrow(lean(run), "u long, v long")


def fingerprint_classes(fps: DataFrame, budget: int = BUDGET, block: int | None = None) -> DataFrame:
    """(fp, root): each distinct fingerprint of ``fps`` that is linked with another, and its class."""
    n = fps.count()
    links = None
    for depth, pairs in node_pairs(fps, budget, block or max(LEAST, min(MOST, n // SHARE))):
        packed, n_pairs = packed_nodes(fps, depth, pairs), pairs.count()
        rows = pairs.hint("merge").join(packed.select(F.col("p").alias("a"), F.col("fps").alias("fa")), "a")
        rows = rows.hint("merge").join(packed.select(F.col("p").alias("b"), F.col("fps").alias("fb")), "b")
        found = written(pair_links(rows.repartition(max(6, n_pairs // PAIRS_PER_TASK)), depth, budget), "fp-links")
        links = found if links is None else links.unionByName(found)
    return components(links.distinct(), max(6, n // SETS_PER_TASK)).select(F.col("node").alias("fp"), "root")


def simhash_components(docs: DataFrame, words: int = WORDS, budget: int = BUDGET, block: int | None = None) -> DataFrame:
    """Classes of documents whose fingerprints are linked.

    Returns doc_id, fingerprint (16 lower-case hex digits), component_id (least doc_id
    reachable over links, itself included): one row for each row of ``docs``. A-Z are
    lowered, words are runs outside the ASCII spaces, shingles are ``words`` consecutive
    words joined by spaces, repeats included; a shorter text is one shingle. Null and
    empty texts and those of spaces have the fingerprint zero, linked like any other.
    Fingerprints are linked at ``budget`` or fewer differing bits, equal ones always.
    A row without an id has a fingerprint but no class (null) and links nothing; rows
    that repeat a doc_id are texts of their own, and each has the class of its own
    fingerprint. An empty table gives no rows; extra columns are ignored. All links are
    found. ``block``: fingerprints of a node that one task takes.
    """
    meta = written(fingerprints(docs, words), "fingerprints")
    fps = written(meta.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc")), "fp-distinct")
    roots = written(fingerprint_classes(fps.select("fp"), budget, block), "fp-roots")
    n_roots, n = roots.count(), fps.count()
    rooted = fps.join(hinted(roots, n_roots), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = written(rooted.groupBy("root").agg(F.min("doc").alias("component_id")), "fp-least")
    of = written(rooted.join(hinted(least, n), "root").select("fp", "component_id"), "fp-components")
    out = meta.join(hinted(of, n), "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component.alias("component_id"))


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
