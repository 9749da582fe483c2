"""MinHash near-dedup: chosen-path set similarity join.

Each set of word shingles is embedded as minwise tokens. A tree of the chosen-path
join branches documents by tokens: at a node every token is chosen with probability
1 / (similarity * tokens), by a hash of the node and the token, so that similar sets
choose alike; a document goes to one child for each of its chosen tokens, and none
if it has none. Trees are independent and as many as the target recall needs at the
depth of the input; the first nodes that branch again do so several times over, for
the target at the deepest nodes. Nodes
with few documents are compared exhaustively, on one-bit sketches first; larger
ones branch again. Candidates are confirmed on the full sets.

Only classes matter, so work that cannot change them is left out: equal sets are
one document throughout; each document is first tried against the least document
of its nodes, and nodes whose documents are all connected by then are done. In a
large node that does not branch on, only the documents outside its largest class are
compared with the others: large nodes with one largest class are taken together, and
the full sets are compared in blocks of bounded size by their common shingles, so that
every link is exact at once and each block returns only links that join classes.
Of the candidates of small nodes, those still between two classes are confirmed on the
full sets, each document's likeliest first, then all that are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderloom.llm.common import LOWER, NOT_SPACE, U, columns, drop_written, lean, mix, quoted, row_bounds, slices, table, utf8, word_hashes, written
from orderloom.llm.graph import components

TOKENS = 64
#: Least number of trees; deeper inputs take more.
TREES = 20
#: Chance that a pair at the threshold shares a node at the common depth, and at the deepest.
SHARED, RECALL = 0.995, 0.99
PERCENT = 80
SMALL_NODE = 256
#: A large node is compared in blocks once so few of its documents lie outside its largest class.
FEW = 512
#: Shingles of a block's documents, and of the documents that are compared with a block at once.
BLOCK_SHINGLES, ASKED_SHINGLES = 1 << 20, 1 << 18
MAX_LEVELS = 5
#: Distinct sets for each task that makes a table of numbers that are few, one of sets or nodes, and one that reads texts.
SETS_PER_TASK, ROWS_PER_TASK, TEXTS_PER_TASK = 50_000, 20_000, 5_000
#: Rows of two or three numbers up to which a counted table is broadcast.
BROADCAST_ROWS = 300_000
#: Candidates of each document, likeliest first, that are confirmed before classes are looked at again.
LIKELIEST = 3
#: Differing bits of two 128-bit sketches: 12.8 expected at similarity 0.8, deviation 3.4; more than this in one pair of 50,000.
SKETCH_BITS = 28
_A = np.random.Generator(np.random.PCG64(97)).integers(1, 1 << 63, (TOKENS, 2), dtype=np.uint64) | U(1)
META = "doc_id long, n_shingles long, sig1 long, sig2 long, mins binary, s1 long, s2 long"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, row after row; bounds of the rows).

    A row with fewer words than a shingle has its whole sequence as one; a row
    without words has none.
    """
    h, row, _, _ = word_hashes(LOWER[data] if lower else data, offsets, NOT_SPACE)
    n = len(offsets) - 1
    bounds = row_bounds(row, n)
    count = np.diff(bounds)
    size = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    begin = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + np.repeat(bounds[:-1] - begin, size)
    value = np.zeros(len(at), U)
    length = np.repeat(np.minimum(count, words), size)
    for k in range(words):
        inside = length > k
        value[inside] = mix(value[inside] * U(0x9E3779B97F4A7C15) + h[at[inside] + k] + U(k + 1))
    ends = begin + size
    for a, b in zip(begin.tolist(), ends.tolist(), strict=True):
        value[a:b].sort()
    owner = np.repeat(np.arange(n), size)
    head = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))[: len(value)]
    return value[head], row_bounds(owner[head], n)


def embed(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(TOKENS minwise values, 128-bit sketch) of each row; rows without shingles hold zeros.

    Each product's upper half gives a token; the halves are minwise values apart, and
    each of these 2 * TOKENS values gives the sketch one bit.
    """
    n = len(bounds) - 1
    mins = np.zeros((2, n, TOKENS), np.uint32)
    rows = np.flatnonzero(np.diff(bounds))
    at = bounds[:-1][rows]
    for j, (a, b) in enumerate(_A if len(rows) else ()):
        halves = (sets * a + b).astype("<u8", copy=False).view("<u4")
        mins[0, rows, j] = np.minimum.reduceat(halves[1::2], at)
        mins[1, rows, j] = np.minimum.reduceat(halves[::2], at)
    place = np.arange(TOKENS, dtype=np.uint64)
    bits = [mix(half.astype(np.uint64) + ((place + U(k * TOKENS)) << U(32))) & U(1) for k, half in enumerate(mins)]
    return mins[0], np.stack([np.bitwise_or.reduce(bit << place, axis=1) for bit in bits], axis=1)


def describe(docs: DataFrame, words: int) -> DataFrame:
    """META of each document: size, a 128-bit signature of the set, tokens and sketch."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, offsets = utf8(part.column("text"))
            ids = part.column("doc_id").cast(pa.int64())
            for a, b in slices(offsets, 1 << 20):
                sets, bounds = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                mins, sketch = embed(sets, bounds)
                size = np.diff(bounds)
                sums = [np.append(U(0), np.cumsum(mix(sets + U(s)))) for s in (1, 2)]
                sig = [(x[bounds[1:]] - x[bounds[:-1]]).view(np.int64) for x in sums]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(size), *(pa.array(x) for x in sig), pa.array([m.tobytes() for m in mins], pa.binary()), *(pa.array(sketch[:, k].view(np.int64)) for k in (0, 1))],
                    [f.split()[0] for f in META.split(", ")],
                )

    return columns(docs, "doc_id", "text").mapInArrow(lean(run), META)


def children(node: np.ndarray, elements: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``elements``, child node) for the tokens chosen at each row's node."""
    draw = mix(elements ^ node[:, None])
    row, col = np.nonzero(draw < U(int(2**64 / (percent / 100 * TOKENS))))
    return row, mix(draw[row, col])


def recall(trees: int, levels: int, copies: int, deeper: int, percent: int = PERCENT) -> float:
    """Chance that two sets at the threshold share a node ``deeper`` levels under depth ``levels``.

    Two sets share a binomial number of tokens, in all trees the same; a shared node
    passes each shared token on with the chance that it is chosen. Nodes at depth
    ``levels`` branch ``copies`` times over, all others once.
    """
    s, total = percent / 100, 0.0
    chosen = 1 / (s * TOKENS)
    for shared in range(TOKENS + 1):
        gone = 0.0
        for level in range(levels + deeper):
            gone = gone**copies if level == deeper and deeper else gone
            gone = (1 - chosen + chosen * gone) ** shared
        total += comb(TOKENS, shared) * s**shared * (1 - s) ** (TOKENS - shared) * (1 - gone**trees)
    return total


def plan_trees(levels: int, percent: int = PERCENT, least: int = TREES, deeper: int = MAX_LEVELS) -> tuple[int, int]:
    """(trees, copies): trees for SHARED at depth ``levels``, copies of its nodes for RECALL at ``deeper`` levels below."""
    trees = least
    while recall(trees, levels, 1, 0, percent) < SHARED:
        trees += 1
    copies = 1
    while recall(trees, levels, copies, deeper, percent) < RECALL:
        copies += 1
    return trees, copies


def branch(rows: DataFrame, levels: int, trees: int, percent: int) -> DataFrame:
    """Rows (doc, n, s1, s2, mins [, node]) to their nodes ``levels`` further down, ``trees`` times over."""
    rooted = "node" not in rows.columns

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo in range(0, part.num_rows, 2000):
                p = part.slice(lo, 2000)
                mins = np.stack([np.frombuffer(m, np.uint32) for m in p.column("mins").to_pylist()])
                elements = mix(mins.astype(np.uint64) + (np.arange(TOKENS, dtype=np.uint64) << U(32)))
                if rooted:
                    starts = [(np.arange(p.num_rows), np.full(p.num_rows, int(mix(np.array([t + 1], U))[0]), U)) for t in range(trees)]
                else:
                    node = p.column("node").to_numpy().view(np.uint64)
                    starts = [(np.arange(p.num_rows), mix(node + U(t)) if t else node) for t in range(trees)]
                for row, node in starts:
                    for _ in range(levels):
                        at, node = children(node, elements[row], percent)
                        row = row[at]
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *(p.column(c).take(take) for c in ("doc", "n", "s1", "s2"))], ["node", "doc", "n", "s1", "s2"])

    return rows.mapInArrow(lean(run), "node long, doc long, n long, s1 long, s2 long")


def alike(a: str, b: str, percent: int, bits: int = SKETCH_BITS):
    """Necessary size ratio and sketch distance of two sets."""
    return F.expr(
        f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n)"
        f" and bit_count({a}.s1 ^ {b}.s1) + bit_count({a}.s2 ^ {b}.s2) <= {bits}"
    )


def distance(a: str, b: str):
    return F.expr(f"cast(bit_count({a}.s1 ^ {b}.s1) + bit_count({a}.s2 ^ {b}.s2) as int)")


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with its join strategy set by its counted rows."""
    return df.hint("broadcast" if rows <= BROADCAST_ROWS else "merge")


def between(pairs: DataFrame, roots: DataFrame, parts: int, groups: DataFrame | None = None) -> DataFrame:
    """The pairs (u, v, ...) whose documents are not of one class yet, without those that
    ``groups`` (main, doc) have together, which have been compared there."""
    known = roots.select("node", "root", F.lit(None).cast("long").alias("main"))
    if groups is not None:
        known = known.unionByName(groups.select(F.col("doc").alias("node"), F.lit(None).cast("long").alias("root"), "main"))
    known = written(known.groupBy("node").agg(F.max("root").alias("root"), F.collect_set("main").alias("mains")), "near-known", parts=parts)  # a few nodes a document
    r = hinted(known, known.count())
    one = pairs.join(r.withColumnsRenamed({"node": "u", "root": "ru", "mains": "mu"}), "u", "left")
    two = one.join(r.withColumnsRenamed({"node": "v", "root": "rv", "mains": "mv"}), "v", "left")
    apart = (F.coalesce("ru", "u") != F.coalesce("rv", "v")) & ~F.coalesce(F.arrays_overlap("mu", "mv"), F.lit(False))
    out = written(two.filter(apart).select(*pairs.columns), "near-between", parts=parts)
    drop_written(known)
    return out


def classed(rows: DataFrame, roots: DataFrame, n_roots: int) -> DataFrame:
    """Rows with a ``doc`` and the class of each by now."""
    known = hinted(roots.select(F.col("node").alias("doc"), "root"), n_roots)
    return rows.join(known, "doc", "left").select(*rows.columns, F.coalesce("root", "doc").alias("class"))


def mixed_nodes(known: DataFrame) -> DataFrame:
    """Nodes (node, c, main, outside) with documents of several classes: size, largest class, documents outside it."""
    per = known.groupBy("node", "class").agg(F.count(F.lit(1)).alias("k")).groupBy("node").agg(
        F.sum("k").alias("c"), F.max(F.struct("k", "class")).alias("m")
    )
    return per.filter("c > m.k").select("node", "c", F.col("m.class").alias("main"), (F.col("c") - F.col("m.k")).alias("outside"))


def set_rows(texts: DataFrame, words: int) -> DataFrame:
    """(doc, shingles) of rows (doc, text): the sorted distinct shingle hashes as 8-byte numbers."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, offsets = utf8(part.column("text"))
            for a, b in slices(offsets, 1 << 20):
                sets, bounds = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                each = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(bounds * 8), pa.py_buffer(sets)])
                yield pa.RecordBatch.from_arrays([part.column("doc").slice(a, b - a), each.cast(pa.binary())], ["doc", "shingles"])

    return texts.mapInArrow(lean(run), "doc long, shingles binary")


def block_links(rows: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK_SHINGLES, asked: int = ASKED_SHINGLES) -> DataFrame:
    """Links (u, v) of the documents outside a group's main class with the others of the group.

    ``rows``: (main, doc, n, class), a document once in a group; ``sets``: (doc, shingles).
    Documents outside (in parts of about ``asked`` shingles) meet all of the group's (in
    blocks of about ``block``), spread over tasks. All pairs of a part and a block are
    compared exactly; of their links those that join two classes are returned.
    """
    out = F.col("class") != F.col("main")
    size = rows.groupBy("main").agg(F.sum("n").alias("all"), F.sum(F.when(out, F.col("n")).otherwise(0)).alias("few"))
    size = size.select("main", F.ceil(F.col("all") / block).cast("int").alias("blocks"), F.ceil(F.col("few") / asked).cast("int").alias("fews"))
    full = rows.join(hinted(size, size.count()), "main").join(sets.hint("merge"), "doc")
    cols = ("main", "doc", "class", "shingles")
    asks = full.filter(out).select(*cols, F.pmod(F.xxhash64(F.lit(1), "doc"), "fews").cast("int").alias("f"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.lit(True).alias("asks"))
    held = full.select(*cols, F.explode(F.sequence(F.lit(0), F.col("fews") - 1)).alias("f"), F.pmod(F.xxhash64("doc"), "blocks").cast("int").alias("b"), F.lit(False).alias("asks"))

    def compare(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        doc = group.column("doc").to_numpy()
        _, kind = np.unique(group.column("class").to_numpy(), return_inverse=True)
        data, offsets = utf8(group.column("shingles").combine_chunks())
        sets, bounds = data.view(U), offsets // 8
        ref = np.flatnonzero(~asks)
        size = np.diff(bounds)
        owner = np.repeat(np.arange(len(ref)), size[ref])
        begin = np.cumsum(size[ref]) - size[ref]
        keys = sets[np.arange(len(owner)) + np.repeat(bounds[:-1][ref] - begin, size[ref])]
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        label = np.arange(kind.max() + 1 if len(kind) else 0)  # of each class, as links of this block join them
        links = [np.zeros((2, 0), np.int64)]
        for q in np.flatnonzero(asks).tolist():
            own = sets[bounds[q] : bounds[q + 1]]
            lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            n = hi - lo
            at = np.arange(int(n.sum())) + np.repeat(lo - np.cumsum(n) + n, n)
            same = np.bincount(owner[at], minlength=len(ref))
            mine = label[kind[q]]
            hit = np.flatnonzero((100 * same >= percent * (len(own) + size[ref] - same)) & (label[kind[ref]] != mine))
            theirs, first = np.unique(label[kind[ref[hit]]], return_index=True)
            if len(theirs):
                other = doc[ref[hit[first]]]
                links.append(np.stack([np.maximum(other, doc[q]), np.minimum(other, doc[q])]))
                label[np.isin(label, theirs)] = mine
        u, v = np.concatenate(links, axis=1)
        return pa.table({"u": u, "v": v})

    return asks.unionByName(held).groupBy("main", "f", "b").applyInArrow(lean(compare), "u long, v long")


def confirm(pairs: DataFrame, docs: DataFrame, words: int, percent: int, parts: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the similarity; ``docs``: (doc, text) with one row a doc."""
    sides = [pairs.select(F.col(side).alias("doc")) for side in ("u", "v")]
    ids = written(sides[0].unionByName(sides[1]).distinct(), "confirm-ids", parts=parts)
    texts = docs.join(hinted(ids, ids.count()), "doc", "left_semi")
    one = pairs.hint("merge").join(texts.select(F.col("doc").alias("u"), F.col("text").alias("tu")), "u")
    two = one.hint("merge").join(texts.select(F.col("doc").alias("v"), F.col("text").alias("tv")), "v")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sides = [utf8(part.column(c)) for c in ("tu", "tv")]
            for lo in range(0, part.num_rows, 100):
                hi = min(lo + 100, part.num_rows)
                (a, ab), (b, bb) = (shingle_sets(d[o[lo] : o[hi]], o[lo : hi + 1] - o[lo], words) for d, o in sides)
                keep = []
                for i in range(hi - lo):
                    x, y = a[ab[i] : ab[i + 1]], b[bb[i] : bb[i + 1]]
                    same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0
                    keep.append(same > 0 and 100 * same >= percent * (len(x) + len(y) - same))
                mask = pa.array(keep)
                yield pa.RecordBatch.from_arrays([part.column(c).slice(lo, hi - lo).filter(mask) for c in ("u", "v")], ["u", "v"])

    out = written(two.mapInArrow(lean(run), "u long, v long"), "links", parts=parts)
    drop_written(ids)
    return out


def near_components(
    docs: DataFrame, words: int = 2, percent: int = PERCENT, trees: int = TREES, small_node: int = SMALL_NODE,
    few: int = FEW, max_levels: int = MAX_LEVELS, sketch_bits: int = SKETCH_BITS,
) -> DataFrame:
    """Classes of near-duplicate documents.

    Returns doc_id, n_shingles, component_id (least doc_id reachable over links),
    kept (doc_id = component_id): one row for each row of ``docs``. Two documents
    are linked when 100 * intersection >= percent * union of their sets of distinct
    ``words``-word shingles; words are runs outside the ASCII spaces, A-Z lowered. A
    shorter text is one shingle; null and empty texts have none and link with
    nothing. Rows with a null doc_id have no class and link with nothing (their kept is
    true); of rows that repeat a doc_id the longest text (on ties the greatest) stands
    for the document, and all have its class. An empty table gives no rows; extra columns
    are ignored. Links are exact; a link at the threshold is found
    with probability over 0.99 (higher similarity: more), and usually there are
    several ways to connect a class.

    Which pairs meet depends on these. ``trees``: the least number of trees; as many are
    taken as the recall needs. ``small_node``: documents of a node whose pairs are compared
    one by one on sketches, of which those that differ in more than ``sketch_bits`` of 128 bits
    are no candidates (at the threshold 12.8 differ on the average; at the default one pair in
    50,000 is lost, well within what the recall leaves; 128 confirms every pair). Larger
    nodes branch again while more than ``few`` of their documents lie outside the largest class,
    at most ``max_levels`` times; what is left is compared exactly, in blocks.
    """
    docs = columns(docs, "doc_id", "text")
    ids = docs.select("doc_id").filter("doc_id is not null")
    n_rows = docs.select("doc_id").count()
    if ids.count() > ids.distinct().count():
        longest = F.max(F.struct(F.octet_length("text").alias("size"), "text")).alias("t")
        stands = written(docs.filter("doc_id is not null").groupBy("doc_id").agg(longest).select("doc_id", "t.text"), "near-texts")
        of = near_components(stands, words, percent, trees, small_node, few, max_levels, sketch_bits).select("doc_id", "component_id")
        every = describe(docs, words).select("doc_id", "n_shingles")
        out = every.join(written(of, "near-of").hint("merge"), "doc_id", "left")
        return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    meta = written(describe(docs, words), "near-meta", parts=max(6, n_rows // TEXTS_PER_TASK))
    keyed = meta.filter("doc_id is not null and n_shingles > 0")
    least = keyed.groupBy("sig1", "sig2", "n_shingles").agg(F.min(F.struct("doc_id", "mins", "s1", "s2")).alias("r"))
    reps = written(
        least.select(F.col("r.doc_id").alias("doc"), F.col("n_shingles").alias("n"), "r.s1", "r.s2", "r.mins", "sig1", "sig2"), "near-reps", parts=max(6, n_rows // ROWS_PER_TASK)
    )
    n = reps.count()
    parts, node_parts, text_parts = (max(6, n // per) for per in (SETS_PER_TASK, ROWS_PER_TASK, TEXTS_PER_TASK))
    levels = max(1, ceil(log(max(1, n / 64)) / log(16)))
    trees, copies = plan_trees(levels, percent, trees, max_levels)
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").alias("doc"), "text")

    nodes = written(branch(reps.drop("sig1", "sig2"), levels, trees, percent), "near-nodes", parts=text_parts)

    # 1. every document against the least one of each of its nodes: at most one candidate a document
    heads = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc", "n", "s1", "s2")).alias("p")).filter("c > 1")
    heads = heads.select("node", "p.*").withColumnRenamed("doc", "head")
    first = nodes.alias("a").join(heads.hint("merge").alias("b"), "node").filter(F.expr("a.doc > b.head") & alike("a", "b", percent, sketch_bits))
    star = confirm(written(first.groupBy(F.col("a.doc").alias("u")).agg(F.min("b.head").alias("v")), "near-star", parts=parts), texts, words, percent, text_parts)
    roots = written(components(star, parts), "near-roots", parts=parts)
    n_roots = roots.count()

    # 2. nodes with several classes: small ones give candidates, large ones branch again or are kept for step 3
    found, large, deep = None, None, 0
    while True:
        mixed = written(mixed_nodes(classed(nodes, roots, n_roots)), "near-mixed", parts=parts)
        open_ = written(classed(nodes.join(mixed.hint("merge"), "node"), roots, n_roots), "near-open", parts=node_parts)
        last = deep >= max_levels
        small = open_.filter(f"c <= {small_node}")
        pairs = small.alias("a").hint("merge").join(small.alias("b"), "node").filter(F.expr("a.doc > b.doc and a.class <> b.class") & alike("a", "b", percent, sketch_bits))
        pairs = written(pairs.select(F.col("a.doc").alias("u"), F.col("b.doc").alias("v"), distance("a", "b").alias("d")).distinct(), "near-pairs", parts=parts)
        found = pairs if found is None else found.unionByName(pairs)
        kept = open_.filter(f"c > {small_node}" if last else f"c > {small_node} and outside <= {few}").select("main", "doc", "n", "class").distinct()
        kept = written(kept, "near-large", parts=parts)
        large = kept if large is None else large.unionByName(kept)
        big = open_.filter(f"c > {small_node} and outside > {few}").select("node", "doc")
        done = last or big.isEmpty()
        if not done:
            deeper = written(branch(big.hint("merge").join(reps.drop("sig1", "sig2"), "doc"), 1, 1 if deep else copies, percent), "near-nodes", parts=node_parts)
        drop_written(nodes, mixed, open_)
        if done:
            break
        nodes, deep = deeper, deep + 1

    # 3. large nodes, those of one main class together, on their full sets
    links = star
    large = written(large.distinct(), "near-groups", parts=parts)
    if not large.isEmpty():
        ids = written(large.select("doc").distinct(), "near-ids", parts=parts)
        sets = written(set_rows(texts.join(hinted(ids, ids.count()), "doc", "left_semi"), words), "near-sets", parts=text_parts)
        more = written(block_links(large, sets, percent).distinct(), "links", parts=parts)
        drop_written(sets, ids)
        links = links.unionByName(more)
        roots = written(components(links, parts), "near-roots", parts=parts)

    # 4. candidates of small nodes: each document's likeliest first, then all that still lie between two classes
    order = Window.partitionBy("u").orderBy("d", "v")
    left = between(found.groupBy("u", "v").agg(F.min("d").alias("d")), roots, parts, large)
    ranked = written(left.withColumn("place", F.row_number().over(order)), "near-ranked", parts=parts)
    links = links.unionByName(confirm(ranked.filter(f"place <= {LIKELIEST}").select("u", "v"), texts, words, percent, text_parts))
    rest = ranked.filter(f"place > {LIKELIEST}").select("u", "v")
    if not rest.isEmpty():
        roots = written(components(links, parts), "near-roots", parts=parts)
        links = links.unionByName(confirm(between(rest, roots, parts), texts, words, percent, text_parts))

    final = components(links.distinct(), parts)
    of = reps.join(final.hint("merge"), reps["doc"] == final["node"], "left").select("sig1", "sig2", F.col("n").alias("n_shingles"), F.coalesce("root", "doc").alias("component"))
    out = meta.drop("mins").join(of.hint("merge"), ["sig1", "sig2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = PERCENT) -> DataFrame:
    """The documents that are least in their class, all their columns kept.

    Documents without words or without an id stay, and so do all rows of a repeated id
    whose document stays. Extra columns of any name are kept; an empty table gives no rows.
    """
    gone = written(near_components(docs, words, percent).filter("not kept").select("doc_id").distinct(), "near-gone", parts=max(6, docs.select("doc_id").count() // SETS_PER_TASK))
    return docs.join(hinted(gone, gone.count()), "doc_id", "left_anti").select(*quoted(docs))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) WHEN len(ws) = 1 THEN ws ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM shared JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * c >= 80 * (nu.n + nv.n - c)),
e AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT u AS doc_id, least(u, v) AS r FROM e UNION SELECT e.v, reach.r FROM reach JOIN e ON e.u = reach.doc_id),
k AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(coalesce(k.r, d.doc_id), d.doc_id) AS component_id, d.doc_id = least(coalesce(k.r, d.doc_id), d.doc_id) AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""
