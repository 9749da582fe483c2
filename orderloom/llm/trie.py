"""Conversation prefix trie: a z-fast trie kept as a table.

Conversations are sequences of turns. A prefix is named by a 128-bit digest chained
over its turns, so that two equal names are equal prefixes. Of the trie of all prefixes
only compacted nodes are kept: those at which conversations branch or end, each with the
edge of prefixes above it, from depth a (the node before) to its own depth b. A node is
found by its handle: the prefix at the two-fattest depth of (a, b], the one that is
divisible by the highest power of two.

Sequences are inserted in batches that grow by a factor, in the order of a hash. All of a
batch look for their exit node at once by fat binary search: every round, a join on
(depth, digest) finds the nodes whose handles the sequences probe, and halves what is left
of their depths. Those that leave at one place (inside an edge, or below a node towards the
same new turn) are inserted together, by one task, as a small trie of its own that replaces
the edge. As a batch is a random part of all sequences and not many times as large as what
is in the trie, few sequences leave at one place, however many share a prefix.

Counts come from sums over subtrees of compacted nodes, by pointers that double their
reach; edges are expanded to prefixes last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm.common import CRC32_SQL, columns, drop_written, lean, table, written
from orderloom.llm.neardup import hinted

#: Bytes of a prefix's name, and of a mark: the name and the code points up to the prefix's end.
NAME, MARK = 16, 24
ROOT = bytes(NAME)
#: Sequences of the first batch, and how many times as large as all before a later one is.
FIRST, GROWTH = 4096, 8
NODE = "first binary, f int, handle binary, id binary, parent binary, a int, b int, da long, db long, edge binary"


# --------------------------------------------------------------- sequences
def turn_key(role: Column, text: Column) -> Column:
    """SHA-256 of role and text, told apart by the role's length."""
    return F.unhex(F.sha2(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "utf-8"), 256))


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns (key, points) in order; texts stay behind.

    Null turns come first, turns of one number are ordered by their keys; null role or text
    is empty; rows without a conv_id are of no conversation.
    """
    rows = columns(conversations, "conv_id", "turn", "role", "text").filter("conv_id is not null")
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turn = F.struct("turn", turn_key(role, text).alias("key"), F.char_length(text).cast("long").alias("points"))
    gathered = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return gathered.select("conv_id", F.transform("t", lambda t: F.struct(t["key"].alias("key"), t["points"].alias("points"))).alias("turns"))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, n, marks, name) of each conversation: its prefixes' marks and its last name."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = part.column("turns")
            cut, of = lists.offsets.to_numpy(), lists.values
            keys, points = of.field("key").to_pylist(), of.field("points").to_pylist()
            marks, names = [], []
            for a, b in zip(cut, cut[1:], strict=False):
                name, total, out = ROOT, 0, []
                for k in range(a, b):
                    name = hashlib.blake2b(name + keys[k], digest_size=NAME).digest()
                    total += points[k]
                    out += (name, total.to_bytes(MARK - NAME, "big"))
                marks.append(b"".join(out))
                names.append(name)
            yield pa.RecordBatch.from_arrays(
                [part.column("conv_id"), pa.array(np.diff(cut).astype(np.int32)), pa.array(marks, pa.binary()), pa.array(names, pa.binary())],
                ["conv_id", "n", "marks", "name"],
            )

    kind = dict(turns.dtypes)["conv_id"]
    return turns.mapInArrow(lean(run), f"conv_id {kind}, n int, marks binary, name binary")


def endings(seqs: DataFrame) -> DataFrame:
    """(name, conv_id, n_ends, ends_sha256) of each distinct sequence: its least conversation, how many
    have just these turns, and the hash of their ids. A hash of ids in order is one stream; one task reads
    the ids of one sequence one after another and keeps none."""
    rows = seqs.select("name", "conv_id").repartition("name").sortWithinPartitions("name", "conv_id")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, least, count, sha = None, None, 0, None
        for part in parts:
            out = []
            for this, conv in zip(part.column("name").to_pylist(), part.column("conv_id").to_pylist(), strict=True):
                if this != name:
                    if name is not None:
                        out.append((name, least, count, sha.hexdigest()))
                    name, least, count, sha = this, conv, 1, hashlib.sha256(str(conv).encode())
                else:
                    count += 1
                    sha.update(f",{conv}".encode())
            yield batch(out)
        yield batch([(name, least, count, sha.hexdigest())] if name is not None else [])

    kind = seqs.select("conv_id").schema[0].dataType

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [pa.binary(), to_arrow_type(kind), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["name", "conv_id", "n_ends", "ends_sha256"])

    return rows.mapInArrow(lean(run), f"name binary, conv_id {kind.simpleString()}, n_ends long, ends_sha256 string")


# --------------------------------------------------------------- the trie as a table
def fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the highest power of two divides."""
    return high.bitwiseAND(-F.pow(F.lit(2), F.length(F.bin(low.bitwiseXOR(high))) - 1).cast("int"))


def name_at(marks: Column, depth: Column) -> Column:
    return F.substring(marks, (depth - 1) * MARK + 1, F.lit(NAME))


def exits(newcomers: DataFrame, trie: DataFrame | None, size: int) -> DataFrame:
    """(marks, n, a, parent) of newcomers (marks, n): the deepest node above which each leaves the trie.

    Fat binary search: l is the depth of the deepest node found so far, r the greatest depth that
    a handle yet to be found can have.
    """
    state = newcomers.select("marks", "n", F.lit(0).alias("l"), F.col("n").alias("r"), F.lit(ROOT).alias("v"))
    if trie is None:
        return state.select("marks", "n", F.col("l").alias("a"), F.col("v").alias("parent"))
    handles = hinted(trie.select("f", "handle", "a", "b", "id", "parent"), size)
    state, done = written(state, "trie-search"), []
    while True:
        done.append(state.filter("l >= r"))
        open_ = state.filter("l < r")
        if open_.isEmpty():
            break
        probe = open_.withColumn("f", fattest(F.col("l"), F.col("r"))).withColumn("handle", name_at(F.col("marks"), F.col("f")))
        met = probe.join(handles, ["f", "handle"], "left")
        below = (F.col("b") <= F.col("n")) & (name_at(F.col("marks"), F.col("b")) == F.col("id"))  # its whole edge is shared
        # where the edge of the node found is left early, the search ends at the node above it
        missed = F.col("id").isNull()
        state = written(met.select(
            "marks", "n", F.when(missed, F.col("l")).when(below, F.col("b")).otherwise(F.col("a")).alias("l"),
            F.when(missed, F.col("f") - 1).when(below, F.col("r")).otherwise(F.col("a")).alias("r"),
            F.when(missed, F.col("v")).when(below, F.col("id")).otherwise(F.col("parent")).alias("v"),
        ), "trie-search")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("marks", "n", F.col("l").alias("a"), F.col("v").alias("parent"))


def shared(x: bytes, y: bytes) -> int:
    """Marks that two sequences of marks have in common; equal marks mean equal prefixes before them."""
    low, high = 0, min(len(x), len(y)) // MARK
    while low < high:
        k = (low + high + 1) // 2
        if x[(k - 1) * MARK : k * MARK] == y[(k - 1) * MARK : k * MARK]:
            low = k
        else:
            high = k - 1
    return low


def compacted(strings: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(depth above, depth, a string through it) of the nodes of distinct sorted strings of marks."""
    stack, before = [0], b""
    for s in [*strings, b""]:
        k = shared(before, s)
        while stack[-1] > k:
            depth = stack.pop()
            yield max(stack[-1], k), depth, before
        if stack[-1] < k:
            stack.append(k)
        if len(s) // MARK > stack[-1]:
            stack.append(len(s) // MARK)
        before = s


def fattest_number(low: int, high: int) -> int:
    return high & -(1 << ((low ^ high).bit_length() - 1))


def grafted(group: pa.Table) -> pa.Table:
    """The nodes of one edge below a node, and of what is inserted in it.

    Rows (marks, a, parent, edge): newcomers that go on from the node ``parent`` at depth ``a``
    with one and the same next turn, and the edge that is there already (null: none).
    """
    a, parent = group.column("a")[0].as_py(), group.column("parent")[0].as_py()
    marks = group.column("marks").to_pylist()
    da = int.from_bytes(marks[0][a * MARK - 8 : a * MARK], "big") if a else 0
    edge = group.column("edge")[0].as_py()
    strings = sorted({m[a * MARK :] for m in marks} | ({edge} if edge else set()))
    name = lambda s, k: s[(k - 1) * MARK : (k - 1) * MARK + NAME]
    points = lambda s, k: int.from_bytes(s[k * MARK - 8 : k * MARK], "big")
    rows = []
    for up, depth, s in compacted(strings):
        f = fattest_number(a + up, a + depth)
        rows.append((
            name(s, up + 1), f, name(s, f - a), name(s, depth), name(s, up) if up else parent, a + up, a + depth,
            points(s, up) if up else da, points(s, depth), s[up * MARK : depth * MARK],
        ))
    kinds = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64()}
    fields = [x.split() for x in NODE.split(", ")]
    return pa.table({c: pa.array([r[k] for r in rows], kinds[t]) for k, (c, t) in enumerate(fields)})


def zfast_trie(seqs: DataFrame, first: int = FIRST, growth: int = GROWTH) -> DataFrame | None:
    """Table NODE of the compacted nodes of distinct sequences (n, marks, name) but the root; None without any."""
    seqs = seqs.filter("n > 0")
    total = seqs.count()
    if not total:
        return None
    share = F.shiftrightunsigned(F.xxhash64("name"), 11) / F.lit(float(1 << 53)) * F.lit(total / first)
    batch = F.when(share < 1, 0).otherwise(1 + F.floor(F.log(share) / float(np.log(growth)))).cast("int")
    dealt = written(seqs.select("marks", "n", batch.alias("batch")), "trie-dealt")
    trie, size = None, 0
    for k in sorted(r.batch for r in dealt.select("batch").distinct().collect()):  # a few numbers
        going = exits(dealt.filter(F.col("batch") == k), trie, size).filter("n > a")
        going = going.withColumn("first", name_at(F.col("marks"), F.col("a") + 1))
        if trie is None:
            going = going.withColumn("edge", F.lit(None).cast("binary"))
        else:
            going = going.join(trie.select("first", "edge").hint("merge"), "first", "left")
        new = written(going.select("first", "marks", "a", "parent", "edge").groupBy("first").applyInArrow(lean(grafted), NODE), "trie-new")
        if trie is None:
            trie = new
        else:
            before, trie = trie, written(trie.join(new.select("first").hint("merge"), "first", "left_anti").unionByName(new), "trie-nodes")
            drop_written(before, new)
        size = trie.count()
    return trie


# --------------------------------------------------------------- sums over subtrees
SUMS = ("n", "ends", "edge_points", "n_leaves")


def subtree_sums(nodes: DataFrame, size: int) -> DataFrame:
    """(id, least, n, ends, edge_points, n_leaves) over the subtree of each node of (id, up, least, ...).

    Every round adds what is within twice the reach: nodes send their sums to the one that their
    pointer names, and pointers skip to where that one's points. Rounds grow with the logarithm of
    the height. Pointers to the root end, so that nothing asks the root where it points.
    """
    state = nodes
    while True:
        going = state.filter("up is not null")
        if going.isEmpty():
            return state.drop("up")
        sent = going.groupBy(F.col("up").alias("id")).agg(F.min("least").alias("m"), *[F.sum(c).alias(f"s_{c}") for c in SUMS])
        inner = going.filter(F.col("up") != F.lit(ROOT))
        hops = hinted(state.select(F.col("id").alias("up"), F.col("up").alias("next")).filter("next is not null"), size)
        ups = inner.select("id", "up").join(hops, "up").select("id", "next")
        met = state.join(sent.hint("merge"), "id", "left").join(ups.hint("merge"), "id", "left")
        state = written(met.select(
            "id", F.col("next").alias("up"), F.least("least", "m").alias("least"), *[(F.col(c) + F.coalesce(f"s_{c}", F.lit(0))).alias(c) for c in SUMS]
        ), "trie-sums")


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def expanded(nodes: DataFrame, kind: str) -> DataFrame:
    """One row for each prefix of each node's edge, the root's included.

    With n members, of which each end e lies at D(e) code points, and the distinct texts' own points
    P in a prefix's subtree: the sum over the subtree of (members - 1) * points is
    sum D(e) - n * (points before the prefix's last turn) - P.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            edges = part.column("edge").to_pylist()
            size = np.array([max(1, len(e) // MARK) for e in edges], np.int64)
            row = np.repeat(np.arange(len(edges)), size)
            step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)  # 0: the first prefix of the edge
            get = lambda c: part.column(c).to_numpy(zero_copy_only=False)
            flat = np.frombuffer(b"".join(e or bytes(MARK) for e in edges), np.uint8).reshape(-1, MARK)
            points = np.ascontiguousarray(flat[:, NAME:]).view(">i8").ravel().astype(np.int64)
            before = np.where(step > 0, np.append(0, points[:-1]), get("da")[row])
            last = step == size[row] - 1
            take = pa.array(row)
            root = get("b")[row] == 0
            parent = pc.if_else(pa.array(step > 0), part.column("least").take(take), part.column("parent_least").take(take))
            saved = get("ends")[row] - get("n")[row] * before - (get("edge_points")[row] - (before - get("da")[row]))
            sha = pc.if_else(pa.array(last), pc.fill_null(part.column("ends_sha256"), EMPTY_SHA).take(take), pa.scalar(EMPTY_SHA))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("least").take(take), pa.array(get("a")[row] + np.where(root, 0, step + 1)), parent, part.column("n").take(take),
                    pa.array(np.where(last, get("kids")[row], 1)), part.column("n_leaves").take(take), pa.array(saved), sha,
                ],
                ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
            )

    schema = f"conv_id {kind}, depth long, parent_conv_id {kind}, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    return nodes.mapInArrow(lean(run), schema)


def turn_trie(turns: DataFrame, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """The prefix trie of (conv_id, turns), a row for each conversation; see ``prefix_trie``."""
    kind = dict(turns.dtypes)["conv_id"]
    seqs = written(sequences(turns), "trie-sequences")
    ends = written(endings(seqs), "trie-ends")
    own = ends.select("conv_id").hint("merge")
    trie = zfast_trie(seqs.join(own, "conv_id", "left_semi"), first, growth)
    cols = ("id", "parent", "a", "b", "da", "db", "edge")
    spark = turns.sparkSession
    root = spark.createDataFrame([(ROOT, None, 0, 0, 0, 0, b"")], "id binary, parent binary, a int, b int, da long, db long, edge binary")
    nodes = root.limit(0) if ends.isEmpty() else root
    if trie is not None:
        nodes = nodes.unionByName(trie.select(*cols))
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("kids"))
    nodes = nodes.join(kids.hint("merge"), "id", "left").join(ends.withColumnRenamed("name", "id").hint("merge"), "id", "left")
    nodes = written(nodes.select(
        *cols, F.coalesce("kids", F.lit(0)).alias("kids"), F.col("conv_id").alias("least"), "ends_sha256", F.coalesce("n_ends", F.lit(0)).alias("n"),
    ), "trie-full")
    size = nodes.count()
    sums = subtree_sums(nodes.select(
        "id", F.col("parent").alias("up"), "least", "n", (F.col("n") * F.col("db")).alias("ends"), (F.col("db") - F.col("da")).alias("edge_points"),
        F.when(F.col("kids") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
    ), size)
    sums = written(sums, "trie-sums")
    whole = nodes.drop("least", "n").join(sums.hint("merge"), "id")
    above = sums.select(F.col("id").alias("parent"), F.col("least").alias("parent_least"))
    return expanded(whole.join(hinted(above, size), "parent", "left"), kind)


def prefix_trie(conversations: DataFrame, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """The trie of all conversations' prefixes.

    Returns one row for each distinct sequence of the first d turns (role, text) of a
    conversation, from the root (d = 0) on: conv_id (least conversation that begins with it),
    depth, parent_conv_id (conv_id of the prefix one turn shorter; root: null), n_convs
    (conversations that begin with it), n_children, n_leaves (prefixes in its subtree, its own
    included, that no conversation continues), saved_tokens (over its subtree, the sum of
    (n_convs - 1) times the code points of the last text), ends_sha256 (hash of the
    comma-joined ascending ids of the conversations of just these turns).

    Turns are ordered by ``turn``, null first, turns of one number by the hash of role and
    text; repeated rows are turns of their own; null role or text is empty; rows without a
    conv_id are of no conversation; an empty table gives no rows; extra columns are ignored.
    A conversation's turns meet in one row, by 40 bytes a turn whatever their texts.
    """
    return turn_trie(conversation_turns(conversations), first, growth)


# --------------------------------------------------------------- the query
GROUP, HEADS = 100, 6


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) with the first turns of each taken from the first of its hundred, as the contract says."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    own = turns.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % GROUP})
    heads = turns.select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    met = own.join(heads.hint("merge"), "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.expr("slice(turns, 1, 0)"))
    return met.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie(rebuilt(conversation_turns(table(spark, sf_dir, "conversations"))))


OP11_SQL = rf"""
WITH k AS (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'k': k, 'p': p}} ORDER BY turn NULLS FIRST, k) AS t FROM k GROUP BY conv_id),
h AS (SELECT conv_id, t, {CRC32_SQL.format("conv_id::VARCHAR")} % 6 AS h FROM own),
seq AS (SELECT h.conv_id, list_concat(coalesce(b.t[1:h.h], []), h.t[h.h + 1:]) AS t FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100),
pre AS (SELECT conv_id, t, len(t) AS n, unnest(range(len(t) + 1)) AS d FROM seq),
named AS (SELECT conv_id, n, d, CASE WHEN d > 0 THEN t[d].p ELSE 0 END AS p, sha256(array_to_string(list_transform(t[1:d], lambda x: x.k), '')) AS name,
  CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(t[1:d - 1], lambda x: x.k), '')) END AS up FROM pre),
node AS (SELECT name, d, min(conv_id) AS c, count(*) AS m, min(up) AS up, min(p) AS p, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = n), '')) AS ends FROM named GROUP BY name, d),
kids AS (SELECT up AS name, count(*) AS kids FROM node WHERE up IS NOT NULL GROUP BY up),
sums AS (SELECT a.name, sum((n.m - 1) * n.p) AS saved, count(*) FILTER (kids.name IS NULL) AS leaves FROM node n JOIN named a ON a.conv_id = n.c AND a.d <= n.d LEFT JOIN kids ON kids.name = n.name GROUP BY a.name)
SELECT node.c AS conv_id, node.d AS depth, above.c AS parent_conv_id, node.m AS n_convs, coalesce(kids, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, node.ends AS ends_sha256
FROM node JOIN sums ON sums.name = node.name LEFT JOIN kids ON kids.name = node.name LEFT JOIN node above ON above.name = node.up
"""
