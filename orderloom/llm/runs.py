"""Periodic run detection: suffix-tree longest common extensions.

A run is a stretch of words with a period that no neighbouring word extends. Of each
text, Ukkonen's suffix tree and that of its reversal are built over words; an Euler
tour of each answers by lowest common ancestors, in constant time, how far two places
agree to the right and to the left. Every run has a root that is the longest Lyndon
word at some place, in one of two orders that reverse the words' order; the longest
Lyndon words follow from the order of suffixes, which the tree has too. Each is
extended in both directions, and what comes out long enough is a run.

Trees cost most in Python, so a text enters them without the words that no run can
hold: all groups of ``gram`` words of a run occur again within it, so each stretch in
which some group of words is the only one of its kind is cut down to one sign that
equals no other. Runs lie in what is left, whole and with their ends. All texts are
looked at whole, each within one task; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm.common import CRC32_SQL, NOT_SPACE, U, columns, lean, mix, prefix_sums, range_hash, slices, table, utf8, word_hashes

LEAST_WORDS, EXPONENT = 24, 3
RUN = "struct<start:long,length:long,period:long>"
#: Entries of a block of the Euler tour whose least depth is kept for range minima.
BLOCK = 16


# --------------------------------------------------------------- suffix trees
class SuffixTree:
    """Suffix tree of whole numbers from 1 on; a closing 0, smaller than all, is added.

    Edges are kept as (node, first sign) -> child; a node's edge is signs[start:end].
    """

    def __init__(self, signs: list[int]):
        self.signs = s = [*signs, 0]
        self.base = base = max(s) + 1
        start, end, link, edges = [0], [0], [0], {}
        n = len(s)
        at, along, length, left = 0, 0, 0, 0  # node, place and length on its edge, suffixes still to add
        for i, c in enumerate(s):
            left += 1
            last = 0
            while left:
                if not length:
                    along = i
                key = at * base + s[along]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    link[last] = at if last else 0
                    last = 0
                else:
                    a = start[child]
                    size = (end[child] if end[child] <= i else i + 1) - a
                    if length >= size:
                        at, along, length = child, along + size, length - size
                        continue
                    if s[a + length] == c:
                        length += 1
                        if last:
                            link[last] = at
                        break
                    middle = len(start)
                    start += [a, i]
                    end += [a + length, n]
                    link += [0, 0]
                    edges[key] = middle
                    edges[middle * base + c] = middle + 1
                    start[child] = a + length
                    edges[middle * base + s[a + length]] = child
                    if last:
                        link[last] = middle
                    last = middle
                left -= 1
                if at:
                    at = link[at]
                elif length:
                    length -= 1
                    along = i - left + 1
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        kids = np.fromiter(edges.values(), np.int64, len(edges))
        node, sign = np.divmod(keys, base)
        self.n, self.node, self.kids, self.sign = n, node, kids, sign
        self.first = np.searchsorted(np.sort(node), np.arange(len(start) + 1))
        up, deep = np.zeros(len(start), np.int64), np.array(end) - np.array(start)
        up[kids] = node
        self.up = up
        while up.any():  # depths from the root, by doubling
            deep, up = deep + deep[up], up[up]
        self.deep = deep

    def tour(self, falling: bool = False) -> np.ndarray:
        """Nodes in the order in which the Euler tour first reaches them.

        Children come in the order of their first signs, or with ``falling`` in the
        reverse one; the end comes before every sign in both.
        """
        last = np.where(self.sign > 0, -self.sign, -self.sign.max() - 1) if falling else self.sign
        kids = self.kids[np.lexsort((-last, self.node))].tolist()  # last child first, as they are taken from a stack
        first, stack, order = self.first.tolist(), [0], []
        while stack:
            node = stack.pop()
            order.append(node)
            a, b = first[node], first[node + 1]
            if a < b:
                stack += kids[a:b]
        return np.array(order)

    def suffixes(self, tour: np.ndarray) -> np.ndarray:
        """The suffixes in the order of a tour."""
        leaves = tour[self.first[tour] == self.first[tour + 1]]
        return self.n - self.deep[leaves]


class Agreement:
    """How far suffixes agree: the depth of the lowest common ancestor of their leaves.

    That is the least depth from which the Euler tour goes down between the two, so one
    entry for each node, the depth of its parent, is enough of the tour.
    """

    def __init__(self, tree: SuffixTree, tour: np.ndarray):
        depths = tree.deep[tree.up[tour]].astype(np.int32)
        leaf = np.flatnonzero(tree.first[tour] == tree.first[tour + 1])
        self.place = np.empty(tree.n, np.int64)
        self.place[tree.n - tree.deep[tour[leaf]]] = leaf
        pad = -len(depths) % BLOCK
        rows = np.concatenate([depths, np.full(pad, np.iinfo(np.int32).max, np.int32)]).reshape(-1, BLOCK)
        self.flat = rows.ravel()
        self.from_left = np.minimum.accumulate(rows, axis=1).ravel()
        self.from_right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [rows.min(axis=1)]
        while (half := 1 << (len(self.table) - 1)) * 2 <= len(rows):
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Signs that the suffixes i[k] and j[k], different ones, have in common."""
        a, b = self.place[i], self.place[j]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b)
        x, y = a // BLOCK, b // BLOCK
        out = np.minimum(self.from_right[a], self.from_left[b])
        near = np.flatnonzero(x == y)
        if len(near):
            at = np.minimum(a[near, None] + np.arange(BLOCK), b[near, None])
            out[near] = self.flat[at].min(axis=1)
        far = np.flatnonzero(y - x > 1)
        if len(far):
            lo, n = x[far] + 1, (y - x)[far] - 1
            level = np.frexp(n.astype(np.float64))[1] - 1
            for k in np.unique(level).tolist():
                of = far[level == k]
                begin = lo[level == k]
                t = self.table[k]
                out[of] = np.minimum(out[of], np.minimum(t[begin], t[begin + n[level == k] - (1 << k)]))
        return out


def lyndon_ends(order: np.ndarray) -> np.ndarray:
    """End of the longest Lyndon word at each place, for the suffixes in their order (the closing sign left out)."""
    n = len(order)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    rank, ends, stack = rank.tolist(), [n - 1] * (n - 1), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            ends[stack.pop()] = i
        stack.append(i)
    return np.array(ends, np.int64)


def runs_of(signs: list[int], least: int = LEAST_WORDS, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of the runs of a sequence of numbers from 1 on, in order."""
    n = len(signs)
    if n < max(least, 2):
        return np.zeros((0, 3), np.int64)
    tree = SuffixTree(signs)
    tour = tree.tour()
    right = Agreement(tree, tour)
    ends = [lyndon_ends(tree.suffixes(tour)), lyndon_ends(tree.suffixes(tree.tour(falling=True)))]
    del tree, tour
    back = SuffixTree(signs[::-1])
    left = Agreement(back, back.tour())
    del back
    i = np.concatenate([np.arange(n), np.arange(n)])
    j = np.concatenate(ends)
    few = (j - i) * exponent <= n
    i, j = i[few], j[few]
    period = j - i
    more = np.where(j < n, right(i, np.minimum(j, n)), 0)
    # suffix r of the reversal begins with sign n - 1 - r; what ends before a place is its suffix n - place
    less = np.where(i > 0, left(n - i, n - j), 0)
    length = period + more + less
    found = np.stack([i - less, length, period], axis=1)[(length >= least) & (length >= exponent * period)]
    found = np.unique(found, axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


# --------------------------------------------------------------- texts
def repeating(hashes: np.ndarray, row: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the stretches of words that runs can lie in; ``row``: each word's text.

    With period q a run has max(least, exponent * q) words or more, and so every group of
    ``gram`` of its words occurs again q words before or after, within the run. Groups
    without such a partner in their stretch, no farther than the stretch can have periods,
    are left out until none is found.
    """
    gram = max(1, least * (exponent - 2) // exponent + 1)
    n = len(hashes)
    if n < gram:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(n - gram + 1)
    at = at[row[at] == row[at + gram - 1]]
    grams = range_hash(prefix_sums(hashes), at, at + gram)
    within, reach = row[at], None  # the text, later the stretch, and the longest period that it has room for
    while True:
        keys = mix(grams + within.astype(U) * U(0x9E3779B97F4A7C15))
        order = np.argsort(keys) if reach is None else np.argsort(keys, kind="stable")
        pair = keys[order][1:] == keys[order][:-1]
        if reach is not None:
            pair &= np.diff(at[order]) <= reach[order][1:]
        again = np.zeros(len(at), bool)
        again[order[1:][pair]] = again[order[:-1][pair]] = True
        before = len(at)
        at, grams = at[again], grams[again]
        first = np.flatnonzero(np.append(True, (np.diff(at) > 1) | (np.diff(row[at]) > 0)))[: len(at)]
        size = np.diff(np.append(first, len(at))) + gram - 1
        within, reach = np.repeat(np.arange(len(first)), size - gram + 1), np.repeat(size // exponent, size - gram + 1)
        long = (size >= least)[within]
        at, grams, within, reach = at[long], grams[long], within[long], reach[long]
        if len(at) == before:
            return at[np.flatnonzero(np.append(True, np.diff(within) > 0))[: len(at)]], at[np.flatnonzero(np.append(np.diff(within) > 0, True))[: len(at)]] + gram


def text_runs(words: list[bytes], begin: np.ndarray, end: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """The runs of a text's words, all of which lie in the stretches [begin, end)."""
    names: dict[bytes, int] = {}
    signs, places = [], []
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        if signs:
            signs.append(0)
            places.append(np.array([-1]))
        signs += [names.setdefault(w, len(names) + 1) for w in words[a:b]]
        places.append(np.arange(a, b))
    alone = len(names)
    for k, x in enumerate(signs):
        if not x:
            alone += 1
            signs[k] = alone
    found = runs_of(signs, least, exponent)
    found[:, 0] = np.concatenate(places)[found[:, 0]]
    return found


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """Runs of each text and what stays once every run is cut to its first period.

    Returns doc_id, n_words, runs (array of (start, length, period) by start, then
    period; word numbers from 0) and collapsed (the kept words joined by one space): one
    row for each row of ``docs``. A run is a stretch of ``least`` words or more and of
    ``exponent`` (3 or more) times its smallest period or more that no neighbouring word
    extends. A word is dropped if any run holds it after that run's first period. Null
    and empty texts and those of spaces have no words, no runs and an empty collapsed text;
    repeated and null ids are rows like others; an empty table gives no rows; extra
    columns are ignored. Runs are exact: candidates go through hashes, runs through words.
    """
    if exponent < 3:
        raise ValueError("the exponent is 3 or more")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, offsets = utf8(part.column("text"))
            ids = part.column("doc_id").cast(pa.int64())
            for a, b in slices(offsets):
                body, cut = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                hashes, row, _, _ = word_hashes(body, cut, NOT_SPACE)
                begin, end = repeating(hashes, row, least, exponent)
                bounds = np.searchsorted(row, np.arange(b - a + 1))
                of = row[begin]
                per = np.searchsorted(of, np.arange(b - a + 1))
                raw, found, texts = memoryview(body), [], []
                for k in range(b - a):
                    words = bytes(raw[cut[k] : cut[k + 1]]).split()
                    lo, hi = per[k], per[k + 1]
                    if lo < hi:
                        rows = text_runs(words, begin[lo:hi] - bounds[k], end[lo:hi] - bounds[k], least, exponent)
                        if len(rows):
                            gone = np.zeros(len(words) + 1, np.int64)
                            np.add.at(gone, rows[:, 0] + rows[:, 2], 1)
                            np.add.at(gone, rows[:, 0] + rows[:, 1], -1)
                            words = [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]
                    else:
                        rows = np.zeros((0, 3), np.int64)
                    found.append(rows)
                    texts.append(b" ".join(words).decode("utf-8"))
                size = np.cumsum([0, *map(len, found)]).astype(np.int32)
                flat = np.concatenate(found)
                runs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(size), runs), pa.array(texts, pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return columns(docs, "doc_id", "text").mapInArrow(lean(run), f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


# --------------------------------------------------------------- the query
def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts whose id's crc32 is divisible by ten repeat a part of themselves, as the contract says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = columns(docs, "doc_id", "text").withColumn("h", h)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = rows.withColumn("w", F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), words))
    rows = rows.withColumns({"g": F.floor(F.col("h") / 10), "n": F.size("w").cast("long")}).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)])), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def digest(runs: Column) -> Column:
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return F.sha2(F.encode(F.concat(F.array_join(lines, "\n"), F.when(F.size(runs) > 0, F.lit("\n")).otherwise(F.lit(""))), "utf-8"), 256)


def best_run(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; on ties that of least start, then period."""
    better = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"]) | (
        (x["length"] * y["period"] == y["length"] * x["period"]) & (F.struct(x["start"], x["period"]) < F.struct(y["start"], y["period"]))
    )
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda acc, r: F.when(acc.isNull() | better(r, acc), r).otherwise(acc))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(planted(table(spark, sf_dir, "documents"))).withColumn("best", best_run(F.col("runs")))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        digest(F.col("runs")).alias("runs_sha256"), F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"),
    )


OP12_SQL = rf"""
WITH h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {CRC32_SQL.format("doc_id::VARCHAR")} AS h FROM documents),
g AS (SELECT doc_id, w, len(w)::BIGINT AS n, h, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM h),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE w END AS w FROM g),
p AS (SELECT doc_id, unnest(w) AS x, unnest(range(n)) AS i FROM d),
e AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i),
l AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS grp FROM e) GROUP BY doc_id, q, grp HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM l k WHERE k.doc_id = l.doc_id AND k.q < l.q AND k.s <= l.s AND k.s + k.len >= l.s + l.len)),
best AS (SELECT doc_id, s, len, q FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len::DOUBLE / q DESC, s, q) = 1),
runs AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q)) AS runs_sha256 FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM r),
kept AS (SELECT p.doc_id, sha256(string_agg(x, ' ' ORDER BY p.i)) AS kept FROM p ANTI JOIN gone ON p.doc_id = gone.doc_id AND p.i = gone.i GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, len::BIGINT AS length, q::BIGINT AS period, (1000 * len // q)::BIGINT AS exponent_milli,
       coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(kept, sha256('')) AS collapsed_sha256
FROM d LEFT JOIN runs ON d.doc_id = runs.doc_id LEFT JOIN best ON d.doc_id = best.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
