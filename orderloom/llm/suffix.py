"""Suffix-array dedup of byte strings across documents.

Texts are sharded by content. Every ``length``-byte window has one anchor, the
least of its ``gram``-byte hashes, and equal windows have equal anchors; the
stretch of windows that share an anchor is a slice. Anchors seen in one document
only cannot mark a repeat and are dropped by an exchange of hashes. The slices
around the other anchors go, once per batch and content, to the shard that the
anchor's hash names. An anchor that has the same bytes around it everywhere is
settled by its least document. For the rest the shard sorts all suffixes of its
distinct slices (Larsson-Sadakane refinement in numpy), finds equal windows from
Kasai's common prefixes, and gives each window its least document. Arrays hold
whole anchors; an anchor too large for one array is cut into several whose sorted
windows are merged by binary search. The windows around an anchor that very many slices have (a phrase that a third
of all documents hold) go to shards by their own hashes instead. Each batch then
removes the windows that start in a smaller document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm.batches import (
    COUNTED_SCHEMA, Batch, batch_rows, bucket_bits, counted_key_rows, make_batches, read_answers, repeated_keys, short, total_bytes, with_answers,
)
from orderloom.llm.common import BLOCK, U, byte_values, content_hashes, lean, mix, powers, prefix_sums, table, written

LENGTH = 50
GRAM = 20
#: Bytes of slices in one suffix array.
ARRAY_BYTES = 2 << 20
#: Slices around one anchor from which on their windows go to shards of their own.
HOT_SLICES = 1 << 17
#: Bytes of slices that a shard is planned for.
SHARD_BYTES = 8 << 20
POSITION_BITS = 20  # of a block-relative position packed under a hash
SEPARATOR = 0xFF  # in no UTF-8 text
INF = np.iinfo(np.int64).max
SLICE_SCHEMA = "shard int, batch_id long, anchors binary, sizes binary, least binary, most binary, data binary"
FOUND_SCHEMA = "batch_id long, bucket int, slices binary, starts binary, lengths binary, least binary"


# --------------------------------------------------------------- anchors
def anchor_slices(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(anchor hash, first window, number of windows, row) of every slice, in order.

    Windows are the ``length``-byte strings inside one row. The leftmost of equal
    least hashes is the anchor, so the choice depends on the window's bytes only.
    """
    n, span = len(data), length - gram + 1
    low = U((1 << POSITION_BITS) - 1)
    valid = np.ones(max(n, 0), bool)
    tail = (offsets[1:, None] - np.arange(1, length)).ravel()
    valid[tail[tail >= np.repeat(offsets[:-1], length - 1)]] = False
    keys, place = [], []
    inv = powers(BLOCK + length, inverse=True)
    for b in range(0, n - length + 1, BLOCK):
        seg = data[b : b + BLOCK + length - 1]
        sums = prefix_sums(byte_values(seg))
        h = (sums[gram:] - sums[:-gram]) * inv[: len(seg) - gram + 1]
        h ^= h >> U(32)
        h *= U(0xD6E8FEB86659FD93)
        packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        least, width = packed, 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        at = (least & low).astype(np.int64)
        keys.append(h[at])
        place.append(at + b)
    if not keys:
        z = np.zeros(0, np.int64)
        return z.astype(U), z, z, z
    key, anchor = np.concatenate(keys), np.concatenate(place)
    ok = valid[: len(anchor)]
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1])
    last = ok.copy()
    last[:-1] &= ~ok[1:] | new[1:]
    first, end = np.flatnonzero(new), np.flatnonzero(last) + 1
    return mix(key[first]), first, end - first, np.searchsorted(offsets, first, side="right") - 1


class Slices:
    """A batch's slices and the distinct ones around anchors that other documents have."""

    def __init__(self, batch: Batch, length: int, gram: int):
        self.batch, self.length = batch, length
        self.key, self.first, self.windows, self.row = anchor_slices(batch.data, batch.offsets, length, gram)
        known = batch.known[self.row]
        self.doc = batch.ids[self.row]
        if not known.all():
            self.select(known)

    def anchors(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct short keys, index of each slice's, whether two documents of the batch have it)."""
        keys, which = np.unique(short(self.key, bits), return_inverse=True)
        least, most = np.full(len(keys), INF), np.full(len(keys), -INF)
        np.minimum.at(least, which, self.doc)
        np.maximum.at(most, which, self.doc)
        return keys, which, least != most

    def scatter(self, hot: np.ndarray) -> None:
        """Makes each window of the hot slices a slice whose key is the window's own hash, so that one anchor fills many shards."""
        if not hot.any():
            return
        at = np.flatnonzero(hot)
        n = self.windows[at]
        first = np.arange(int(n.sum())) + np.repeat(self.first[at] - np.cumsum(n) + n, n)
        key = mix(content_hashes(self.batch.data, first, first + self.length, 1) + U(1))
        row, doc = np.repeat(self.row[at], n), np.repeat(self.doc[at], n)
        rest = ~hot
        first = np.append(self.first[rest], first)
        order = np.argsort(first, kind="stable")
        self.first = first[order]
        self.key, self.row, self.doc = (np.append(x[rest], y)[order] for x, y in ((self.key, key), (self.row, row), (self.doc, doc)))
        self.windows = np.append(self.windows[rest], np.ones(len(key), np.int64))[order]

    def select(self, chosen: np.ndarray) -> None:
        self.key, self.first, self.windows, self.row, self.doc = (x[chosen] for x in (self.key, self.first, self.windows, self.row, self.doc))

    def number(self) -> None:
        """Numbers the distinct contents by (key, content)."""
        self.content = content_hashes(self.batch.data, self.first, self.first + self.windows + self.length - 1, 1)
        order = np.lexsort((self.content, self.key))
        k, c = self.key[order], self.content[order]
        head = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))[: len(k)]
        self.slice_of = np.empty(len(k), np.int64)
        self.slice_of[order] = np.cumsum(head) - 1
        self.chosen = order[head]  # one occurrence of each distinct slice, ordered by anchor
        self.least, self.most = np.full(len(self.chosen), INF), np.full(len(self.chosen), -INF)
        np.minimum.at(self.least, self.slice_of, self.doc)
        np.maximum.at(self.most, self.slice_of, self.doc)


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(the ranges' bytes one after the other with ``gap`` separators after each, where each begins)."""
    begin = np.cumsum(size + gap) - size - gap
    out = np.full(int((size + gap).sum()), SEPARATOR, np.uint8)
    to = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
    out[to] = data[to + np.repeat(start - begin, size)]
    return out, begin


# --------------------------------------------------------------- suffix arrays
def words8(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a big-endian number, zeros past the end."""
    padded = np.concatenate([text, np.zeros(7, np.uint8)])
    out = np.zeros(len(text), U)
    for k in range(8):
        out <<= U(8)
        out |= padded[k : k + len(text)]
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order, by Larsson-Sadakane refinement.

    Suffixes start sorted by their first eight bytes; each round sorts only the
    groups still tied, by the rank of the suffix ``h`` further on, and doubles h.
    """
    n = len(text)
    word = words8(text)
    # the end of the text sorts before any byte, a zero byte included
    short_by = np.zeros(n, np.int8)
    short_by[max(0, n - 7) :] = np.arange(8 - min(n, 7), 8)
    sa = np.lexsort((-short_by, word)) if n and text[-8:].min() == 0 else np.argsort(word)
    word, short_by = word[sa], short_by[sa]
    head = np.append(True, (word[1:] != word[:-1]) | (short_by[1:] != short_by[:-1]))[:n]
    del word, short_by
    rank = np.zeros(n + 1, np.uint32)
    rank[sa] = np.flatnonzero(head)[np.cumsum(head) - 1] + 1  # 0 is the rank of the empty suffix
    h = 8
    while True:
        tied = ~(head & np.append(head[1:], True))
        at = np.flatnonzero(tied)
        if not len(at):
            return sa
        suffix = sa[at]
        key = rank[suffix].astype(np.uint64) * U(n + 1) + rank[np.minimum(suffix + h, n)].astype(np.uint64)
        order = np.argsort(key)
        key, suffix = key[order], suffix[order]
        sa[at] = suffix
        head[at[1:]] |= key[1:] != key[:-1]
        rank[suffix] = np.flatnonzero(head)[(np.cumsum(head) - 1)[at]] + 1
        del key, order, suffix
        h *= 2


#: The least numbers of one byte, two bytes and so on.
BYTE_STEPS = U(1) << np.arange(0, 64, 8, dtype=np.uint64)


def common_prefixes(text: np.ndarray, sa: np.ndarray, cap: int, lanes: int = 8192) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, up to ``cap``.

    Kasai's recurrence - a suffix shares with its predecessor at least one byte less
    than the suffix one place before it does with its own - run over ``lanes``
    stretches of the text at once.
    """
    n = len(text)
    out = np.zeros(n, np.int32)
    if n < 2:
        return out
    rank = np.empty(n, np.int32)
    rank[sa] = np.arange(n, dtype=np.int32)
    before = np.full(n, n, np.int32)
    before[sa[1:]] = sa[:-1]
    word = words8(np.concatenate([text, np.zeros(cap + 16, np.uint8)]))
    end = np.full(n + 1, cap, np.int32)
    end[max(0, n - cap) :] = np.arange(min(n, cap), -1, -1)
    step = -(-n // lanes)
    lane = np.arange(0, n, step)
    h = np.zeros(len(lane), np.int64)
    for t in range(step):
        i = lane + t
        i = i[i < n]
        h = np.maximum(h[: len(i)] - 1, 0)
        j = before[i]
        most = np.minimum(end[i], end[j])
        h = np.minimum(h, most)
        live = np.flatnonzero(h < most)
        while len(live):
            x = word[i[live] + h[live]] ^ word[j[live] + h[live]]
            same = 8 - np.searchsorted(BYTE_STEPS, x, side="right")  # equal leading bytes of two words
            h[live] = np.minimum(h[live] + same, most[live])
            live = live[(same == 8) & (h[live] < most[live])]
        out[rank[i]] = h
    return out


def least_by_window(text: np.ndarray, begin: np.ndarray, windows: np.ndarray, least: np.ndarray, length: int):
    """For slices laid out in ``text``: (places of the windows, sorted by content; group of each; least of each group)."""
    sa = suffix_array(text)
    lcp = common_prefixes(text, sa, length)
    owner = np.full(len(text), -1, np.int32)
    at = np.arange(int(windows.sum())) + np.repeat(begin - (np.cumsum(windows) - windows), windows)
    owner[at] = np.repeat(np.arange(len(begin), dtype=np.int32), windows)
    del at
    new = lcp < length
    # suffixes between two windows of a group share at least as much, so a group is never broken
    is_window = owner[sa] >= 0
    group = np.cumsum(new)[is_window]
    place = sa[is_window]
    head = np.append(True, group[1:] != group[:-1])[: len(group)]
    group = np.cumsum(head) - 1
    low = np.minimum.reduceat(least[owner[place]], np.flatnonzero(head)) if len(place) else np.zeros(0, np.int64)
    return place, group, low


def window_strings(text: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Windows as fixed-width byte strings, which compare byte by byte."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, length)[place]).view(f"S{length}")[:, 0]


def find_sorted(have: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of ``want`` in the sorted ``have``: (insert place, whether equal)."""
    at = np.searchsorted(have, want)
    same = at < len(have)
    same[same] = have[at[same]] == want[same]
    return at, same


def merge_arrays(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Least of each window over all parts, for each part's sorted distinct windows."""
    every, low = parts[0]
    for have, mine in parts[1:]:
        at, same = find_sorted(every, have)
        low = low.copy()
        np.minimum.at(low, at[same], mine[same])
        every, low = np.insert(every, at[~same], have[~same]), np.insert(low, at[~same], mine[~same])
    return [low[find_sorted(every, have)[0]] for have, _ in parts]


def slice_leasts(data: np.ndarray, begin: np.ndarray, size: np.ndarray, key: np.ndarray, least: np.ndarray, length: int, array_bytes: int = ARRAY_BYTES) -> np.ndarray:
    """For distinct slices: the least document of each of their windows, one slice after the other."""
    windows = size - length + 1
    out = np.repeat(least, windows)
    first = np.cumsum(windows) - windows
    # slices alone under their anchor are settled; the others need their suffixes sorted
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    rest = np.flatnonzero(count[which] > 1)
    if not len(rest):
        return out
    rest = rest[np.argsort(key[rest], kind="stable")]  # an anchor's slices side by side
    for edge in array_edges(key[rest], size[rest] + 1, array_bytes):
        parts, where = [], []
        for a, z in zip(edge[:-1], edge[1:], strict=True):
            mine = rest[a:z]
            text, at = gather(data, begin[mine], size[mine], gap=1)
            place, group, low = least_by_window(text, at, windows[mine], least[mine], length)
            head = np.append(True, group[1:] != group[:-1])[: len(group)]
            owner = np.searchsorted(at, place, side="right") - 1
            where.append((first[mine][owner] + place - at[owner], group))
            parts.append((window_strings(text, place[head], length) if len(edge) > 2 else np.zeros(0, "S1"), low))
        lows = merge_arrays(parts) if len(parts) > 1 else [parts[0][1]]
        for (to, group), low in zip(where, lows, strict=True):
            out[to] = low[group]
    return out


def array_edges(key: np.ndarray, size: np.ndarray, array_bytes: int) -> list[np.ndarray]:
    """For slices sorted by anchor: the edges of arrays that have to be merged, set by set.

    An array holds whole anchors, and as equal windows have equal anchors it shares no
    window with others; only an anchor larger than an array is cut, into a set of its own.
    """
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    end = np.cumsum(size)
    start = (end - size)[head]
    large = np.diff(np.append(start, end[-1])) > array_bytes
    number = start // array_bytes
    new = np.append(True, (number[1:] != number[:-1]) | large[1:] | large[:-1])
    sets = []
    for a, z, many in zip(head[new], np.append(head[new][1:], len(key)), large[new], strict=True):
        inner = end[a:z] - (end[a] - size[a])
        cut = a + 1 + np.searchsorted(inner, np.arange(array_bytes, int(inner[-1]), array_bytes)) if many else []
        sets.append(np.unique(np.concatenate([[a], np.minimum(cut, z), [z]]).astype(np.int64)))
    return sets


# --------------------------------------------------------------- the operator
def suffix_dedup(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, array_bytes: int = ARRAY_BYTES, shard_bytes: int = SHARD_BYTES, hot_slices: int = HOT_SLICES,
) -> DataFrame:
    """What stays of each document once bytes that repeat a smaller document are removed.

    Returns doc_id, n_bytes, n_removed, removed (array of (start, end) byte ranges,
    maximal runs), kept (binary): one row for each row of ``docs``. A byte goes when
    a ``length``-byte string over it also starts in a document with a smaller
    doc_id; strings never cross documents and are judged on the input. Null and
    empty texts have no bytes; shorter texts lose nothing; rows with equal doc_id do
    not remove from each other; rows with a null doc_id neither lose nor cause a
    loss; an empty table gives no rows; extra columns are ignored.
    """
    if not 8 <= gram <= length:
        raise ValueError("gram must lie between 8 and length")
    batches = make_batches(docs)
    n_bytes = total_bytes(batches)
    bits = bucket_bits(n_bytes * 2 // (length - gram + 2))

    def anchors(batch: Batch) -> Iterator[pa.RecordBatch]:
        keys, which, twice = Slices(batch, length, gram).anchors(bits)
        yield from counted_key_rows(batch.batch_id, keys, twice, np.bincount(which, minlength=len(keys)), bits)

    shared = written(repeated_keys(batches.mapInArrow(batch_rows(anchors), COUNTED_SCHEMA), hot_slices), "shared-anchors")
    # slices are about twice a window long; a quarter of all anchors in a plan is typical, more only fills shards more
    shards = max(1, -(-n_bytes // shard_bytes))

    def chosen(batch: Batch, answers: pa.Table) -> Slices:
        s = Slices(batch, length, gram)
        keys, which, _ = s.anchors(bits)
        shared_by, hot = (read_answers(answers, keys, bits, c)[which] for c in ("mask", "hot"))
        s.select(shared_by)
        s.scatter(hot[shared_by])
        s.number()
        s.shard = (s.key[s.chosen] % U(shards)).astype(np.int64)
        return s

    def send(batch: Batch, answers: pa.Table) -> Iterator[pa.RecordBatch]:
        s = chosen(batch, answers)
        order = np.argsort(s.shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(s.shard[order])) + 1):
            if len(part):
                pick = s.chosen[part]
                size = s.windows[pick] + length - 1
                body, _ = gather(batch.data, s.first[pick], size)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(s.shard[part[0]])], pa.int32()), pa.array([batch.batch_id], pa.int64()),
                        *(pa.array([x.tobytes()], pa.binary()) for x in (s.key[pick], size.astype(np.uint32), s.least[part], s.most[part], body)),
                    ],
                    ["shard", "batch_id", "anchors", "sizes", "least", "most", "data"],
                )

    sent = with_answers(batches, shared, send, SLICE_SCHEMA)

    def sort_shard(group: pa.Table) -> pa.Table:
        col = {n: group.column(n).to_pylist() for n in group.column_names}
        keys, sizes = [np.frombuffer(x, U) for x in col["anchors"]], [np.frombuffer(x, np.uint32).astype(np.int64) for x in col["sizes"]]
        key, size = np.concatenate(keys), np.concatenate(sizes)
        least, most = (np.concatenate([np.frombuffer(x, np.int64) for x in col[c]]) for c in ("least", "most"))
        data = np.frombuffer(b"".join(col.pop("data")), np.uint8)
        begin = np.cumsum(size) - size
        # equal slices of several batches become one with the least document
        content = content_hashes(data, begin, begin + size, 1)
        order = np.lexsort((content, key))
        head = np.append(True, (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1]))
        which = np.empty(len(key), np.int64)
        which[order] = np.cumsum(head) - 1
        pick = order[head]
        low = np.minimum.reduceat(least[order], np.flatnonzero(head))
        found = slice_leasts(data, begin[pick], size[pick], key[pick], low, length, array_bytes)
        windows = size[pick] - length + 1
        first = np.cumsum(windows) - windows
        out = {n: [] for n in ("batch_id", "bucket", "slices", "starts", "lengths", "least")}
        lo = 0
        for batch_id, ks in zip(col["batch_id"], keys, strict=True):
            mine = which[lo : lo + len(ks)]
            n = size[lo : lo + len(ks)] - length + 1
            value = found[np.arange(int(n.sum())) + np.repeat(first[mine] - np.cumsum(n) + n, n)]
            owner = np.repeat(np.arange(len(ks)), n)
            # runs of windows with one least document, if some occurrence in the batch is of a greater one
            cut = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])))
            run = np.diff(np.append(cut, len(value)))
            keep = value[cut] < most[lo : lo + len(ks)][owner[cut]]
            cut, run = cut[keep], run[keep]
            if len(cut):
                start = cut - (np.cumsum(n) - n)[owner[cut]]
                for name, x in (("slices", owner[cut].astype(np.uint32)), ("starts", start.astype(np.uint32)), ("lengths", run.astype(np.uint32)), ("least", value[cut])):
                    out[name].append(x.tobytes())
                out["batch_id"].append(batch_id)
                out["bucket"].append(-1 - col["shard"][0])
            lo += len(ks)
        kinds = {"batch_id": pa.int64(), "bucket": pa.int32()}
        return pa.table({n: pa.array(v, kinds.get(n, pa.binary())) for n, v in out.items()})

    found = written(sent.groupBy("shard").applyInArrow(lean(sort_shard), FOUND_SCHEMA), "least-documents")
    both = shared.select("batch_id", "bucket", "mask", "hot", *[F.lit(None).cast("binary").alias(c) for c in ("slices", "starts", "lengths", "least")]).unionByName(
        found.withColumns({c: F.lit(None).cast("binary") for c in ("mask", "hot")})
    )

    def remove(batch: Batch, answers: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket = answers.column("bucket").to_numpy()
        s = chosen(batch, answers.filter(pa.array(bucket >= 0)).select(["batch_id", "bucket", "mask", "hot"]))
        runs = answers.filter(pa.array(bucket < 0))
        in_shard = np.argsort(s.shard, kind="stable")
        base = {int(k): int(a) for k, a in zip(*np.unique(s.shard[in_shard], return_index=True), strict=True)}
        ids, starts, lengths, leasts = [], [], [], []
        for i, b in enumerate(runs.column("bucket").to_pylist()):
            ids.append(in_shard[base[-1 - b] + np.frombuffer(runs.column("slices")[i].as_py(), np.uint32).astype(np.int64)])
            starts.append(np.frombuffer(runs.column("starts")[i].as_py(), np.uint32).astype(np.int64))
            lengths.append(np.frombuffer(runs.column("lengths")[i].as_py(), np.uint32).astype(np.int64))
            leasts.append(np.frombuffer(runs.column("least")[i].as_py(), np.int64))
        gone = np.zeros(len(batch.data) + 1, np.int64)
        if ids:
            ids, starts, lengths, leasts = map(np.concatenate, (ids, starts, lengths, leasts))
            # every occurrence of a distinct slice meets every run of that slice
            by_slice = np.argsort(s.slice_of, kind="stable")
            count = np.bincount(s.slice_of, minlength=len(s.chosen))
            begin = np.cumsum(count) - count
            times = count[ids]
            occ = by_slice[np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times - begin[ids], times)]
            r = np.repeat(np.arange(len(ids)), times)
            hit = leasts[r] < s.doc[occ]
            at = s.first[occ[hit]] + starts[r[hit]]
            np.add.at(gone, at, 1)
            np.add.at(gone, at + lengths[r[hit]] + length - 1, -1)
        yield byte_rows(batch, np.cumsum(gone)[:-1] > 0)

    return with_answers(batches, both, remove, "doc_id long, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary")


def byte_rows(batch: Batch, gone: np.ndarray) -> pa.RecordBatch:
    """One row for each document of the batch; ``gone``: for each byte."""
    off = batch.offsets
    edge = np.zeros(len(gone) + 1, bool)
    edge[off] = True
    begins = np.flatnonzero(gone & (edge[:-1] | ~np.append(False, gone[:-1]))) if len(gone) else np.zeros(0, np.int64)
    ends = np.flatnonzero(gone & (edge[1:] | ~np.append(gone[1:], False))) + 1 if len(gone) else begins
    kept, per = batch.data[~gone], np.searchsorted(begins, off)
    where = np.append(0, np.cumsum(~gone))[off]
    n = np.diff(off)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    row = np.searchsorted(off, begins, side="right") - 1
    inner = pa.StructArray.from_arrays([pa.array(begins - off[row]), pa.array(ends - off[row])], ["start", "end"])
    return pa.RecordBatch.from_arrays(
        [
            batch.raw_ids, pa.array(n), pa.array(n - np.diff(where)),
            pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), inner).cast(span),
            pa.array([kept[where[i] : where[i + 1]].tobytes() for i in range(len(n))], pa.binary()),
        ],
        ["doc_id", "n_bytes", "n_removed", "removed", "kept"],
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, p, substr(x, 2 * p - 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(1, len(x) // 2 - 48)) AS p FROM h WHERE len(x) >= 100)),
m AS (SELECT s, min(doc_id) AS d FROM w GROUP BY s),
hit AS (SELECT doc_id, p FROM w JOIN m USING (s) WHERE d < doc_id),
edge AS (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 50, true) AS fresh FROM hit),
run AS (SELECT doc_id, r, min(p) AS a, max(p) + 50 AS b FROM (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM edge) GROUP BY doc_id, r),
gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS lo, a AS hi FROM run UNION ALL SELECT doc_id, max(b), NULL FROM run GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * lo - 1, 2 * (coalesce(hi, len(x) // 2 + 1) - lo)), '' ORDER BY lo) AS k FROM gap JOIN h USING (doc_id) GROUP BY doc_id),
cut AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans FROM run GROUP BY doc_id)
SELECT h.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM h LEFT JOIN kept ON h.doc_id = kept.doc_id LEFT JOIN cut ON h.doc_id = cut.doc_id
"""
