"""Similarity of short keys (ids N2-N5): native bounds and one Arrow function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs that are compared side by side; those of one chunk are of like lengths.
LANES = 4096


def _signs(keys: np.ndarray, pad: int) -> np.ndarray:
    """Code points of strings, a row each, filled up with ``pad``."""
    wide = max(1, keys.dtype.itemsize // 4)
    points = keys.view(np.uint32).reshape(len(keys), wide)
    return np.where(points == 0, np.uint32(pad), points)


def lcs_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair of strings (numpy ``U`` arrays).

    Bit-parallel (Hyyro), one lane of 64-bit words for each pair: a bit for each sign of
    ``a``, taken through the signs of ``b`` all lanes at once; keys of more than 64
    signs take several words with carries. U+0000 is not expected in keys.
    """
    la, lb = np.char.str_len(a), np.char.str_len(b)
    out = np.zeros(len(a), np.int64)
    order = np.lexsort((lb, la))
    for at in range(0, len(a), LANES):
        rows = order[at : at + LANES]
        wide, deep = max(1, int(la[rows].max())), int(lb[rows].max())
        words = -(-wide // 64)
        left = _signs(a[rows].astype(f"U{wide}"), 0x110000)
        right = _signs(b[rows].astype(f"U{max(1, deep)}"), 0x110001)
        bits = np.zeros((len(rows), words * 64), bool)
        bits[:, :wide] = np.arange(wide) < la[rows, None]
        full = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        state = full.copy()
        for j in range(deep):
            bits[:, :wide] = left == right[:, j, None]
            same = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
            carry = np.zeros(len(rows), np.uint64)
            for w in range(words):
                x = state[:, w]
                hit = x & same[:, w]
                total = x + hit
                over = total < x
                total = total + carry
                carry = (over | (total < carry)).astype(np.uint64)
                state[:, w] = total | (x - hit)
        out[rows] = la[rows] - np.bitwise_count(state & full).sum(axis=1)
    return out


def ratios(a: pd.Series, b: pd.Series) -> np.ndarray:
    x, y = (np.array(s.tolist(), dtype=str) if len(s) else np.zeros(0, "U1") for s in (a, b))
    total = np.char.str_len(x) + np.char.str_len(y)
    return np.where(total > 0, 200.0 * lcs_lengths(x, y) / np.maximum(total, 1), 100.0)


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(ratios(a, b))


def indel_ratio(a: Column, b: Column) -> Column:
    """200 * LCS / (len(a) + len(b)), in Arrow batches."""
    return F.pandas_udf(_ratios, "double")(a, b)


def token_sorted(c: Column) -> Column:
    """The words of a key in order, as N3 compares them."""
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda t: t != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """indel_ratio of the sorted words."""
    return indel_ratio(token_sorted(a), token_sorted(b))


def _guarded(a: pd.Series, b: pd.Series, sa: pd.Series, sb: pd.Series) -> pd.Series:
    out = pd.Series(np.where((a == "") | (a == b), 100.0, 0.0))
    ask = ((a != "") & (a != b) & (b != "")).to_numpy()
    plain = ratios(a[ask], b[ask])
    # the boost for other word order needs likeness to begin with
    turned = ((sa[ask] != a[ask]) | (sb[ask] != b[ask])).to_numpy() & (plain >= 60)
    plain[turned] = ratios(sa[ask][turned], sb[ask][turned])
    out[ask] = plain
    return out


def field_score(q: Column, r: Column) -> Column:
    """100 for a blank query or equal keys, 0 for a blank record, else the ratio,
    by sorted words once the plain ratio is 60. Nulls are blanks."""
    q, r = F.coalesce(q, F.lit("")), F.coalesce(r, F.lit(""))
    return F.pandas_udf(_guarded, "double")(q, r, token_sorted(q), token_sorted(r))


def grams(c: Column, size: int) -> Column:
    """The parts of ``size`` signs of a key, each with how often it has occurred so far: a multiset as a set."""
    at = F.sequence(F.lit(1), F.length(c) - (size - 1))
    parts = F.when(F.length(c) >= size, F.transform(at, lambda i: F.substring(c, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    return F.transform(parts, lambda p, i: F.concat(p, F.size(F.filter(F.slice(parts, F.lit(1), i + 1), lambda x: x == p)).cast("string")))


def shared_grams(la: Column, lb: Column, least: Column) -> tuple[Column, Column]:
    """(pairs, letters): pairs of signs, and letters, that keys of these lengths share at a ratio of ``least``.

    The common subsequence has L >= least * (la + lb) / 200 letters. Of the pairs of signs of a
    key, a letter outside it breaks two at most, and one of the other key one at most.
    """
    common = F.ceil(least * (la + lb) / 200 - 1e-9).cast("int")
    pairs = F.greatest(la - 1 - 2 * (la - common) - (lb - common), lb - 1 - 2 * (lb - common) - (la - common))
    return pairs, common


def combined_score(p: Column, d: Column, w: Column, has_p: Column, has_d: Column) -> Column:
    """The weighted score of province, district and ward."""
    return (
        F.when(has_p & has_d, p * 0.42 + d * 0.28 + w * 0.30).when(has_p, p * 0.55 + w * 0.45).when(has_d, d * 0.38 + w * 0.62).otherwise(w)
    )
