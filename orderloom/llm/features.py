"""Word and structure features of texts, computed on whole Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import LETTERS, LOWER, NOT_SPACE, U, byte_values, columns, held_out, lean, mix, prefix_sums, range_hash, row_bounds, slices, utf8, word_spans

#: Labelled rows that a classifier is fitted on, at most.
SAMPLE_ROWS = 12_000


def word_key(word: str) -> np.uint64:
    """The hash that :class:`Texts` gives to this word (lower case, letters and digits)."""
    raw = LOWER[np.frombuffer(word.encode("utf-8"), np.uint8)]
    return range_hash(prefix_sums(byte_values(raw)), np.array([0]), np.array([len(raw)]))[0]


class Texts:
    """A slice of texts with its words: runs of letters and digits, A-Z lowered."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        low = LOWER[data]
        self.start, self.end, self.row = word_spans(low, offsets, LETTERS)
        self.sums = prefix_sums(byte_values(low))
        self.hash = range_hash(self.sums, self.start, self.end)
        self.bounds = row_bounds(self.row, self.n)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct word hashes of each row, sorted within it; bounds of the rows)."""
        value = self.hash.copy()
        for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True):
            value[a:b].sort()
        head = np.append(True, (value[1:] != value[:-1]) | (self.row[1:] != self.row[:-1]))[: len(value)]
        return value[head], row_bounds(self.row[head], self.n)

    def per_row(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each row the byte mask marks."""
        sums = np.append(0, np.cumsum(mask))
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def in_rows(self, of_words: np.ndarray) -> np.ndarray:
        """Sum over each row of a number per word."""
        sums = np.append(0.0, np.cumsum(of_words, dtype=np.float64))
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]


def structure(t: Texts) -> np.ndarray:
    """Structure statistics of each row, about zero to one each, in the order of STRUCTURE."""
    data, size = t.data, np.maximum(np.diff(t.offsets), 1)
    upper = (data >= 65) & (data <= 90)
    lower = ((data >= 97) & (data <= 122)) | (data >= 128)
    space = ~NOT_SPACE[data]
    digit = (data >= 48) & (data <= 57)
    sign = NOT_SPACE[data] & ~LETTERS[data]
    doubled = np.append(sign[1:] & sign[:-1] & (data[1:] == data[:-1]), False) if len(data) else sign
    words = np.diff(t.bounds)
    some = np.maximum(words, 1)
    length = t.end - t.start
    uniq, ub = t.distinct()
    same = np.append(False, (t.hash[1:] == t.hash[:-1]) & (t.row[1:] == t.row[:-1])) if len(t.hash) else np.zeros(0, bool)
    letters = np.maximum(t.per_row(upper | lower), 1)
    return np.stack([
        t.per_row(upper) / letters,
        t.per_row(sign) / size,
        t.per_row(doubled) / size,
        t.per_row(digit) / size,
        t.per_row(space) / size,
        t.per_row(data == 10) / some,
        t.per_row(data == 124) / some,
        t.per_row((data == 33) | (data == 63)) / some,
        t.per_row((data == 46) | (data == 44)) / some,
        np.diff(ub) / some,
        t.in_rows(same) / some,
        t.in_rows(length) / some / 12,
        t.in_rows(length <= 3) / some,
        np.log1p(words) / 10,
        t.in_rows(length >= 20) / some,
    ], axis=1)


# Names of the columns of structure(), in order.
STRUCTURE = (
    "upper", "signs", "doubled signs", "digits", "spaces", "lines", "bars", "shouts", "stops", "distinct words", "repeated words",
    "word length", "short words", "words", "long words",
)


def mapped(docs: DataFrame, fn: Callable[[Texts], list[pa.Array]], schema: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of each row beside what ``fn`` gives for its text; schema: of fn's columns."""
    kinds = dict(docs.dtypes)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, offsets = utf8(part.column("text"))
            for a, b in slices(offsets, 1 << 20):
                t = Texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([*(part.column(c).slice(a, b - a) for c in keep), *fn(t)], [*keep, *names])

    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(lean(run), ", ".join([*(f"{c} {kinds[c]}" for c in keep), schema]))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, n_chars, text, label of at most ``rows`` labelled rows outside the held-out fold.

    The rows are those with the least keyed hashes of their ids, the same on each
    run and of any table size; the sample of labels is small and so is broadcast. Of a
    repeated doc_id the longest text (on ties the greatest) stands for it.
    """
    known = columns(labels, "doc_id", label).filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(rows)
    mine = columns(docs, "doc_id", "n_chars", "text").join(F.broadcast(chosen), "doc_id")
    one = F.max(F.struct(F.octet_length("text").alias("size"), "text", "n_chars")).alias("d")
    return mine.groupBy("doc_id", "label").agg(one).select("doc_id", "d.n_chars", "d.text", "label")


def hash_bins(hashes: np.ndarray, bins: int) -> np.ndarray:
    return (mix(hashes) >> U(64 - (bins.bit_length() - 1))).astype(np.int64)
