"""Quality classifier: a factorisation machine.

Inputs are hashed words, structure statistics (in bins) and metadata (the declared
character count against the text's own). All pairs of inputs interact through
low-rank factors, and the sum over pairs is computed in linear time from
1/2 * sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2].
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm.common import columns, held_out, lean, slices, table, utf8
from orderloom.llm.features import SAMPLE_ROWS, STRUCTURE, Texts, hash_bins, mapped, structure, training_sample

WORD_BINS = 1 << 14
STAT_BINS = 10
RANK = 8
EPOCHS = 12
THRESHOLD = 0.7
SCHEMA = "idx array<int>, val array<float>"


def inputs(t: Texts, cuts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, input number, value) of every nonzero input, row after row.

    ``cuts`` (statistics x inner bin edges) turns each statistic into one of
    STAT_BINS inputs; without cuts only words are given.
    """
    words, wb = t.distinct()
    n = np.diff(wb)
    row = np.repeat(np.arange(t.n), n)
    idx = hash_bins(words, WORD_BINS)
    # words of a row share unit length, so long texts do not outweigh their structure
    val = np.repeat(1 / np.sqrt(np.maximum(n, 1)), n)
    if cuts is not None:
        stats = structure(t)
        bins = np.stack([np.searchsorted(cuts[j], stats[:, j], side="right") for j in range(stats.shape[1])], axis=1)
        more = WORD_BINS + np.arange(stats.shape[1]) * STAT_BINS + bins
        row = np.concatenate([row, np.repeat(np.arange(t.n), stats.shape[1])])
        idx = np.concatenate([idx, more.ravel()])
        val = np.concatenate([val, np.full(more.size, 0.5)])
        order = np.argsort(row, kind="stable")
        row, idx, val = row[order], idx[order], val[order]
    return row, idx, val


SIZE = WORD_BINS + len(STRUCTURE) * STAT_BINS + 4
META_AT = SIZE - 4


def meta_bin(declared: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Metadata input of each row: 0 none declared, 1 equal to the text's, 2 fewer, 3 more."""
    known = declared >= 0
    return np.where(~known, 0, np.where(declared == chars, 1, np.where(declared < chars, 2, 3)))


class Machine:
    """Weights w0, w (inputs), V (inputs x rank); logistic output."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray, cuts: np.ndarray):
        self.w0, self.w, self.v, self.cuts = w0, w, v, cuts

    def raw(self, row: np.ndarray, idx: np.ndarray, val: np.ndarray, n: int) -> np.ndarray:
        bounds = np.searchsorted(row, np.arange(n + 1))

        def by_row(x: np.ndarray) -> np.ndarray:
            s = np.zeros((len(x) + 1, *x.shape[1:]))
            np.cumsum(x, axis=0, out=s[1:])
            return s[bounds[1:]] - s[bounds[:-1]]

        vx = self.v[idx] * val[:, None]
        pairs = (by_row(vx) ** 2 - by_row(vx**2)).sum(axis=1) / 2
        return self.w0 + by_row(self.w[idx] * val) + pairs


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, cuts: np.ndarray, rank: int = RANK, epochs: int = EPOCHS, seed: int = 3, rate: float = 0.05, l2: float = 1e-3) -> Machine:
    """Adagrad over shuffled mini-batches of rows (input numbers, values)."""
    rng = np.random.Generator(np.random.PCG64(seed))
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    m = Machine(float(np.log(share / (1 - share))), np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, rank)), cuts)
    gw, gv, g0 = np.full(SIZE, 1e-6), np.full((SIZE, rank), 1e-6), 1e-6
    order = np.arange(len(rows))
    for _ in range(epochs if len(set(labels.tolist())) > 1 else 0):
        rng.shuffle(order)
        for at in range(0, len(order), 256):
            pick = order[at : at + 256]
            n = np.array([len(rows[i][0]) for i in pick])
            row = np.repeat(np.arange(len(pick)), n)
            idx, val = np.concatenate([rows[i][0] for i in pick]), np.concatenate([rows[i][1] for i in pick]).astype(np.float64)
            p = 1 / (1 + np.exp(-m.raw(row, idx, val, len(pick))))
            err = (p - labels[pick]) / len(pick)
            vx = m.v[idx] * val[:, None]
            bounds = np.append(0, np.cumsum(n))
            sums = np.append(np.zeros((1, rank)), np.cumsum(vx, axis=0), axis=0)
            sums = sums[bounds[1:]] - sums[bounds[:-1]]
            e = err[row] * val
            # gradients of one input from all its rows
            by = np.argsort(idx, kind="stable")
            first = np.flatnonzero(np.append(True, idx[by][1:] != idx[by][:-1]))
            used = idx[by][first]
            dw = np.add.reduceat(e[by], first) + l2 * m.w[used] / 100
            dv = np.add.reduceat((e[:, None] * (sums[row] - vx))[by], first, axis=0) + l2 * m.v[used] / 100
            gw[used] += dw**2
            gv[used] += dv**2
            g0 += err.sum() ** 2
            m.w[used] -= rate * dw / np.sqrt(gw[used])
            m.v[used] -= rate / 4 * dv / np.sqrt(gv[used])
            m.w0 -= rate * err.sum() / np.sqrt(g0)
    return m


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, rank: int = RANK) -> Machine:
    """A machine fitted on at most ``sample_rows`` labelled rows outside the held-out fold."""
    sample = training_sample(docs, labels, label, sample_rows).withColumn("chars", F.coalesce(F.length("text"), F.lit(0)))

    def rows(t: Texts) -> list[pa.Array]:
        row, idx, val = inputs(t, None)
        bounds = pa.array(np.searchsorted(row, np.arange(t.n + 1)).astype(np.int32))
        stats = structure(t)
        flat = pa.array(np.arange(t.n + 1, dtype=np.int32) * stats.shape[1])
        return [
            pa.ListArray.from_arrays(bounds, pa.array(idx.astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(val.astype(np.float32))),
            pa.ListArray.from_arrays(flat, pa.array(stats.ravel().astype(np.float32))),
        ]

    got = mapped(sample, rows, f"{SCHEMA}, stats array<float>", keep=("doc_id", "label", "n_chars", "chars")).toPandas()
    got = got.sort_values("doc_id", ignore_index=True)
    stats = np.stack(got["stats"].to_list()) if len(got) else np.zeros((0, len(STRUCTURE)))
    edges = np.linspace(0, 1, STAT_BINS + 1)[1:-1]
    cuts = np.quantile(stats, edges, axis=0).T if len(got) else np.tile(edges, (len(STRUCTURE), 1))
    meta = meta_bin(got["n_chars"].astype("float64").fillna(-1).to_numpy(), got["chars"].to_numpy())
    ready = []
    for i in range(len(got)):
        bins = np.array([np.searchsorted(cuts[j], stats[i, j], side="right") for j in range(len(STRUCTURE))])
        more = np.append(WORD_BINS + np.arange(len(STRUCTURE)) * STAT_BINS + bins, META_AT + meta[i])
        ready.append((np.append(got["idx"][i], more).astype(np.int64), np.append(got["val"][i], np.full(len(more), 0.5))))
    return fit(ready, got["label"].to_numpy(np.float64), cuts, rank)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score for every row of ``docs``; null and empty texts are scored by their structure."""
    rows = columns(docs, "doc_id", "n_chars", "text").select(
        "doc_id", "text",
        F.when(F.col("n_chars").isNull(), 0).when(F.col("n_chars") == F.coalesce(F.length("text"), F.lit(0)), 1)
        .when(F.col("n_chars") < F.coalesce(F.length("text"), F.lit(0)), 2).otherwise(3).alias("meta"),
    )
    kind = dict(rows.dtypes)["doc_id"]

    def run(parts):

        for part in parts:
            data, offsets = utf8(part.column("text"))
            meta = part.column("meta").to_numpy()
            for a, b in slices(offsets, 1 << 20):
                t = Texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                row, idx, val = inputs(t, machine.cuts)
                row = np.append(row, np.arange(t.n))
                order = np.argsort(row, kind="stable")
                idx = np.append(idx, META_AT + meta[a:b])[order]
                val = np.append(val, np.full(t.n, 0.5))[order]
                raw = machine.raw(row[order], idx, val, t.n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").slice(a, b - a), pa.array(1 / (1 + np.exp(-raw)))], ["doc_id", "score"])

    return rows.mapInArrow(lean(run), f"doc_id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``.

    Labels outside 0 and 1 and null ids teach nothing; of several labels of one id
    the greatest counts; without labels of both kinds every score is the share of
    ones (one half without any). Rows that repeat a doc_id are scored each by its
    text; an empty table gives no rows; extra columns are ignored.
    """
    out = score(docs, train(docs, labels, **how))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
