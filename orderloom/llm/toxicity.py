"""Toxicity by weak supervision.

Many lexicon and pattern voters vote on each text. A generative label model takes
the voters' pairwise moments over all documents outside the held-out fold and
estimates each voter's accuracy from triplets of moments (for voters that are
independent given the class, cov_ij * cov_ik / cov_jk depends on i alone) and the
correlations that are left over, by which it discounts voters that repeat each
other. Known labels of that fold are one more voter. A linear classifier is then
trained on posterior labels and scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm.common import U, columns, drop_written, held_out, lean, mix, range_hash, slices, table, utf8, written
from orderloom.llm.features import SAMPLE_ROWS, Texts, mapped, training_sample, word_key

THRESHOLD = 0.3
#: Mined marks (words and word beginnings) that the classifier weighs, and those that vote.
MAX_MARKS = 600
MINED = 24
MIN_SUPPORT = 6
#: Lengths in bytes of the word beginnings that are marks: compounds share them.
BEGINNINGS = (4, 5, 6, 7, 8)

# Lexicon voters (name, words in lower case).
LEXICON = (
    ("idiot", ("idiot", "idiots", "idiotic")),
    ("moron", ("moron", "morons", "moronic")),
    ("stupid", ("stupid", "stupidity", "dumb", "dumbass")),
    ("imbecile", ("imbecile", "cretin", "dimwit", "halfwit", "dunce")),
    ("loser", ("loser", "losers")),
    ("pathetic", ("pathetic", "laughable")),
    ("worthless", ("worthless", "useless")),
    ("disgusting", ("disgusting", "repulsive", "revolting", "vile")),
    ("trash", ("trash", "garbage", "rubbish", "filth")),
    ("scum", ("scum", "vermin", "parasite", "parasites", "lowlife")),
    ("clown", ("clown", "clowns", "buffoon")),
    ("freak", ("freak", "weirdo", "creep", "psycho")),
    ("swearing", ("shit", "fuck", "fucking", "bitch", "bastard", "asshole", "crap")),
    ("hatred", ("hate", "despise", "loathe")),
    ("threat", ("kill", "murder", "strangle", "destroy")),
    ("german", ("dummkopf", "arschloch", "trottel", "abschaum", "widerlich", "wertlos", "versager", "vollidiot")),
    ("french", ("imbécile", "crétin", "connard", "débile", "minable", "ordure", "salaud", "abruti")),
    ("spanish", ("idiota", "imbécil", "estúpido", "estúpida", "basura", "asqueroso", "patético", "escoria", "inútil")),
)
# How letters are disguised.
DISGUISE = (("0", "o"), ("1", "i"), ("3", "e"), ("4", "a"), ("5", "s"), ("7", "t"), ("@", "a"), ("$", "s"), ("!", "i"))
PATTERNS = ("disguised insult", "spelled-out insult", "shouted insult", "repeated insult", "addressed insult")
ADDRESS = ("you", "your", "youre", "u")

WORD_VOTER = {w: j for j, (_, words) in enumerate(LEXICON) for w in words}
_UNMASK = bytes.maketrans(*(bytes("".join(x), "ascii") for x in zip(*DISGUISE, strict=True)))


def mark_hashes(t: Texts) -> np.ndarray:
    """words x (1 + beginnings): hash of each word and of its beginnings, 0 where it is too short."""
    out = np.zeros((len(t.hash), 1 + len(BEGINNINGS)), U)
    out[:, 0] = t.hash
    sums = t.sums
    for k, n in enumerate(BEGINNINGS, 1):
        long = np.flatnonzero(t.end - t.start >= n)
        out[long, k] = mix(range_hash(sums, t.start[long], t.start[long] + n) + U(n))
    return out >> U(1) << U(1)  # the low bit is left for a count


class Marks:
    """Counts of chosen marks in each text."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.may = np.zeros(1 << 16, bool)
        self.may[(self.keys >> U(48)).astype(np.int64)] = True

    def counts(self, t: Texts, hashes: np.ndarray) -> np.ndarray:
        """rows x marks: 0, 1 or 2 (twice or more)."""
        out = np.zeros((t.n, len(self.keys)), np.int8)
        if not len(self.keys) or not len(hashes):
            return out
        word, kind = np.nonzero(self.may[(hashes >> U(48)).astype(np.int64)])
        key = hashes[word, kind]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        cell, times = np.unique(t.row[word[hit]] * len(self.keys) + at[hit], return_counts=True)
        out.ravel()[cell] = np.minimum(times, 2)
        return out


class Voters:
    """The lexicon and pattern voters, and ``mined`` marks (hash, least count) that vote too."""

    def __init__(self, mined: list[tuple[int, int]]):
        keys = np.array([word_key(w) for w in WORD_VOTER], U)
        order = np.argsort(keys)
        self.keys, self.voter = keys[order], np.array(list(WORD_VOTER.values()))[order]
        self.marks = Marks(np.array([k for k, _ in mined], U))
        least = dict(mined)
        self.least = np.array([least[int(k)] for k in self.marks.keys], np.int8)
        self.address = np.sort(np.array([word_key(w) for w in ADDRESS], U))
        self.size = len(LEXICON) + len(PATTERNS) + len(mined)

    def votes(self, t: Texts, hashes: np.ndarray | None = None) -> np.ndarray:
        """rows x voters, True where the voter fires."""
        out = np.zeros((t.n, self.size), bool)
        at = np.minimum(np.searchsorted(self.keys, t.hash), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == t.hash)
        which = self.voter[at[hit]]
        out[t.row[hit], which] = True
        p = len(LEXICON)
        insult = np.zeros(len(t.hash), bool)
        insult[hit[which < len(LEXICON) - 5]] = True  # the English insults proper
        for row, word in self.disguised(t):
            if word in WORD_VOTER:
                out[row, WORD_VOTER[word]] = out[row, p] = True
        for row, word in self.spelled(t):
            if word in WORD_VOTER:
                out[row, WORD_VOTER[word]] = out[row, p + 1] = True
        found = np.flatnonzero(insult)
        upper = np.array([bool((t.data[t.start[i] : t.end[i]] < 91).all()) for i in found], bool)
        out[t.row[found[upper]], p + 2] = True
        out[:, p + 3] = t.in_rows(insult) >= 2
        near = np.isin(t.hash, self.address)
        for gap in (1, 2, 3):
            if len(near) > gap:
                pair = np.flatnonzero(near[:-gap] & insult[gap:] & (t.row[:-gap] == t.row[gap:]))
                out[t.row[pair], p + 4] = True
        if len(self.least):
            out[:, p + len(PATTERNS) :] = self.marks.counts(t, mark_hashes(t) if hashes is None else hashes) >= self.least
        return out

    @staticmethod
    def disguised(t: Texts) -> Iterator[tuple[int, str]]:
        """Words in which one or two digits or signs stand between letters, with letters put back."""
        d = t.data
        letter = ((d >= 65) & (d <= 90)) | ((d >= 97) & (d <= 122))
        sign = np.isin(d, np.frombuffer(b"013457@$!", np.uint8))
        if len(d) < 4:
            return
        after = letter[2:] | (sign[2:] & np.append(letter[3:], False))
        for i in np.flatnonzero(letter[:-2] & sign[1:-1] & after).tolist():
            row = int(np.searchsorted(t.offsets, i, side="right") - 1)
            if i + (3 if letter[i + 2] else 4) > t.offsets[row + 1]:
                continue  # the next text's beginning
            a, b = i, i + 3
            while a > 0 and i - a < 16 and (letter[a - 1] or sign[a - 1]):
                a -= 1
            while b < len(d) and b - i < 19 and (letter[b] or sign[b]):
                b += 1
            yield row, d[max(a, t.offsets[row]) : min(b, t.offsets[row + 1])].tobytes().translate(_UNMASK).decode("ascii").lower()

    @staticmethod
    def spelled(t: Texts) -> Iterator[tuple[int, str]]:
        """Four or more one-letter words in a row, joined."""
        one = (t.end - t.start) == 1
        if len(one) < 4:
            return
        edge = np.flatnonzero(np.diff(np.concatenate([[0], one.astype(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= 4:
                for row in np.unique(t.row[a:b]).tolist():
                    mine = np.arange(a, b)[t.row[a:b] == row]
                    raw = t.data[t.start[mine]].tobytes()
                    if raw.isascii():
                        yield row, raw.decode("ascii").lower()


# --------------------------------------------------------------- label model
class LabelModel:
    """Class share, and for each voter its rates of firing and its weight.

    ``toxic``, ``clean``: P(fires | class). ``weight``: 1 / (1 + correlation with
    other voters that the class does not explain).
    """

    def __init__(self, share: float, toxic: np.ndarray, clean: np.ndarray, weight: np.ndarray, label_toxic: float, label_clean: float):
        self.share, self.toxic, self.clean, self.weight = share, toxic, clean, weight
        self.label_toxic, self.label_clean = label_toxic, label_clean

    def posterior(self, votes: np.ndarray, label: np.ndarray) -> np.ndarray:
        """P(toxic | votes, label); label -1 is unknown.

        A voter that does not fire abstains: lexicons of one language say nothing
        about texts of another, so their silence is no evidence.
        """
        logit = np.log(self.share / (1 - self.share)) + votes @ (np.log(self.toxic / self.clean) * self.weight)
        a, b = self.label_toxic, self.label_clean
        logit += np.select([label == 1, label == 0], [np.log(a / b), np.log((1 - a) / (1 - b))], 0.0)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_label_model(n: float, both: np.ndarray, n_labelled: float, n_toxic: float, labelled: np.ndarray, on_toxic: np.ndarray) -> LabelModel:
    """From counts: documents, voters firing together (matrix), labelled documents,
    those labelled toxic, voters firing on either."""
    j = len(both)
    share = float(np.clip((n_toxic + 1) / (n_labelled + 10), 0.005, 0.5))
    rate = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(rate, rate)
    # labels as one more voter, its moments from the labelled documents
    label_cov = on_toxic / max(n_labelled, 1) - labelled / max(n_labelled, 1) * (n_toxic / max(n_labelled, 1))
    spread = share * (1 - share)
    gap = np.zeros(j)
    excluded = np.eye(j, dtype=bool)
    for _ in range(2):
        for i in range(j):
            ok = ~excluded[i] & (np.diag(both) >= 5)
            k, m = np.triu_indices(j, 1)
            use = ok[k] & ok[m] & ~excluded[k, m] & (cov[k, m] > 1e-12)
            squares = cov[i, k[use]] * cov[i, m[use]] / cov[k[use], m[use]]
            if n_labelled >= 50:
                other = np.flatnonzero(ok & (label_cov > 1e-12))
                squares = np.append(squares, cov[i, other] * label_cov[i] / label_cov[other])
            squares = squares[squares > 0]
            gap[i] = np.sqrt(np.median(squares) / spread) if len(squares) and both[i, i] >= 5 else 0.0
            if n_labelled >= 50 and label_cov[i] < 0:
                gap[i] = 0.0
        # what of a pair's covariance the class leaves unexplained, as a correlation
        scale = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
        residual = np.maximum(0.0, cov - np.outer(gap, gap) * spread) / np.outer(scale, scale)
        np.fill_diagonal(residual, 0.0)
        excluded = (residual > 0.3) | np.eye(j, dtype=bool)
    clean = np.clip(rate - share * gap, 1e-4, 0.5)
    toxic = np.clip(clean + gap, clean, 0.98)
    seldom = np.diag(both) < 5  # too rare to tell: lean towards toxic, weakly
    toxic[seldom], clean[seldom] = 0.02, 0.004
    # labels: right about toxic texts as often as the voters' agreement says
    strong = np.argsort(-gap)[:3]
    agree = [label_cov[i] / (gap[i] * spread) for i in strong if gap[i] > 0.01] if n_labelled >= 50 else []
    label_gap = float(np.clip(np.median(agree), 0.3, 0.98)) if agree else 0.9
    label_clean = float(np.clip(n_toxic / max(n_labelled, 1) - share * label_gap, 0.002, 0.2))
    return LabelModel(share, toxic, clean, 1 / (1 + residual.sum(axis=1)), min(label_clean + label_gap, 0.99), label_clean)


def moments(docs: DataFrame, labels: DataFrame, voters: Voters) -> LabelModel:
    """The label model from counts over all documents outside the held-out fold."""
    known = columns(labels, "doc_id", "toxic").filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    rows = columns(docs, "doc_id", "text").filter(~held_out())
    j = voters.size

    def bits(t: Texts) -> list[pa.Array]:
        return [pa.array([np.flatnonzero(v).astype(np.int32) for v in voters.votes(t)], pa.list_(pa.int32()))]

    voted = mapped(rows, bits, "fired array<int>").join(known.hint("merge"), "doc_id", "left")
    every = F.array_union(F.col("fired"), F.array(F.lit(j)))  # number j fires always: counts of single voters
    pairs = voted.select("label", F.explode(every).alias("a"), every.alias("fired")).select("label", "a", F.explode("fired").alias("b"))
    counts = pairs.groupBy("a", "b", "label").count().collect()  # (voters + 1)^2 * 3 rows at most
    both, by_label = np.zeros((j + 1, j + 1)), np.zeros((2, j + 1))
    for r in counts:
        both[r["a"], r["b"]] += r["count"]
        if r["label"] is not None and r["b"] == j:
            by_label[r["label"], r["a"]] += r["count"]
    return fit_label_model(both[j, j], both[:j, :j], by_label[:, j].sum(), by_label[1, j], by_label[:, :j].sum(axis=0), by_label[1, :j])


# --------------------------------------------------------------- classifier
class Linear:
    """Logistic weights of voters and of marks (there at all, there twice)."""

    def __init__(self, bias: float, weights: np.ndarray, voters: Voters, marks: Marks):
        self.bias, self.weights, self.voters, self.marks = bias, weights, voters, marks

    def inputs(self, t: Texts) -> np.ndarray:
        hashes = mark_hashes(t)
        counts = self.marks.counts(t, hashes)
        return np.concatenate([self.voters.votes(t, hashes), counts >= 1, counts >= 2], axis=1)

    def score(self, t: Texts) -> np.ndarray:
        raw = self.bias + self.inputs(t) @ self.weights
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def one_of_each(sample: DataFrame) -> DataFrame:
    """The sample without near copies: one row for each least pair of words.

    A copied text would otherwise make its own words look telling.
    """

    def least(t: Texts) -> list[pa.Array]:
        pair = np.append(t.hash[:-1] * U(3) + t.hash[1:], U(0))[: len(t.hash)]
        return [pa.array([int(pair[a:b].min()) - (1 << 63) if b > a else i for i, (a, b) in enumerate(zip(t.bounds[:-1], t.bounds[1:], strict=True))], pa.int64())]

    keyed = mapped(sample, least, "least long", keep=("doc_id", "label"))
    chosen = keyed.groupBy("least", "label").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return sample.join(F.broadcast(chosen), "doc_id", "left_semi")  # no more rows than the sample's bound


def llr(k1: np.ndarray, k0: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Log-likelihood ratio of a mark's presence against the classes."""

    def part(k: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-12) / np.maximum(e, 1e-12)), 0.0)

    share, total = n1 / max(n1 + n0, 1e-9), k1 + k0
    return 2 * (part(k1, total * share) + part(k0, total * (1 - share)))


def mine(sample: DataFrame, limit: int = MAX_MARKS) -> list[tuple[int, int]]:
    """(mark hash, least count) of marks that toxic texts of the sample have more, best first."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, offsets = utf8(part.column("text"))
            label = part.column("label").to_numpy()
            for a, b in slices(offsets, 1 << 20):
                t = Texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                hashes = mark_hashes(t)
                keys, ones = [], []
                for i in range(t.n):
                    key, times = np.unique(hashes[t.bounds[i] : t.bounds[i + 1]], return_counts=True)
                    for least in (1, 2):
                        mine = key[(times >= least) & (key != 0)]
                        keys.append(mine | U(least - 1))  # the low bit tells the least count
                        ones.append(np.full(len(mine), label[a + i]))
                key, which = np.unique(np.concatenate(keys), return_inverse=True)
                one = np.bincount(which, np.concatenate(ones), len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(one), pa.array(np.bincount(which, minlength=len(key)))], ["key", "ones", "n"])

    sizes = sample.groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in sizes}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return []
    counts = sample.select("text", "label").mapInArrow(lean(run), "key long, ones long, n long").groupBy("key").agg(F.sum("ones").alias("k1"), F.sum("n").alias("n"))
    telling = counts.filter((F.col("k1") >= MIN_SUPPORT) & (F.col("k1") / F.col("n") > 2.0 * n1 / (n1 + n0))).toPandas()  # bounded as the sample is
    k1 = telling["k1"].to_numpy(np.float64)
    ratio = llr(k1, telling["n"].to_numpy(np.float64) - k1, n1, n0)
    key = telling["key"].to_numpy(np.int64).view(np.uint64)
    out: dict[int, int] = {}
    for i in np.lexsort((key, -ratio)):
        if ratio[i] < 25 or len(out) >= limit:
            break
        out.setdefault(int(key[i] >> U(1) << U(1)), int(key[i] & U(1)) + 1)
    return list(out.items())


def apart(chosen: list[tuple[int, int]], sample: DataFrame, limit: int = MINED) -> list[tuple[int, int]]:
    """The first ``limit`` marks that do not fire on the same texts of the sample as one before."""
    marks = Marks(np.array([k for k, _ in chosen[: 8 * limit]], U))
    column = {int(k): i for i, k in enumerate(marks.keys)}

    def fires(t: Texts) -> list[pa.Array]:
        return [pa.array([c.tobytes() for c in marks.counts(t, mark_hashes(t))], pa.binary())]

    got = mapped(sample, fires, "counts binary").select("counts").toPandas()["counts"]
    counts = np.stack([np.frombuffer(c, np.int8) for c in got]) if len(got) else np.zeros((0, len(column)), np.int8)
    out: list[tuple[int, int]] = []
    seen: list[np.ndarray] = []
    for key, least in chosen[: 8 * limit]:
        mine = counts[:, column[key]] >= least
        if len(out) < limit and all((mine & o).sum() < 0.5 * (mine | o).sum() for o in seen):
            out.append((key, least))
            seen.append(mine)
    return out


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Linear:
    """The classifier: marks and weights come from at most ``sample_rows`` labelled
    rows, the label model from all documents, both outside the held-out fold."""
    sample = written(training_sample(docs, labels, "toxic", sample_rows), "toxic-sample", parts=6)
    unlike = written(one_of_each(sample), "toxic-unlike", parts=6)
    chosen = mine(unlike)
    voters = Voters(apart(chosen, unlike))
    model = moments(docs, labels, voters)
    marks = Marks(np.array([k for k, _ in chosen], U))
    linear = Linear(0.0, np.zeros(0), voters, marks)

    def rows(t: Texts) -> list[pa.Array]:
        return [pa.array([np.packbits(r).tobytes() for r in linear.inputs(t)], pa.binary())]

    got = mapped(unlike, rows, "inputs binary", keep=("doc_id", "label")).toPandas().sort_values(["doc_id", "label"], ignore_index=True)
    width = voters.size + 2 * len(marks.keys)
    x = np.stack([np.unpackbits(np.frombuffer(r, np.uint8), count=width) for r in got["inputs"]]).astype(np.float32) if len(got) else np.zeros((0, width), np.float32)
    target = model.posterior(x[:, : voters.size] > 0, got["label"].to_numpy(np.float64))
    # start the voters where the label model has them; then full-batch steps with momentum
    w, bias = np.zeros(width), float(np.log(model.share / (1 - model.share)))
    w[: voters.size] = np.log(model.toxic / model.clean) * model.weight
    prior, speed, speed_b, n = w.copy(), np.zeros(width), 0.0, max(len(x), 1)
    for _ in range(300 if len(x) else 0):
        err = (1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30))) - target) / n
        speed = 0.9 * speed - 1.0 * (x.T @ err + (w - prior) * 3e-4)
        speed_b = 0.9 * speed_b - 0.5 * err.sum()
        w, bias = w + speed, bias + speed_b
    drop_written(sample, unlike)
    return Linear(bias, w, voters, marks)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``.

    Null and empty texts have the score of a text on which no voter fires. Labels
    outside 0 and 1 and null ids teach nothing; of several labels of one id the
    greatest counts; without labels the voters' own agreement decides. Rows that
    repeat a doc_id are scored each by its text; an empty table gives no rows;
    extra columns are ignored.
    """
    model = train(docs, labels, **how)
    out = mapped(columns(docs, "doc_id", "text"), lambda t: [pa.array(model.score(t))], "score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below ``threshold``, all their columns kept.

    Each row is judged by its own text, whatever its id; null and empty texts stay unless
    an empty text itself scores that high; labels as in ``toxicity_scores``; an empty table
    gives no rows; extra columns of any name are kept.
    """
    model = train(docs, labels)
    # columns travel by number, so that they can have any names
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{docs.columns.index('text')}"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, offsets = utf8(part.column(text))
            for a, b in slices(offsets, 1 << 20):
                t = Texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield part.slice(a, b - a).filter(pa.array(model.score(t) < threshold))

    return plain.mapInArrow(lean(run), plain.schema).toDF(*docs.columns)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
