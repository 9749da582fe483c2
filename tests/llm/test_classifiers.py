import random
import zlib

import numpy as np
import pytest

from orderloom.llm import quality, toxicity
from orderloom.llm.features import STRUCTURE, Texts, structure, word_key
from tests.llm.helpers import DOCS, as_dict, frame

LABELS = "doc_id long, quality int, toxic int"


def made(n=400, seed=3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 90))]
        toxic, junk = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "moron", "zzqxgrub", "zzqxgrubber"])
        if junk:
            words = [w + "$$$" for w in words]
        text = " ".join(words)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


def texts(*values):
    raw = [v.encode() for v in values]
    return Texts(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64))


@pytest.mark.parametrize("scores, label", [(toxicity.toxicity_scores, 2), (quality.quality_scores, 1)])
def test_held_out_accuracy_and_form(spark, scores, label):
    rows, labels = made()
    rows += [(1000, None, None, None, None), (1001, "", None, None, 0), (1002, "word " * 30000, None, None, 1), (1003, rows[0][1], None, None, 1), (1004, rows[0][1], None, None, 1)]
    out = as_dict(scores(frame(spark, rows), spark.createDataFrame(labels, LABELS)))
    assert len(out) == len(rows)
    held = {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in out}
    assert all(r.held_out == held[k] and 0 <= r.score <= 1 for k, r in out.items())
    assert out[1003].score == out[1004].score
    mine = [lab for lab in labels if held[lab[0]]]
    right = sum(out[lab[0]].predicted == lab[label] for lab in mine)
    assert right >= 0.93 * len(mine)


def test_held_out_labels_teach_nothing(spark):
    rows, labels = made(150)
    flipped = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % 4 == 2 else (i, q, t) for i, q, t in labels]
    for scores in (toxicity.toxicity_scores, quality.quality_scores):
        a, b = (as_dict(scores(frame(spark, rows), spark.createDataFrame(x, LABELS))) for x in (labels, flipped))
        assert all(abs(a[k].score - b[k].score) < 1e-9 for k in a)


def test_no_labels_and_no_documents(spark):
    rows, labels = made(40)
    none = spark.createDataFrame([], LABELS)
    tox = as_dict(toxicity.toxicity_scores(frame(spark, rows), none))
    assert len(tox) == 40 and tox[0].score > tox[1].score
    assert len(as_dict(quality.quality_scores(frame(spark, rows), none))) == 40
    empty = spark.createDataFrame([], DOCS)
    for scores in (toxicity.toxicity_scores, quality.quality_scores):
        assert scores(empty, spark.createDataFrame(labels, LABELS)).count() == 0
    kept = toxicity.drop_toxic(frame(spark, rows, extra=False), none)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < kept.count() < 40


def test_patterns_fire():
    t = texts("an 1d10t here", "m o r o n", "You IDIOT", "idiot and moron", "nothing", "")
    v = toxicity.Voters([]).votes(t)
    p = len(toxicity.LEXICON)
    assert v[:, p].tolist() == [True, False, False, False, False, False]
    assert v[1, p + 1] and v[2, p + 2] and v[3, p + 3] and v[2, p + 4]
    assert not v[4:].any()


def test_label_model_recovers_rates():
    rng = np.random.default_rng(0)
    y = rng.random(200_000) < 0.1
    toxic, clean = np.array([0.5, 0.3, 0.4, 0.2]), np.array([0.01, 0.02, 0.005, 0.01])
    votes = rng.random((len(y), 4)) < np.where(y[:, None], toxic, clean)
    votes = np.concatenate([votes, votes[:, :1]], axis=1)  # a voter that repeats another
    label = y ^ (rng.random(len(y)) < 0.01)
    both = votes.T.astype(float) @ votes
    m = toxicity.fit_label_model(len(y), both, len(y), label.sum(), votes.sum(axis=0), votes[label].sum(axis=0))
    assert np.allclose(m.toxic[1:4], toxic[1:], atol=0.06) and np.allclose(m.clean[1:4], clean[1:], atol=0.01)
    assert m.weight[0] < 0.7 and m.weight[4] < 0.7 and m.weight[1] > 0.9


def test_machine_sums_all_pairs():
    rng = np.random.default_rng(2)
    m = quality.Machine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, 4)), None)
    idx, val = np.array([3, 9, 20, 3, 7]), np.array([0.5, 1.0, 2.0, 1.5, 0.2])
    want = []
    for part in ([0, 1, 2], [3, 4]):
        s = 0.3 + (m.w[idx[part]] * val[part]).sum()
        for a in part:
            for b in part:
                if a < b:
                    s += m.v[idx[a]] @ m.v[idx[b]] * val[a] * val[b]
        want.append(s)
    assert np.allclose(m.raw(np.array([0, 0, 0, 1, 1]), idx, val, 3), [*want, 0.3])


def test_features():
    t = texts("Ab ab éa", "", "x")
    assert t.hash[0] == t.hash[1] == word_key("AB") and t.bounds.tolist() == [0, 3, 3, 4]
    assert structure(t).shape == (3, len(STRUCTURE)) and np.isfinite(structure(t)).all()


def plain_votes(text, mined):
    """The voters in plain Python."""
    import re

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    said = re.findall(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+", text)
    words = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", low)
    out = [any(w in of for w in words) for _, of in toxicity.LEXICON]
    insults = {w for _, of in toxicity.LEXICON[:-5] for w in of}
    at = [i for i, w in enumerate(words) if w in insults]
    table = dict(toxicity.DISGUISE)
    masked, spelled = set(), set()
    for m in re.finditer(r"[A-Za-z013457@$!]+", text):
        run = m[0]
        if re.search(r"[A-Za-z][013457@$!](?:[A-Za-z]|[013457@$!][A-Za-z])", run):
            masked.add("".join(table.get(c, c) for c in run).lower())
    for m in re.finditer(r"(?:(?<=[^A-Za-z0-9])|^)(?:[a-z0-9][^A-Za-z0-9]+){3,}[a-z0-9](?![A-Za-z0-9])", low):
        spelled.add("".join(re.findall("[a-z0-9]", m[0])))
    for found in (masked, spelled):
        known = [w for w in found if w in toxicity.WORD_VOTER]
        for w in known:
            out[toxicity.WORD_VOTER[w]] = True
        out.append(bool(known))
    out.append(any(said[i].isascii() and not re.search("[a-z{|}~]", said[i]) for i in at))
    out.append(len(at) >= 2)
    out.append(any(i >= gap and words[i - gap] in toxicity.ADDRESS for i in at for gap in (1, 2, 3)))
    return out + [sum(w == m for w in words) >= least for m, least in mined]


def test_votes_and_posteriors_against_plain_python():
    rng = random.Random(11)
    pool = [w for _, of in toxicity.LEXICON for w in of] + ["IDIOT", "Moron", "1d10t", "st4pid", "m0r0n", "l0s3r", "a", "b", "you", "your", "u"] + ["plain", "words", "here", "été"] * 12
    rows = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["m o r o n", "you are an idiot", "x i d i o t y", ""]
    mined = [("plain", 2), ("here", 1)]
    voters = toxicity.Voters([(int(word_key(w) >> np.uint64(1) << np.uint64(1)), n) for w, n in mined])
    order = np.argsort([int(word_key(w) >> np.uint64(1) << np.uint64(1)) for w, _ in mined])
    got = voters.votes(texts(*rows))
    want = np.array([plain_votes(r, [mined[i] for i in order]) for r in rows])
    assert got.shape == want.shape and (got == want).all(), [(rows[i], np.flatnonzero(got[i] != want[i])) for i in np.flatnonzero((got != want).any(axis=1))[:3]]
    # the posterior of each text by Bayes' rule over the voters that fire, in plain Python
    import math

    j = voters.size
    m = toxicity.LabelModel(0.1, np.linspace(0.2, 0.6, j), np.linspace(0.01, 0.05, j), np.linspace(0.5, 1.0, j), 0.9, 0.02)
    label = np.array([rng.choice([-1, 0, 1]) for _ in rows])
    for i, p in enumerate(m.posterior(got, label)):
        one, zero = math.log(0.1), math.log(0.9)
        for v in range(j):
            if want[i, v]:
                one += m.weight[v] * math.log(m.toxic[v])
                zero += m.weight[v] * math.log(m.clean[v])
        if label[i] >= 0:
            one += math.log(0.9 if label[i] else 0.1)
            zero += math.log(0.02 if label[i] else 0.98)
        assert abs(p - 1 / (1 + math.exp(zero - one))) < 1e-9
