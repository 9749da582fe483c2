import hashlib
import random
import zlib

import pytest

from orderloom.llm.common import table
from orderloom.llm.runs import op12_periodic_runs, periodic_runs, planted, runs_of
from tests.llm.helpers import DOCS, as_dict, corpus, frame, words


def brute(s, least=24, exponent=3):
    """Every maximal stretch with period q of the least length, unless a smaller period holds all of it."""
    n, out = len(s), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            size = j - i + q
            if size >= max(least, exponent * q) and not any(s[i : i + size - d] == s[i + d : i + size] for d in range(1, q)):
                out.append((i, size, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {k for a, n, q in runs for k in range(a + q, a + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def periodic(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def sequences(rng, count):
    for _ in range(count):
        k, n = rng.choice([1, 2, 3, 5]), rng.randint(0, 90)
        s = [rng.randint(1, k) for _ in range(n)]
        for _ in range(rng.randint(0, 2) if n else 0):
            a, p, m = rng.randrange(n), rng.randint(1, 12), rng.randint(1, 60)
            for i in range(a + p, min(n, a + m)):
                s[i] = s[i - p]
        yield s


@pytest.mark.parametrize("least", [3, 6, 24])
def test_runs_of_sequences(least):
    for s in sequences(random.Random(least), 600):
        assert [tuple(r) for r in runs_of(s, least).tolist()] == brute(s, least)


def test_long_sequences():
    """Ranges over many blocks of the tour, and trees as deep as the text is long."""
    assert runs_of([1] * 5000).tolist() == [[0, 5000, 1]]
    rng = random.Random(5)
    root = [rng.randint(1, 9) for _ in range(700)]
    s = [10, *[root[i % 700] for i in range(4000)], 11]
    assert [1, 4000, 700] in runs_of(s).tolist()
    assert brute(s[:900]) == [tuple(r) for r in runs_of(s[:900]).tolist()]


@pytest.mark.parametrize("least, exponent", [(24, 3), (6, 3), (12, 4)])
def test_texts_against_brute_force(spark, least, exponent):
    rng = random.Random(11)
    rows = corpus(4, 30)
    for k in range(40):
        w = [rng.choice("a b c d e f g".split()) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(1, 3)):
            root = [rng.choice("a b c x y é".split()) for _ in range(rng.randint(1, 15))]
            w += (root * 9)[: rng.randint(10, 100)] + [f"own{rng.randint(0, 3)}"]
        rows.append((200 + k, rng.choice([" ", "\n", " \t"]).join(w), "", "", 0))
    got = as_dict(periodic_runs(frame(spark, rows), least, exponent))
    some = 0
    for r in rows:
        w = words(r[1])
        want = brute(w, least, exponent)
        some += len(want)
        assert [(x.start, x.length, x.period) for x in got[r[0]].runs] == want
        assert got[r[0]].n_words == len(w) and got[r[0]].collapsed == collapsed(w, want)
    assert some > 40


def test_odd_rows(spark):
    again = "a b " * 12
    rows = [(1, None, None, None, None), (2, "", "", "", 0), (3, " \n ", "", "", 0), (None, again, "", "", 0), (None, again, "", "", 0), (4, again + "c", "", "", 0), (4, "short", "", "", 0)]
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(frame(spark, rows)).collect())
    run = [(0, 24, 2)]
    assert got == sorted([("1", 0, [], ""), ("2", 0, [], ""), ("3", 0, [], ""), ("None", 24, run, "a b"), ("None", 24, run, "a b"), ("4", 25, run, "a b c"), ("4", 1, [], "short")])
    assert periodic_runs(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(frame(spark, rows), exponent=2)
    assert {r.doc_id: r.text for r in planted(frame(spark, [(k, None if k % 2 else "", "", "", 0) for k in range(40)])).collect()} == {k: None if k % 2 else "" for k in range(40)}


def test_query(spark, data):
    got, some = as_dict(op12_periodic_runs(spark, data)), 0
    for d in table(spark, data, "documents").collect():
        w = periodic(d.doc_id, words(d.text))
        if len(w) > 1500:
            continue  # brute force takes long; the SQL covers them
        want = brute(w)
        some += len(want)
        best = min(want, key=lambda r: (-r[1] / r[2], r[0], r[2])) if want else (None, None, None)
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if want else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, want).encode()).hexdigest()
    assert some > 5
