import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from orderloom.llm.common import table
from orderloom.llm.trie import MARK, compacted, fattest_number, op11_prefix_trie, prefix_trie

ROWS = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def key(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def gathered(rows):
    """conv_id -> its turns (role, text) in order."""
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, key(role or "", text or ""), role or "", text or ""))
    return {c: [t[3:] for t in sorted(ts)] for c, ts in out.items()}


def brute(convs):
    """Rows of COLUMNS from conv_id -> turns."""
    members, kids = defaultdict(list), defaultdict(set)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].add(p)

    def below(p):
        out, stack = [], [p]
        while stack:
            out.append(stack.pop())
            stack += kids[out[-1]]
        return out

    rows = []
    for p, cs in members.items():
        under = below(p)
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(convs[c]) == len(p)))
        rows.append((
            min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), sum(not kids[q] for q in under),
            sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(rows, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()), key=str)


def conversations(rng, n):
    """Shared and unshared beginnings, one long chain, copies, wide nodes, one very long conversation."""
    system = [("system", "a shared beginning é")]
    chain = [("user", f"step {k}") for k in range(40)]
    rows = []
    for c in range(n):
        kind = c % 7
        ts = [(rng.choice(("user", "assistant")), f"text {rng.randint(0, 3)}") for _ in range(rng.randint(1, 6))]
        if kind in (1, 2):
            ts = system + ts
        if kind == 3:
            ts = chain[: rng.randint(1, 40)] + ts[: rng.randint(0, 2)]
        if kind == 4:
            ts = [("user", f"own {c}"), *ts]
        if kind == 5:
            ts = [*system, ("user", f"own {c}"), ("assistant", "yes")]
        if kind == 6:
            ts = [*system, ("user", "the same"), ("assistant", "copy")]
        rows += [(c, k, role, text) for k, (role, text) in enumerate(ts)]
    return rows + [(n, k, "user", f"step {k}") for k in range(150)]


def test_local_tries():
    mark = lambda *names: b"".join(bytes([0] * k + [x]).ljust(MARK, b"\1") for k, x in enumerate(names))
    strings = sorted([mark(1, 2, 3), mark(1, 2), mark(1, 2, 4, 5, 6), mark(1, 7), mark(9)])
    nodes = {(s[: d * MARK], up) for up, d, s in compacted(strings)}
    assert nodes == {(mark(1), 0), (mark(1, 2), 1), (mark(1, 2, 3), 2), (mark(1, 2, 4, 5, 6), 2), (mark(1, 7), 1), (mark(9), 0)}
    for low in range(40):
        for high in range(low + 1, 60):
            f = fattest_number(low, high)
            assert low < f <= high and all((x & -x) <= (f & -f) for x in range(low + 1, high + 1))


@pytest.mark.parametrize("first, growth, seed", [(5, 3, 1), (4096, 8, 2)])
def test_against_brute_force(spark, first, growth, seed):
    rows = conversations(random.Random(seed), 150)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    assert got(prefix_trie(df, first, growth)) == brute(gathered(rows))


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 5, "", ""), (2, 6, "user", "a"), (None, 0, "user", "x"), (3, 1, "u", "ser"), (4, 1, "us", "er"), (-7, 1, "u", "ser")]
    df = spark.createDataFrame(rows, ROWS)
    for name in ("n", "marks", "name", "first", "id", "edge", "turns", "key"):
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("x"))
    assert got(prefix_trie(df)) == brute(gathered(rows))
    empty = prefix_trie(spark.createDataFrame([], ROWS))
    assert empty.count() == 0 and tuple(empty.columns) == COLUMNS


def test_query(spark, data):
    convs = gathered([tuple(r) for r in table(spark, data, "conversations").select("conv_id", "turn", "role", "text").collect()])
    built = {}
    for c, ts in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = convs.get(c - c % 100, [])[:h] + ts[h:]
    assert got(op11_prefix_trie(spark, data)) == brute(built)


def test_turnless_conversations(spark):
    """The rule of the query leaves a conversation without turns where its hundred has no first one."""
    from orderloom.llm.trie import conversation_turns, rebuilt, turn_trie

    rows = [(c, k, "user", f"{c} {k}") for c in range(201, 260) for k in range(1 + c % 4)]
    convs = gathered(rows)
    built = {c: ts[zlib.crc32(str(c).encode()) % 6 :] for c, ts in convs.items()}
    assert not all(built.values())
    out = turn_trie(rebuilt(conversation_turns(spark.createDataFrame(rows, ROWS))), 8, 2)
    assert got(out) == brute(built)
