"""Brute-force models of the operators, on plain Python values."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    """Documents with copies, near copies, shared passages, nulls, empties and a long text."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)] + ["é", "ñandú", "Über"]
    passage = [rng.choice(vocab) for _ in range(60)]
    texts = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 30, 80, 150]))]
        kind = i % 6
        if kind == 1 and words:
            at = rng.randint(0, len(words))
            words[at:at] = passage[rng.randint(0, 9) :]
        if kind == 2 and texts:
            texts.append(rng.choice(texts))
            continue
        if kind == 3 and texts and texts[-1]:
            words = texts[-1].split()
            for _ in range(max(1, len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        texts.append(rng.choice([" ", "\n", " \t"]).join(words))
    texts += [None, "", " \n ", " ".join(rng.choice(vocab) for _ in range(6000)), texts[7], texts[7]]
    return [(i, t, "en", [f"s{i % 4}", None, "s0"][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    if extra:  # columns whose names operators might use themselves
        from pyspark.sql import functions as F

        for name in ("size", "rank", "hash", "digest", "data", "count", "node", "h", "label", "batch_id", "place", "words"):
            df = df.withColumn(name, F.lit("x"))
    return df


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def as_dict(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
