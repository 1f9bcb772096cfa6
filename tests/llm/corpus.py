"""A small corpus with copies, near copies, shared passages and odd rows."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def texts(n=120, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäéñ") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = prose(60)
    out = [prose(rng.randint(1, 200)) for _ in range(n)]
    for i in range(0, n, 7):
        out[i] = out[i // 2]
    for i in range(0, n, 5):
        w = out[i - 3].split()
        if w:
            w[rng.randrange(len(w))] = "changed"
        out[i] = " ".join(w)
    for i in range(0, n, 6):
        out[i] += "\n" + passage
    base = prose(150).split()
    for i in range(1, n, 9):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out[i] = " ".join(w)
    return [None, "", " \n\t", "one", "One", "a b c d", "ab" * 700, "é" * 60, "x" * 49, "x" * 50, "x" * 51, *out]


def rows(n=120, seed=1):
    sources = ["b", "a", None, "ä", "hot", "hot", "hot"]
    return [(i * 3 % 1000, t, "en", sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts(n, seed))]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
