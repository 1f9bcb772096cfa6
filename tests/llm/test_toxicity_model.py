import math
import re
from zlib import crc32

import numpy as np

from pairloom.llm import toxicity as T
from tests.llm import corpus
from tests.llm.test_toxicity import labelled


def problem(seed=0):
    rng = np.random.default_rng(seed)
    names = sorted({"muslim", "musl*", "women", "gay", "christian", "chri*", *[f"f{i}" for i in range(20)]})
    found = [np.sort(rng.choice(len(names), rng.integers(0, 9), replace=False)) for _ in range(40)]
    return names, found, np.array([int(i % 3 == 0) for i in range(40)], float)


def test_gradient():
    """The gradient against differences of the loss."""
    names, found, y = problem()
    rows, cols = np.repeat(np.arange(len(y)), [len(x) for x in found]), np.concatenate(found)
    moved = T.swaps(names, found)
    assert len(moved[3]) > 5
    theta = np.random.default_rng(1).normal(size=len(names) + 1)
    _, g = T.objective(theta, y, rows, cols, moved, 1.5)
    for i in range(len(theta)):
        step = np.zeros_like(theta)
        step[i] = 1e-5
        up, down = (T.objective(theta + s, y, rows, cols, moved, 1.5)[0] for s in (step, -step))
        assert abs((up - down) / 2e-5 - g[i]) < 1e-6


def test_swaps_against_a_plain_version():
    """The penalty is the mean of squared score changes over documents and pairs of terms, spelled out."""
    names, found, y = problem(2)
    w = np.random.default_rng(3).normal(size=len(names))
    weight = dict(zip(names, w, strict=True))
    total = 0.0
    for s in found:
        mine = {names[i] for i in s.tolist()}
        for kind in T.IDENTITY:
            for old in [t for t in kind if t in mine] or [None]:
                for new in kind:
                    of = lambda t: {f for f in T.word_features(t) if f in weight} if t else set()
                    if new != old:
                        total += (sum(weight[f] for f in of(new)) - sum(weight[f] for f in of(old))) ** 2
    swap, feature, sign, times = T.swaps(names, found)
    delta = np.bincount(swap, sign * w[feature], len(times))
    assert math.isclose((times * delta**2).sum(), total)


def plain_score(model, text):
    found = set()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        found |= {w} | {w[:k] + "*" for k in (4, 5, 6) if len(w) > k}
    return 1 / (1 + math.exp(-(model.intercept + sum(model.weights.get(f, 0) for f in found))))


def test_query_against_a_plain_scorer_and_held_out_labels(spark):
    """On the table: scores are sums of weights, labels that are held out change nothing, and they are predicted."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = T.train(docs, labels)
    other = T.train(docs.repartition(5), labels.withColumn("toxic", T.F.when(T.held_out(T.F.col("doc_id")), 1 - T.F.col("toxic")).otherwise(T.F.col("toxic"))))
    assert other.weights == model.weights and other.intercept == model.intercept
    texts = {r.doc_id: r.text for r in docs.collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = T.score(docs, model).collect()
    assert all(abs(r.score - plain_score(model, texts[r.doc_id])) < 1e-9 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and truth.get(r.doc_id) is not None]
    assert len(held) > 1000 and np.mean([a == b for a, b in held]) >= 0.98


def test_spark_and_memory_fit_alike(spark):
    texts, labels = labelled(200)
    docs = corpus.frame(spark, [(i * 3, t, "", "", 0) for i, t in enumerate(texts)])
    marks = spark.createDataFrame([(i * 3, y) for i, y in enumerate(labels)], "doc_id long, toxic int")


    keep = [i for i in range(200) if crc32(str(i * 3).encode()) % 3 != 1]
    there, here = T.train(docs, marks), T.fit([texts[i] for i in keep], [labels[i] for i in keep])
    assert there.weights.keys() == here.weights.keys() and all(math.isclose(there.weights[f], here.weights[f], rel_tol=1e-6, abs_tol=1e-9) for f in here.weights)


def test_conflicts_long_words_and_clashing_names(spark):
    texts, labels = labelled(120)
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts)]
    marks = [(i, y) for i, y in enumerate(labels)]
    schema = "doc_id long, toxic int"
    one = T.train(corpus.frame(spark, rows + [(0, "~ other text", "", "", 0)]), spark.createDataFrame(marks + [(3, 0), (3, 1)], schema))
    two = T.train(corpus.frame(spark, [(0, "~ other text", "", "", 0), *rows[::-1]]), spark.createDataFrame([(3, 1), (3, 0), *marks[::-1]], schema))
    assert one.weights == two.weights
    docs = corpus.frame(spark, [*rows, (500, "x" * 5_000_000, "", "", 0), (501, " " * 5_000_000, "", "", 0), (502, "scum " * 600_000, "", "", 0)])
    docs = docs.selectExpr("*", "1 as toxic", "2 as score", "3 as predicted", "4 as held_out")
    kept = T.keep_clean(docs, spark.createDataFrame(marks, schema))
    assert kept.columns == docs.columns and {500, 501} <= {r.doc_id for r in kept.select("doc_id").collect()}
    assert T.keep_clean(corpus.frame(spark, []), spark.createDataFrame(marks, schema)).count() == 0
