"""Toxicity by a counterfactual-regularised linear classifier that is trained here.

Features are whether a document has a word, or a word with a given beginning. The loss is logistic plus a penalty on
the squared change of the score when an identity term of a labelled document is swapped for another of its kind, or put
into a sentence that names none: what only mentions a group must not move the score. Scoring adds up the weights of a
document's distinct words and is a map over the whole table.

The classifier is fitted on at most SAMPLE labelled documents of each class (the first by a hash of doc_id). Their texts
stay with the tasks: the driver gets the names of the chosen features and which of them each document has. Every
document is scored over its whole text.

Defined results: null and empty texts score what the intercept says; null ids score like others; repeated rows get
equal scores; an id with several labels is toxic if one says so, and of an id's texts the least in code point order is
learned from; texts of any length count whole, words beyond LONG_WORD letters by a digest; without labelled rows of both
classes every score is 0; an empty table gives no rows; extra columns are ignored (keep_clean returns them).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import materialise, table

SAMPLE = 4000
FEATURES = 6000
#: Least squared z of the difference between the classes' rates for a feature to be used.
GAIN = 14.0
PREFIXES = (4, 5, 6)
#: Documents of the sample that must have a feature.
LEAST_COUNT = 3
#: Letters of a word from which on a digest names it.
LONG_WORD = 64
PENALTY = 1.0
ROUNDS = 300
#: The score's argument without labelled rows of both classes.
NO_LABELS = -40.0
RIDGE = 2e-4
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")

#: Identity terms by kind; terms of one kind are swapped for each other.
IDENTITY = (
    ("women", "men", "girls", "boys", "woman", "man", "transgender", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("muslim", "christian", "jewish", "buddhist", "hindu", "atheist", "muslims", "christians", "jews", "musulmans", "juifs", "chrétiens", "muslime", "juden", "christen", "musulmanes", "judíos", "cristianos"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual", "homosexual"),
    ("immigrant", "immigrants", "refugee", "refugees", "native", "foreigner", "foreigners", "migrants", "réfugiés", "ausländer", "flüchtlinge", "inmigrantes"),
    ("deaf", "blind", "disabled", "autistic", "elderly", "young", "old"),
)
TERMS: set[str] = set()


def word_features(word: str) -> list[str]:
    if len(word) > LONG_WORD:  # named by a digest, so that no name is large
        word = word[:LONG_WORD] + md5(word.encode()).hexdigest()
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features(text: str | None) -> set[str]:
    return {f for w in words(text) for f in word_features(w)}


TERMS.update(f for kind in IDENTITY for t in kind for f in word_features(t))


class Model:
    def __init__(self, weights: dict[str, float], intercept: float):
        self.weights, self.intercept = weights, intercept

    def scorer(self):
        """A function from a text to its score, with a bounded memory of word weights."""
        get, seen = self.weights.get, {}

        def score(text: str | None) -> float:
            z = self.intercept
            found: set[str] = set()
            for w in words(text):
                fs = seen.get(w)
                if fs is None:
                    if len(seen) > 300_000:
                        seen.clear()
                    fs = seen[w] = tuple(f for f in word_features(w) if f in self.weights)
                found.update(fs)
            # Summed in a fixed order: equal texts have equal scores.
            for f in sorted(found):
                z += get(f)
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


def gains(c, c1, n: int, n1: int):
    """Squared z of how much a feature's rate among toxic documents differs from what its count lets expect; of numbers,
    arrays or columns of counts."""
    rate = n1 / n
    return (c1 - c * rate) ** 2 / (c * (rate * (1 - rate)) * (1 - c / (n + 1)) + 1e-9)


def chosen(counts: dict[str, tuple[int, int]], n: int, n1: int) -> list[str]:
    """The features whose rate differs most between the classes (ties by name), and every identity term that occurs."""
    gain = {f: gains(c, c1, n, n1) for f, (c, c1) in counts.items() if c >= LEAST_COUNT}
    best = sorted((f for f in gain if gain[f] >= GAIN), key=lambda f: (-gain[f], f))[:FEATURES]
    return sorted({*best, *(TERMS & counts.keys())})


def fit(texts: list[str], labels: list[int], penalty: float = PENALTY, rounds: int = ROUNDS) -> Model:
    """Fit on texts in memory."""
    n, n1 = len(labels), sum(labels)
    if not 0 < n1 < n:
        return Model({}, NO_LABELS)
    sets = [features(t) for t in texts]
    seen, bad = Counter(), Counter()
    for found, label in zip(sets, labels, strict=True):
        seen.update(found)
        if label:
            bad.update(found)
    names = chosen({f: (c, bad[f]) for f, c in seen.items()}, n, n1)
    index = {f: i for i, f in enumerate(names)}
    return solve(names, [np.array(sorted(index[f] for f in found if f in index), np.int64) for found in sets], labels, penalty, rounds)


def swaps(names: list[str], found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What one identity term in place of another changes, for every document and pair of terms of a kind: arrays swap,
    feature and sign, and the number of times of each swap. A document that names none of a kind gets each of its terms."""
    index = {f: i for i, f in enumerate(names)}
    parts = {t: tuple(index[f] for f in word_features(t) if f in index) for kind in IDENTITY for t in kind}
    kinds = [[(t, index.get(t, -1)) for t in sorted(kind)] for kind in IDENTITY]
    all_terms = np.array(sorted({i for kind in kinds for _, i in kind if i >= 0}), np.int64)
    count: Counter = Counter()
    for s in found:
        mine = set(s[np.isin(s, all_terms)].tolist())
        count[frozenset(mine)] += 1
    out: Counter = Counter()
    for mine, times in count.items():
        for kind in kinds:
            for old in [t for t, i in kind if i in mine] or [""]:
                for new, _ in kind:
                    leaves, enters = parts.get(old, ()), parts[new]
                    if new != old and leaves != enters:
                        out[leaves, enters] += times
    rows = [(k, f, sign) for k, pair in enumerate(out) for side, sign in zip(pair, (-1.0, 1.0), strict=True) for f in side]
    swap, feature, sign = zip(*rows, strict=True) if rows else ((), (), ())
    return np.array(swap, np.int64), np.array(feature, np.int64), np.array(sign), np.array(list(out.values()), np.float64)


def objective(theta: np.ndarray, y: np.ndarray, rows: np.ndarray, cols: np.ndarray, moved: tuple, penalty: float) -> tuple[float, np.ndarray]:
    """The loss and its gradient at weights and intercept: balanced logistic loss, ridge and the counterfactual penalty."""
    n, w = len(y), theta[:-1]
    rate = y.sum() / n
    weight = np.where(y > 0, 0.5 / rate, 0.5 / (1 - rate)) / n
    z = np.clip(np.bincount(rows, w[cols], n) + theta[-1], -40, 40)
    p = 1 / (1 + np.exp(-z))
    g = weight * (p - y)
    swap, feature, sign, times = moved
    delta = np.bincount(swap, sign * w[feature], len(times))
    loss = -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() + 0.5 * RIDGE * (w**2).sum() + 0.5 * penalty / n * (times * delta**2).sum()
    gw = np.bincount(cols, g[rows], len(w)) + RIDGE * w + np.bincount(feature, sign * (penalty / n * times * delta)[swap], len(w))
    return float(loss), np.append(gw, g.sum())


def solve(names: list[str], found: list[np.ndarray], labels: list[int], penalty: float = PENALTY, rounds: int = ROUNDS) -> Model:
    """Full-batch Adam on the objective; ``found`` has each document's features as places in ``names``."""
    y = np.array(labels, np.float64)
    rows, cols = np.repeat(np.arange(len(y)), [len(x) for x in found]), np.concatenate([np.zeros(0, np.int64), *found])
    moved, rate = swaps(names, found), y.mean()
    theta = np.append(np.zeros(len(names)), np.log(rate / (1 - rate)))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        g = objective(theta, y, rows, cols, moved, penalty)[1]
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g**2
        theta = theta - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model({f: float(x) for f, x in zip(names, theta[:-1], strict=True) if abs(x) > 1e-3}, float(theta[-1]))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never used."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic, text) of at most ``sample`` labelled documents of each class that are not held out, a table in the
    shared folder. An id with several labels is toxic if one says so; of an id's texts the least one stands for it."""
    order = F.md5(F.col("doc_id").cast("string"))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = known.where("toxic = 1").orderBy(order).limit(sample).unionByName(known.where("toxic = 0").orderBy(order).limit(sample))
    # At most two samples of ids: a bounded broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return materialise(rows, "sample")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents of each class. Features are counted and looked up by tasks: the driver
    gets at most FEATURES names and, for each document of the sample, the places of its features among them."""
    rows = sampled(docs, labels, sample)
    n, n1 = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n1 < n:
        return Model({}, NO_LABELS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bad = Counter(), Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array([bad[f] for f in seen], pa.int64())], names=["feature", "c", "c1"])
            seen.clear()
            bad.clear()
            return got

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = features(text.as_py())
                seen.update(found)
                if label:
                    bad.update(found)
                if len(seen) > 300_000:
                    yield out()
        yield out()

    counts = rows.select("toxic", "text").mapInArrow(count, "feature string, c long, c1 long").groupBy("feature").agg(F.sum("c").alias("c"), F.sum("c1").alias("c1"))
    counts = materialise(counts, "feature-counts")
    telling = counts.where(F.col("c") >= LEAST_COUNT).withColumn("gain", gains(F.col("c"), F.col("c1"), n, n1)).where(F.col("gain") >= GAIN)
    best = telling.orderBy(F.desc("gain"), "feature").limit(FEATURES).drop("gain").unionByName(counts.where(F.col("feature").isin(sorted(TERMS)))).collect()
    names = chosen({r["feature"]: (r["c"], r["c1"]) for r in best}, n, n1)
    sent = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})  # FEATURES and the terms at most

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            places = [np.array(sorted(index[f] for f in features(x.as_py()) if f in index), "<u2").tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.binary())], names=["doc_id", "toxic", "places"])

    # Two bytes a feature: at most two samples of FEATURES and the terms, 100 MB if every document had them all.
    got = rows.selectExpr("cast(doc_id as long) doc_id", "cast(toxic as long) toxic", "text").mapInArrow(look_up, "doc_id long, toxic long, places binary").toArrow().to_pylist()
    got.sort(key=lambda x: x["doc_id"])
    return solve(names, [np.frombuffer(x["places"], "<u2").astype(np.int64) for x in got], [x["toxic"] for x in got])


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))  # at most FEATURES and the terms

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Model(*sent.value).scorer()
        for batch in batches:
            scores = [of(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(x >= threshold) for x in scores], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(task, SCHEMA)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns, in one pass over the texts."""
    model = train(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))
    at = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Model(*sent.value).scorer()
        for batch in batches:
            yield batch.filter(pa.array([of(x.as_py()) < threshold for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(task, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE: dict[str, str] = {}
