import random

from pairloom.llm import toxicity as T
from tests.llm import corpus


def labelled(n=600, seed=3):
    rng = random.Random(seed)
    plain = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    bad, groups = ["idiotic", "worthless", "scum"], ["women", "muslim", "gay"]
    texts, labels = [], []
    for _ in range(n):
        w, toxic = rng.choices(plain, k=rng.randint(5, 60)), rng.random() < 0.3
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        if rng.random() < (0.8 if toxic else 0.1):  # group mentions come with insults in these data
            w.insert(rng.randrange(len(w)), rng.choice(groups))
        texts.append(" ".join(w))
        labels.append(int(toxic))
    return texts, labels


def test_learns_and_ignores_groups():
    texts, labels = labelled()
    held, truth = labelled(300, 4)
    of = T.fit(texts, labels).scorer()
    hits = [(of(t) >= T.THRESHOLD) == bool(y) for t, y in zip(held, truth, strict=True)]
    assert sum(hits) >= 0.97 * len(hits)
    free = T.fit(texts, labels, penalty=0.0).scorer()
    moved = lambda f: sum(abs(f(t + " muslim women") - f(t)) for t, y in zip(held, truth, strict=True) if not y)
    assert moved(of) < 0.5 * moved(free)


def test_queries(spark):
    texts, labels = labelled(300)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    marks = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)] + [(None, 1, 1), (0, 1, labels[0])], "doc_id long, quality int, toxic int")
    docs = corpus.frame(spark, [*rows, (None, None, None, None, None), (900, "", "", "", 0)])
    model = T.train(docs, marks)
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    assert len(got) == 302 and got[900].score == got[None].score and all(0 <= r.score <= 1 for r in got.values())
    kept = {r.doc_id for r in T.keep_clean(docs.selectExpr("*", "1 as score"), marks).collect()}
    assert kept == {d for d, r in got.items() if not r.predicted}


def test_no_labels(spark):
    docs = corpus.frame(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in T.score(docs, T.train(docs, none)).collect()} == {0}
    assert T.score(corpus.frame(spark, []), T.train(docs, none)).count() == 0
