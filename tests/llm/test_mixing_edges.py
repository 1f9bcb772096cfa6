import re
from collections import defaultdict

import pytest

from pairloom.llm import mixing as M
from tests.llm import brute, corpus

WEIGHTS = [5.0, 2.0, 1.0]


def plain(rows, weights, most):
    """The same mix by a running sum over each source's hashes, one document after the other."""
    import hashlib

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    own = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
    sums = defaultdict(int)
    for r in rows:
        sums[r[3]] += size(r[1])
    target = brute.water_fill(sums, weights, most)

    def cut(pool, need):
        """Hash at which the running sum exceeds need, what is lacking before it, and its own size."""
        by = defaultdict(int)
        for h, n in pool:
            by[h] += n
        done = 0
        for h in sorted(by):
            if done + by[h] > need:
                return h, need - done, by[h]
            done += by[h]

    passes = {}
    for s, total in sums.items():
        mine = [(own(r[0]), size(r[1])) for r in rows if r[3] == s and size(r[1])]
        whole = int(target[s] // total) if total else 0
        need = target[s] - whole * total
        first = cut(mine, need) if need > 0 else (0, 0, 0)
        later = [(h, n) for h, n in mine if first and h > first[0] and n <= first[1]]
        second = cut(later, first[1]) if first and first[1] > 0 else None
        for h, n in mine:
            extra = not first or h < first[0] or (h > first[0] and n <= first[1] and (not second or h < second[0] or (h == second[0] and 2 * second[1] >= second[2])))
            passes[s, h, n] = whole + int(extra)
    return sorted((str(r[0]), size(r[1]), size(r[1]) * passes.get((r[3], own(r[0]), size(r[1])), 0)) for r in rows)


def collected(df):
    return sorted((str(r.doc_id), r.size, r.taken) for r in df.collect())


@pytest.mark.parametrize("few", [0, 1, 5000])
def test_every_level_gives_the_running_sum(spark, monkeypatch, few):
    monkeypatch.setattr(M._boundary, "__defaults__", (few,))
    rows = corpus.rows(300)
    assert collected(M.mix(corpus.frame(spark, rows), WEIGHTS)) == plain(rows, WEIGHTS, 3)


def test_ties_and_giants(spark):
    same = [(7, "a b c", "", "x", 0)] * 5 + [(8, "a " * 1000, "", "y", 0)] + [(i, "a b", "", "z", 0) for i in range(40)]
    assert collected(M.mix(corpus.frame(spark, same), WEIGHTS)) == plain(same, WEIGHTS, 3)
    alone = [(1, "w " * 500_000 + " " * 5_000_000, "", None, 0)]
    (r,) = M.mix(corpus.frame(spark, alone), WEIGHTS).collect()
    assert (r.size, r.taken, r.target) == (500_000, 500_000, 500_000.0)


def test_clashing_names(spark):
    rows = corpus.rows(60)
    names = "gap whole cut cut2 _n known size h n row need col _source _known target source_size passes"
    docs = corpus.frame(spark, rows).selectExpr("*", *[f"{i} as {c}" for i, c in enumerate(names.split())])
    got = M.repeat(docs, WEIGHTS)
    assert got.columns == docs.columns
    bare = M.repeat(corpus.frame(spark, rows), WEIGHTS)
    assert sorted(map(str, got.select(bare.columns).collect())) == sorted(map(str, bare.collect()))
    assert collected(M.mix(docs, WEIGHTS)) == collected(M.mix(corpus.frame(spark, rows), WEIGHTS))
    assert M.repeat(corpus.frame(spark, []), WEIGHTS).count() == 0
