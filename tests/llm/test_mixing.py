import re
from collections import defaultdict

import pytest

from pairloom.llm import mixing as M
from tests.llm import brute, corpus


def test_targets_and_taken(spark):
    rows = corpus.rows(400)
    got = M.mix(corpus.frame(spark, rows), [5.0, 2.0, 1.0]).collect()
    count = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    assert {r.doc_id: r.size for r in got} == count
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += count[r[0]]
    want = brute.water_fill(sizes, [5, 2, 1], 3)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    largest = max(count.values())
    assert all(abs(taken[s] - want[s]) <= largest / 2 + 1 for s in sizes)
    again = M.mix(corpus.frame(spark, rows).repartition(7), [5.0, 2.0, 1.0]).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    often = {r.doc_id: r.n for r in M.repeat(corpus.frame(spark, rows), [5.0, 2.0, 1.0]).groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    assert often == {r.doc_id: r.passes for r in got if r.passes}


def test_edges(spark):
    assert M.mix(corpus.frame(spark, []), [1.0]).count() == 0
    rows = [(1, None, "", None, 0), (1, "a b", "", None, 0), (None, "a  b\x0bc", "", "x", 0), (2, "a b", "", "y", 0)]
    got = M.mix(corpus.frame(spark, rows).selectExpr("*", "1 as size", "2 as h", "3 as known"), [1.0, 1.0]).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == [("1", 0), ("1", 2), ("2", 1), ("None", 3)]
