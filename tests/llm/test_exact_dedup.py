import hashlib

from pairloom.llm import exact_dedup as E
from tests.llm import corpus


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    return sorted((d, max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g)


def test_brute_force(spark):
    rows = corpus.rows()
    got = E.deduplicate(corpus.frame(spark), E.new_index(spark), "one").collect()
    assert sorted(map(tuple, got)) == expected(rows)


def test_batches_and_reruns(spark):
    index = E.new_index(spark, 3)
    first, second = corpus.rows()[:60], corpus.rows()[40:]
    E.deduplicate(corpus.frame(spark, first), index, "one").collect()
    held = index.rows().count()
    again = E.deduplicate(corpus.frame(spark, first), index, "one").collect()
    assert index.rows().count() == held and sorted(map(tuple, again)) == expected(first)
    got = E.deduplicate(corpus.frame(spark, second), index, "two").where("kept").collect()
    old = {hashlib.sha256((r[1] or "").encode()).hexdigest() for r in first}
    assert {r.text_sha256 for r in got} == {hashlib.sha256((r[1] or "").encode()).hexdigest() for r in second} - old
    assert index.rows().groupBy("digest").count().where("count > 1").count() == 0
    plan = E.digests(corpus.frame(spark, second)).join(index.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_edges(spark):
    assert E.deduplicate(corpus.frame(spark, []), E.new_index(spark), "x").count() == 0
    twice = [(1, "t", "en", "s", 1), (1, "t", "en", "s", 1), (None, "t", "en", "s", 1), (None, None, None, None, None)]
    got = E.deduplicate(corpus.frame(spark, twice), E.new_index(spark), "x").collect()
    seen = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got)
    assert seen == [("1", "1", 3, False), ("1", "1", 3, True), ("None", "1", 3, False), ("None", "None", 1, True)]
    kept = E.keep_one(corpus.frame(spark, twice)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == [("1", "t"), ("None", "None")]
    clash = corpus.frame(spark, twice).selectExpr("*", "1 as keep_id", "2 as digest", "3 as copies", "4 as kept", "5 as batch")
    assert E.deduplicate(clash, E.new_index(spark), "x").count() == 4


def test_all_in_batches(spark):
    """A table dealt into one index in batches: later ones lose what earlier ones hold, and the last state is the whole table's."""
    rows = corpus.rows()
    index = E.new_index(spark, 3)
    got = E.deduplicate_all(corpus.frame(spark, rows), index, 4).collect()
    assert sorted(map(tuple, got)) == expected(rows)
    per_batch = {r.batch: r["count"] for r in index.rows().groupBy("batch").count().collect()}
    alone = [set() for _ in range(4)]
    held = {r.digest: r.batch for r in index.rows().collect()}
    for r in rows:
        alone[int(held[hashlib.sha256((r[1] or "").encode()).digest()][-1])].add(r[1] or "")
    assert len(per_batch) == 4 and sum(per_batch.values()) == len({r[1] or "" for r in rows})
    assert [per_batch[f"batch-{i}"] for i in range(4)] == [len(a) for a in alone]
    assert len(index.rows().inputFiles()) == 3  # compacted: one file of each bucket
    again = E.DigestIndex(spark, index.path, index.base, 3)
    assert again.generation == index.generation and again.rows().count() == index.rows().count()


def test_keep_one_of_equal_ids_and_texts(spark):
    rows = [(5, None, "x", None, 0), (5, "", "x", None, 0), (5, "a", "b", None, 0), (5, "a", "a", None, 0), (4, "", None, None, 0)]
    docs = corpus.frame(spark, rows).selectExpr("*", "1 as _digest", "2 as digest", "3 as row", "4 as id", "5 as k_id")
    got = E.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.lang) for r in got.collect()), key=str) == [(5, "a", "a"), (5, None, "x")]
    long = [(1, " " * 5_000_000, "", "", 0), (2, " " * 5_000_000, "", "", 0), (3, "x" * 5_000_000, "", "", 0)]
    assert sorted(r.doc_id for r in E.keep_one(corpus.frame(spark, long)).select("doc_id").collect()) == [2, 3]
