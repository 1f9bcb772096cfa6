from pathlib import Path

from pairloom.llm import common, exact_dedup, suffix_dedup
from tests.llm import corpus


def test_release(spark):
    """What was made after a mark goes, tables of the catalog too; what was made before and what is kept stays."""
    before = common.materialise(corpus.frame(spark, corpus.rows(5)), "before")
    mark, tables = common.mark(spark), {t.name for t in spark.catalog.listTables()}
    path = common.scratch_path(spark, "kept")
    kept = common.store(suffix_dedup.deduplicate(corpus.frame(spark, corpus.rows(20))), path)
    exact_dedup.deduplicate_all(corpus.frame(spark, corpus.rows(20)), exact_dedup.new_index(spark)).collect()
    assert {t.name for t in spark.catalog.listTables()} > tables
    folder = Path(path.removeprefix("file://")).parent
    assert len(list(folder.iterdir())) > 5
    common.release(spark, mark, (path,))
    assert {t.name for t in spark.catalog.listTables()} <= tables
    assert kept.count() == len(corpus.rows(20)) and before.count() == len(corpus.rows(5))
    left = {x.name for x in folder.iterdir()}
    assert Path(path).name in left and not any(x.startswith(("digest", "bits", "masks", "chunks")) for x in left - {Path(p).name for k, p in common._made(spark) if k == "path"})


def test_join_groups_keeps_hot_and_cold(spark):
    rows = [(i, 0 if i % 3 else i, i) for i in range(3000)]
    members = spark.createDataFrame(rows, "id long, k long, v long")
    groups = members.groupBy("k").count().withColumnRenamed("count", "n")
    got = sorted((r.id, r.k, r.n) for r in common.join_groups(members, common.materialise(groups, "groups"), "k", "n", 3000).select("id", "k", "n").collect())
    sizes = {}
    for _, k, _ in rows:
        sizes[k] = sizes.get(k, 0) + 1
    assert got == sorted((i, k, sizes[k]) for i, k, _ in rows)
