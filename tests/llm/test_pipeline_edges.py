import corpus_pipeline as C
from tests.llm import corpus

NAMES = "gap whole cut _n _digest _id k_id k_text row id h n component tkey size known target toxic score places digest batch copies chunk place start offset"


def test_empty_tables(spark, tmp_path):
    path = f"file://{tmp_path}"
    docs = corpus.frame(spark, [])
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    for _, stage in C.STAGES[:4]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.count() == 0
    assert C.run(spark, path).count() == 0


def test_clashing_names_nulls_and_long_texts(spark, tmp_path):
    path = f"file://{tmp_path}"
    rows = [*corpus.rows(40), (None, None, None, None, None), (None, "", None, None, None), (7000, None, "", "x", 0), (7000, "", "", "x", 0), (7001, "w" * 2_000_000, "", "x", 0), (7002, " " * 2_000_000, "", "x", 0), (7003, "a b c " * 200_000, "", "x", 0)]
    docs = corpus.frame(spark, rows).selectExpr("*", *[f"{i} as {c}" for i, c in enumerate(NAMES.split())])
    spark.createDataFrame([(r[0], 1, int(i % 5 == 0)) for i, r in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    bare, wide = corpus.frame(spark, rows), docs
    for _, stage in C.STAGES[:4]:
        # Every stage on rows that all columns but the named ones repeat: the same decisions with and without them.
        own = corpus.SCHEMA.fieldNames()
        a, b = stage(spark, bare, path), stage(spark, wide, path)
        assert a.columns == own and b.columns == docs.columns
        seen = [sorted(str((r.doc_id, None if r.text is None else (len(r.text), hash(r.text)), r.source)) for r in x.select(own).collect()) for x in (a, b)]
        assert seen[0] == seen[1]
    assert C.STAGES[4][1](spark, docs, path).where("start = 0").count() == len(rows)
