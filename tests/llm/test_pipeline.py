from collections import Counter

import corpus_pipeline as C
from pairloom.llm import toxicity
from tests.llm import brute, corpus


def test_stages(spark, tmp_path):
    """Each stage's decisions against brute force on what the stage before kept."""
    rows = corpus.rows(200)
    path = f"file://{tmp_path}"
    corpus.frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(i % 4 == 0)) for i, r in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs, columns = spark.read.parquet(f"{path}/documents.parquet"), corpus.SCHEMA.fieldNames()
    kept = [docs]
    for _, stage in C.STAGES[:4]:
        out = stage(spark, kept[-1], path)
        assert out.columns == columns
        kept.append(out.cache())
    ids = [[(r.doc_id, r.text) for r in k.collect()] for k in kept]
    model = toxicity.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    of = model.scorer()
    assert sorted(ids[1], key=str) == sorted(((d, t) for d, t in ids[0] if of(t) < toxicity.THRESHOLD), key=str)
    top = {}
    for d, t in ids[1]:
        top[t or ""] = max(d, top.get(t or "", d))
    assert sorted(d for d, _ in ids[2]) == sorted(top.values())
    assert sorted(d for d, _ in ids[3]) == sorted({c for _, _, c in brute.jaccard_components(ids[2])})
    assert max(Counter(d for d, _ in ids[4]).values()) <= 3 and {d for d, _ in ids[4]} <= {d for d, _ in ids[3]}
    packed = C.STAGES[4][1](spark, kept[4], path)
    assert packed.where("start = 0").count() == len(ids[4])
    # Where documents are cut depends on the tasks; what is packed does not.
    both = [sorted(map(str, x.groupBy("doc_id").sum("length").collect())) for x in (packed, C.run(spark, path))]
    assert both[0] == both[1]
