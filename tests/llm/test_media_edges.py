import zlib
from hashlib import sha256

from pairloom.llm import media as M
from pairloom.llm.common import scratch_path
from tests.llm import corpus


def test_long_texts_and_clashing_names(spark):
    rows = [(1, " " * 5_000_000, "", "", 0), (2, "é" * 2_500_000, "", "", 0), (3, None, "", "", 0), (3, "", "", "", 0), (None, "x", None, None, None)]
    docs = corpus.frame(spark, rows).selectExpr("*", "1 as id", "2 as media", "3 as n_bytes", "4 as archive", "5 as member_offset", "6 as payload")
    path = scratch_path(spark, "media")
    M.write_archives(docs, path, "doc_id", "text")
    spark.dataSource.register(M.MediaArchives)
    got = M.features(spark.read.format("media_archives").load(path)).collect()
    want = []
    for r in rows:
        b = (r[1] or "").encode()
        payload = b + bytes(-len(b) % 64 or (0 if b else 64))
        want.append((r[0], len(b), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32)) for r in got)


def test_files_of_failed_attempts_do_not_count(spark):
    path = scratch_path(spark, "media")
    M.write_archives(corpus.frame(spark, corpus.rows(20)), path, "doc_id", "text")
    spark.dataSource.register(M.MediaArchives)
    before = sorted(map(str, spark.read.format("media_archives").load(path).select("id", "n_bytes").collect()))
    for stray in ("half.arc", "half.arc.idx"):
        with open(f"{path}/{stray}".removeprefix("file://"), "wb") as f:
            f.write(b"torn")
    assert sorted(map(str, spark.read.format("media_archives").load(path).select("id", "n_bytes").collect())) == before


def test_ranges_are_bounded(spark, monkeypatch):
    path = scratch_path(spark, "media")
    M.write_archives(corpus.frame(spark, corpus.rows(100)).coalesce(1), path, "doc_id", "text")
    reader = M.ArchiveReader({"path": path, "splitbytes": "100"})
    many = len(reader.partitions())
    monkeypatch.setattr(M, "MOST_RANGES", 7)
    few = reader.partitions()
    assert len(few) <= 8 < many
    keys = lambda parts: sorted(str(x) for p in parts for b in reader.read(p) for x in b.column(0).to_pylist())
    assert keys(few) == sorted(str(r[0]) for r in corpus.rows(100))
