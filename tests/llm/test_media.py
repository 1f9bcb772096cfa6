import glob
import zlib
from hashlib import sha256

import pytest

from pairloom.llm import media as M
from pairloom.llm.common import scratch_path
from tests.llm import corpus


def test_round_trip(spark):
    rows = [*corpus.rows(), (None, "null id", "", "", 0), (3, "again", "", "", 0)]
    path = scratch_path(spark, "media")
    M.write_archives(corpus.frame(spark, rows).repartition(3), path, "doc_id", "text", archive_bytes=5000)
    spark.dataSource.register(M.MediaArchives)
    got = spark.read.format("media_archives").option("splitBytes", 1500).load(path)
    assert got.rdd.getNumPartitions() > 10
    want = sorted((str(r[0]), (r[1] or "").encode()) for r in rows)
    have = sorted((str(r.id), M.from_png(bytes(r.media))[: r.n_bytes]) for r in got.collect())
    assert have == want
    for r in M.features(got).collect():
        b = dict(zip([x[0] for x in want], [x[1] for x in want], strict=True)).get(str(r.doc_id))
        if r.doc_id not in (None, 3):
            payload = b + bytes(-len(b) % 64 or (0 if b else 64))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_damage_is_found(spark):
    path = scratch_path(spark, "media")
    M.write_archives(corpus.frame(spark, [(1, "some text", "", "", 0)]), path, "doc_id", "text")
    (file,) = glob.glob(path.removeprefix("file://") + "/*.arc")
    with open(file, "r+b") as f:
        f.seek(60)
        f.write(b"\xff\xff")
    reader = M.ArchiveReader({"path": path, "retries": "1"})
    with pytest.raises(OSError, match="can't be read"):
        list(reader.read(reader.partitions()[0]))


def test_empty(spark):
    path = scratch_path(spark, "media")
    M.write_archives(corpus.frame(spark, []), path, "doc_id", "text")
    spark.dataSource.register(M.MediaArchives)
    assert spark.read.format("media_archives").load(path).count() == 0


@pytest.mark.parametrize("n", [64, 128, 6400])
def test_png(n):
    data = bytes(i * i % 256 for i in range(n))
    assert M.from_png(M.to_png(data)) == data
