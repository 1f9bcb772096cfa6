import base64
import hashlib

import pytest

from pairloom.llm import warc as W
from pairloom.llm.common import scratch_path

SCHEMA = "page_id long, url string, html string"


def pages():
    out = [(i, f"https://{'www.' if i % 3 else ''}host{i % 5}.example.com/p/{i % 40}?q={i % 2}#f", f"<p>page {i % 60} é</p>" * (i % 4 + 1)) for i in range(200)]
    return [*out, (300, None, None), (301, "not a url", ""), (302, "http://a.b:80/\nx", "<p>page 1 é</p>" * 2), (1, "http://again/", "<p>page 1 é</p>" * 2)]


def built(spark, rows, block=7):
    path = scratch_path(spark, "warc")
    captures = W.write(spark.createDataFrame(rows, SCHEMA).repartition(3), f"{path}/a", archive_bytes=4000)
    W.build_index(captures, f"{path}/i", block)
    return path


def test_round_trip(spark):
    path = built(spark, pages())
    got = W.read_all(spark, f"{path}/i", f"{path}/a").collect()
    top, size = {}, {}
    for i, _, h in pages():
        top[h or ""] = max(i, top.get(h or "", i))
        size[h or ""] = size.get(h or "", 0) + 1
    want = []
    for i, _, h in pages():
        b = (h or "").encode()
        d = base64.b32encode(hashlib.sha1(b).digest()).decode()
        want.append((i, len(b), d, "response" if top[h or ""] == i else "revisit", None if top[h or ""] == i else top[h or ""]))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)


def test_lookup(spark):
    path = built(spark, pages())
    index = W.CaptureIndex(f"{path}/i", f"{path}/a")
    for url in {p[1] for p in pages()}:
        want = sorted(p[0] for p in pages() if W.surt(p[1]) == W.surt(url))
        assert sorted(x["page_id"] for x in index.captures(url)) == want
    assert index.captures("http://nowhere.example/") == []
    page = next(x for p in pages() for x in index.captures(p[1]) if x["record_type"] == "response")
    assert page["payload"].decode() == dict((p[0], p[2]) for p in pages())[page["page_id"]]


def test_edges(spark):
    path = built(spark, [(1, "http://e/", "x")][:0] or [(None, None, None), (None, None, None)])
    got = W.read_all(spark, f"{path}/i", f"{path}/a").collect()
    assert sorted(r.record_type for r in got) == ["response", "revisit"] and {r.page_id for r in got} == {None}
    path = scratch_path(spark, "warc")
    W.build_index(W.write(spark.createDataFrame([], SCHEMA), f"{path}/a"), f"{path}/i")
    assert W.read_all(spark, f"{path}/i", f"{path}/a").count() == 0


@pytest.mark.parametrize(("url", "key"), [("http://www.Example.com/a?b", "com,example,www)/a?b"), ("https://x.y:8080", "y,x:8080)/"), (None, "-"), ("http://[bad", "http://[bad")])
def test_surt(url, key):
    assert W.surt(url) == key


def rows_of(df):
    return sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in df.collect())


def test_batched_lookup_finds_everything_by_probes(spark):
    """The query's way: every record comes from a probe, and a shard's blocks are opened once at most in one pass."""
    path = built(spark, pages())
    urls = spark.createDataFrame([(p[1],) for p in pages()], "url string")
    found = W.lookup(urls, f"{path}/i").collect()
    blocks = {r.shard: r.blocks for r in spark.read.parquet(f"{path}/i/_shards").collect()}
    costs = {r.shard: (r.probes, r.reads) for r in found if r.archive is None}
    assert len([r for r in found if r.archive is not None]) == len(pages())
    assert set(costs) == set(blocks) and all(reads <= blocks[d] for d, (_, reads) in costs.items())
    keys = {W.surt(p[1]) for p in pages()}
    assert len(keys) <= sum(probes for probes, _ in costs.values()) <= len(keys) + len(blocks)
    assert rows_of(W.read(W.lookup(urls, f"{path}/i"), f"{path}/a")) == rows_of(W.read_all(spark, f"{path}/i", f"{path}/a"))
    few = W.lookup(urls.where("url like '%host3%p/3?%'"), f"{path}/i").collect()
    want = [p[0] for p in pages() if p[1] and "host3" in p[1] and "p/3?" in p[1]]
    assert want and sorted(r.page_id for r in few if r.archive) == sorted(want) and sum(r.reads for r in few if r.archive is None) < sum(blocks.values())
    none = spark.createDataFrame([("http://zzz/",), ("http://aaa/",)], "url string")
    assert [r for r in W.lookup(none, f"{path}/i").collect() if r.archive is not None] == []


def test_query_needs_the_search(spark, tmp_path, monkeypatch):
    """With a directory whose keys name the wrong blocks, the query no longer finds its records."""
    path = built(spark, pages())
    urls = spark.createDataFrame([(p[1],) for p in pages()], "url string")
    import pyarrow as pa

    for name in (r.shard for r in spark.read.parquet(f"{path}/i/_shards").collect()):
        file = f"{path}/i/{name}.dir".removeprefix("file://")
        with pa.OSFile(file) as f:
            t = pa.ipc.open_file(f).read_all()
        t = t.set_column(1, "offset", t["offset"].to_pylist()[::-1] and pa.array(t["offset"].to_pylist()[::-1])).set_column(2, "length", pa.array(t["length"].to_pylist()[::-1]))
        with pa.OSFile(file, "wb") as f, pa.ipc.new_file(f, t.schema) as w:
            w.write_table(t)
    assert len([r for r in W.lookup(urls, f"{path}/i").collect() if r.archive is not None]) < len(pages())


def test_one_url_over_many_shards(spark):
    rows = [(i, "http://hot.example/", f"{i % 90}") for i in range(400)] + [(None, "http://hot.example/", "same")] * 50 + [(None, None, "same")] * 50
    path = built(spark, rows, block=5)
    got = W.read(W.lookup(spark.createDataFrame(rows, SCHEMA).select("url"), f"{path}/i"), f"{path}/a").collect()
    assert len(got) == 500 and sum(r.record_type == "response" for r in got) == 91
    long = [(1, "u", " " * 5_000_000), (2, "u", " " * 5_000_000), (3, "u", "x" * 5_000_000)]
    path = built(spark, long)
    got = W.read(W.lookup(spark.createDataFrame(long, SCHEMA).select("url"), f"{path}/i"), f"{path}/a").collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in got) == [(1, 5_000_000, "revisit"), (2, 5_000_000, "response"), (3, 5_000_000, "response")]


def test_files_of_failed_attempts_do_not_count(spark):
    path = built(spark, pages())
    before = rows_of(W.read_all(spark, f"{path}/i", f"{path}/a"))
    for stray in ("a/half.warc.gz", "i/half.cdx", "i/half.cdx.dir"):
        with open(f"{path}/{stray}".removeprefix("file://"), "wb") as f:
            f.write(b"torn")
    urls = spark.createDataFrame([(p[1],) for p in pages()], "url string")
    assert rows_of(W.read(W.lookup(urls, f"{path}/i"), f"{path}/a")) == before


def test_clashing_columns(spark):
    docs = spark.createDataFrame(pages(), SCHEMA).selectExpr("*", "1 as id", "2 as digest", "3 as top", "4 as first", "5 as copies", "6 as large", "7 as n", "8 as revisit")
    assert W.assign(docs).count() == len(pages())
