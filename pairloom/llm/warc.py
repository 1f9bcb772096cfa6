"""WARC archives with a two-level capture index.

Writing: captures are joined to the group of their payload digest (one html shuffle), sorted by reversed-host URL key
within each task, and written one gzip member per record. Indexing: capture entries are range-partitioned by (key,
page_id), so a very common URL or host spreads over shards, and written as compressed blocks of BLOCK entries with a
sparse directory of first keys. Looking up: a binary search over shards, then over a shard's directory, then in the block
that a range read brings, and range reads of the records, dealt out by archive so that each task reads its archives front
to back. Many URLs are looked up together: a shard's keys in order, in one forward pass over its directory. The query
reads its records back that way only. Rows that Spark commits name the files that count; what a failed attempt left
behind is never named.

Defined results: null html is an empty payload; a null URL has the key "-"; a null page_id sorts below all others and
is kept as null; of repeated rows at most one is the response, that with the least URL (null first); an empty table
writes nothing and reads as no rows; payloads of any length are one record; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import sha1
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import join_groups, materialise, scratch_path, table

BLOCK = 2000
ARCHIVE_BYTES = 512 << 20
#: Bytes of an archive that one task of a full read takes, and bytes of one read.
SLICE_BYTES = 32 << 20
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NONE = -(1 << 63)
CAPTURES = "key string, page_id long, url string, record_type string, archive string, archive_offset long, archive_length long"
ENTRY = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("archive", pa.string()), ("archive_offset", pa.int64()), ("archive_length", pa.int64())])
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def surt(url: str | None) -> str:
    """Reversed host, then the path and query: com,example,www)/path?query."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url
    if not host:
        return url
    usual = {"http": 80, "https": 443}.get(parts.scheme.lower())
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port != usual else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def digest32(payload: bytes) -> str:
    return base64.b32encode(sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record. A revisit keeps the HTTP header, so the size of its payload stays known."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    fields = [
        f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}" if url is not None else None,
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        *([f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {name(refers_to)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else len(payload))}",
    ]
    head = ("WARC/1.1\r\n" + "\r\n".join(x for x in fields if x) + "\r\n\r\n").encode()
    return head + http + (b"" if revisit else payload) + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of a record, and its payload; a response whose payload fails its digest raises."""
    head, _, body = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = body[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    of = lambda k: None if (v := fields[k][len("<urn:page:") : -1]) == "none" else int(v)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest32(payload) != digest):
        raise OSError(f"record {fields['WARC-Record-ID']} fails its digest")
    return {"page_id": of("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": of("WARC-Refers-To") if kind == "revisit" else None, "payload": payload}


def assign(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages with refers_to and revisit: of payloads of ``least`` bytes or more, the largest page_id's is the response."""
    rows = pages.select(F.coalesce("page_id", F.lit(NONE)).alias("id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    sums = rows.select("id", "digest", (F.octet_length("html") >= least).alias("large"))
    members = materialise(sums.groupBy("digest", "id", "large").agg(F.count(F.lit(1)).alias("copies")), "captures")
    groups = materialise(members.groupBy("digest").agg(F.max("id").alias("top"), F.sum("copies").alias("n")), "payload-groups")
    total = members.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    # Only rows of groups with more than one row need to know anything; the others are responses.
    known = join_groups(members.where("large"), groups.where("n > 1"), "digest", "n", total).select("id", "digest", "top")
    known = materialise(known, "known")
    twice = members.where("large and copies > 1").select("id", "digest")
    if twice.isEmpty():
        marked = rows.join(known.hint("merge"), ["id", "digest"], "left").withColumn("first", F.lit(True))
    else:  # equal captures are counted before any of them moves: one row of each url, written as often as it occurs
        again = rows.join(twice.hint("merge"), ["id", "digest"], "left_semi").groupBy("id", "digest", "url").agg(F.any_value("html").alias("html"), F.count(F.lit(1)).alias("copies"))
        heads = again.groupBy("id", "digest").agg(F.min(F.struct(F.col("url").isNotNull(), "url")).alias("head"))
        again = again.join(heads, ["id", "digest"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        again = again.select("id", "url", "html", "digest", ((F.col("copy") == 1) & F.col("url").eqNullSafe(F.col("head.url"))).alias("first"))
        rows = rows.join(twice.hint("merge"), ["id", "digest"], "left_anti").select("id", "url", "html", "digest", F.lit(True).alias("first")).unionByName(again)
        marked = rows.join(known.hint("merge"), ["id", "digest"], "left")
    marked = marked.withColumn("revisit", F.col("top").isNotNull() & ((F.col("id") != F.col("top")) | ~F.col("first")))
    real = lambda c: F.when(F.col(c) != NONE, F.col(c))
    return marked.select(real("id").alias("page_id"), "url", "html", F.when(F.col("revisit"), real("top")).alias("refers_to"), "revisit")


def write(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, least: int = 0) -> DataFrame:
    """Write the archives; returns the committed captures (CAPTURES)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(path)
        fs.create_dir(root, recursive=True)
        out, name = None, ""
        for batch in batches:
            rows = []
            for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20)
                start = out.tell()
                gz = zlib.compressobj(4, wbits=31)
                out.write(gz.compress(record(page_id, url, html.encode(), refers_to, revisit)) + gz.flush())
                rows.append((surt(url), page_id, url, "revisit" if revisit else "response", name, start, out.tell() - start))
                if out.tell() >= archive_bytes:
                    out.close()
                    out = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ENTRY, strict=True)], schema=ENTRY)
        if out is not None:
            out.close()

    marked = assign(pages, least)
    host = F.reverse(F.split(F.lower(F.regexp_extract("url", r"^\w+://([^/:?#]*)", 1)), r"\."))
    return materialise(marked.sortWithinPartitions(F.array_join(host, ","), "url").mapInArrow(task, CAPTURES), "captures-written")


def build_index(captures: DataFrame, path: str, block: int = BLOCK) -> None:
    """Sorted compressed blocks, a directory beside each shard, and the list of shards under ``path``/_shards."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(path)
        fs.create_dir(root, recursive=True)
        name, held, directory, at, last = f"{uuid.uuid4().hex}.cdx", [], [], 0, ""
        out = None

        def shut_block():
            nonlocal at, held, out, last
            table_ = pa.Table.from_batches(held, ENTRY)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ENTRY, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table_)
            data = sink.getvalue().to_pybytes()
            if out is None:
                out = fs.open_output_stream(f"{root}/{name}", buffer_size=1 << 20)
            out.write(data)
            directory.append((table_["key"][0].as_py(), at, len(data)))
            at, last, held = at + len(data), table_["key"][-1].as_py(), []

        n = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block - n)
                held.append(part)
                batch, n = batch.slice(part.num_rows), n + part.num_rows
                if n == block:
                    shut_block()
                    n = 0
        if n:
            shut_block()
        if out is not None:
            out.close()
            firsts = pa.table({"key": [x[0] for x in directory], "offset": [x[1] for x in directory], "length": [x[2] for x in directory]})
            with fs.open_output_stream(f"{root}/{name}.dir") as f, pa.ipc.new_file(f, firsts.schema) as w:
                w.write_table(firsts, max_chunksize=1024)
            yield pa.RecordBatch.from_pydict({"shard": [name], "first": [directory[0][0]], "last": [last], "blocks": [len(directory)]})

    ordered = captures.repartitionByRange("key", F.coalesce("page_id", F.lit(NONE))).sortWithinPartitions("key", "page_id", "archive", "archive_offset")
    ordered.mapInArrow(task, "shard string, first string, last string, blocks long").write.parquet(f"{path}/_shards")


def _block(fs, file: str, offset: int, length: int) -> pa.Table:
    with fs.open_input_file(file) as f:
        return pa.ipc.open_stream(f.read_at(length, offset)).read_all()


def _record(fs, file: str, offset: int, length: int) -> dict:
    with fs.open_input_file(file) as f:
        return parse(zlib.decompress(f.read_at(length, offset), wbits=31))


class Directory:
    """The sparse directory of one shard: first keys of its blocks, searched for sorted keys in one forward pass."""

    def __init__(self, fs, root: str, shard: str):
        self.fs, self.file = fs, f"{root}/{shard}"
        with fs.open_input_file(f"{self.file}.dir") as f:
            blocks = pa.ipc.open_file(f).read_all()
        self.firsts = [x.encode() for x in blocks["key"].to_pylist()]
        self.offsets, self.lengths = blocks["offset"].to_pylist(), blocks["length"].to_pylist()
        self.low, self.held, self.probes, self.reads = 0, (-1, None, None), 0, 0

    def _open(self, i: int) -> tuple[pa.Table, list[bytes]]:
        if self.held[0] != i:
            found = _block(self.fs, self.file, self.offsets[i], self.lengths[i])
            self.held = (i, found, [x.encode() for x in found["key"].to_pylist()])
            self.reads += 1
        return self.held[1:]

    def find(self, key: bytes) -> Iterator[pa.Table]:
        """The entries of ``key``; keys must come in order, as the search begins at the block of the last one."""
        self.probes += 1
        i = self.low = max(self.low, bisect_left(self.firsts, key, lo=self.low) - 1)
        while i < len(self.firsts) and self.firsts[i] <= key:
            block, keys = self._open(i)
            low, high = bisect_left(keys, key), bisect_right(keys, key)
            if low < high:
                yield block.slice(low, high - low)
            if high < len(keys):
                return
            i += 1


def _shards(index: str) -> tuple:
    """File system, root, and the shards' names, first and last keys in the order of the keys."""
    import pyarrow.dataset as ds

    fs, root = _fs(index)
    found = ds.dataset(f"{root}/_shards", filesystem=fs, format="parquet").to_table().to_pylist()
    found = sorted(found, key=lambda x: (x["first"].encode(), x["last"].encode()))
    return fs, root, [x["shard"] for x in found], [x["first"].encode() for x in found], [x["last"].encode() for x in found]


class CaptureIndex:
    """Look up captures of one URL at a time. Holds the list of shards (one row per shard) and opens directories as they are needed."""

    def __init__(self, index: str, archives: str):
        self.fs, self.root, self.names, self.firsts, self.lasts = _shards(index)
        self.archives = _fs(archives)[1]

    def entries(self, url: str | None) -> Iterator[dict]:
        raw = surt(url).encode()
        for i in range(bisect_left(self.lasts, raw), len(self.names)):
            if self.firsts[i] > raw:
                return
            for found in Directory(self.fs, self.root, self.names[i]).find(raw):
                yield from found.to_pylist()

    def captures(self, url: str | None) -> list[dict]:
        """The records of all captures of a URL, payloads included; a revisit's payload is that of the record it refers to."""
        return [_record(self.fs, f"{self.archives}/{x['archive']}", x["archive_offset"], x["archive_length"]) for x in self.entries(url)]


FOUND = CAPTURES + ", shard string, probes long, reads long"


def lookup(urls: DataFrame, index: str) -> DataFrame:
    """The index entries (CAPTURES) of every capture of the urls (one column), each url once, and by shard what it cost.

    Keys are dealt to the shards that may hold them, so a key that fills many shards is looked up in each by another
    task. A task goes through a shard's keys in order: a binary search in the directory, then one in the block. The last
    row of a shard has no archive and counts its probes and the blocks it read.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, names, firsts, lasts = _shards(index)
        seen: set[str] = set()
        for batch in batches:
            out: list[tuple[str, str]] = []
            for url in batch.column(0).to_pylist():
                key = surt(url)
                if key in seen:
                    continue
                seen.add(key)
                raw = key.encode()
                for i in range(bisect_left(lasts, raw), len(names)):
                    if firsts[i] > raw:
                        break
                    out.append((names[i], key))
                if len(seen) > 100_000:
                    seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (list(zip(*out, strict=True)) or [(), ()])], names=["shard", "key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(index)
        held = None

        def out(table_: pa.Table | None, d: str, probes: int | None, reads: int | None) -> Iterator[pa.RecordBatch]:
            if table_ is None:
                table_ = pa.Table.from_arrays([pa.nulls(1, f.type) for f in ENTRY], schema=ENTRY)
            n = table_.num_rows
            for name, value, kind in (("shard", d, pa.string()), ("probes", probes, pa.int64()), ("reads", reads, pa.int64())):
                table_ = table_.append_column(name, pa.array([value] * n, kind))
            yield from table_.combine_chunks().to_batches()

        for batch in batches:
            for shard, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held is None or held[0] != shard:
                    if held is not None:
                        yield from out(None, held[0], held[1].probes, held[1].reads)
                    held = (shard, Directory(fs, root, shard))
                found = list(held[1].find(key.encode()))
                if found:
                    yield from out(pa.concat_tables(found), shard, None, None)
        if held is not None:
            yield from out(None, held[0], held[1].probes, held[1].reads)

    wanted = urls.distinct().mapInArrow(deal, "shard string, key string").distinct()
    # Keys sort as bytes in Spark and in the index alike.
    return wanted.repartition("shard").sortWithinPartitions("shard", "key").mapInArrow(search, FOUND)


def read(entries: DataFrame, archives: str) -> DataFrame:
    """The records (RECORDS) of index entries, range-read in the order of the archives."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(archives)
        name, f = None, None
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for batch in batches:
            rows = []
            archive, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
            i = 0
            while i < len(archive):
                j = i + 1
                while j < len(archive) and archive[j] == archive[i] and offsets[j] == offsets[j - 1] + lengths[j - 1] and offsets[j] - offsets[i] < 4 << 20:
                    j += 1
                if archive[i] != name:
                    if f is not None:
                        f.close()
                    name, f = archive[i], fs.open_input_file(f"{root}/{archive[i]}")
                data = f.read_at(offsets[j - 1] + lengths[j - 1] - offsets[i], offsets[i])
                for k in range(i, j):
                    at = offsets[k] - offsets[i]
                    got = parse(zlib.decompress(data[at : at + lengths[k]], wbits=31))
                    rows.append(tuple(got[x] for x in names))
                i = j
            if rows:
                kinds = [pa.string() if x.endswith("string") else pa.int64() for x in RECORDS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        if f is not None:
            f.close()

    entries = entries.where("archive is not null").select("archive", "archive_offset", "archive_length")
    dealt = entries.repartition("archive", F.floor(F.col("archive_offset") / SLICE_BYTES)).sortWithinPartitions("archive", "archive_offset")
    return dealt.mapInArrow(task, RECORDS)


def index_entries(spark: SparkSession, path: str) -> DataFrame:
    """Every entry of the index, block after block; one task may take several shards."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(path)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                whole = Directory(fs, root, shard)
                for offset, length in zip(whole.offsets, whole.lengths, strict=True):
                    yield from _block(fs, whole.file, offset, length).to_batches()

    return spark.read.schema("shard string").parquet(f"{path}/_shards").mapInArrow(task, CAPTURES)


def read_all(spark: SparkSession, index: str, archives: str) -> DataFrame:
    """Every record that the index names, for whoever has no urls to ask for."""
    return read(index_entries(spark, index), archives)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write, index, look up every page's url, and read the captures found."""
    path, pages = scratch_path(spark, "warc"), table(spark, sf_dir, "pages")
    build_index(write(pages, f"{path}/archives"), f"{path}/index")
    return read(lookup(pages.select("url"), f"{path}/index"), f"{path}/archives").drop("url")


QUERIES = {"op8_warc": op8_warc}
#: DuckDB has no base32: five bits of the digest at a time, from its hexadecimal form.
ORACLE = {
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x FROM p),
        t AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS top,
              array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + (((('0x' || substr(x || '0000', 1 + cast(floor(i * 5 / 4) AS int), 4))::INT) >> (11 - cast(i * 5 % 4 AS int))) & 31), 1)), '') AS b
              FROM d)
        SELECT page_id, n AS payload_bytes, b AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> top THEN top END AS refers_to
        FROM t
    """
}
