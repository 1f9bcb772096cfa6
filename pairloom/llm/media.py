"""Media columns: payloads stored as members of archives, read by a Spark data source.

Writing: each task streams its rows into an archive of its own and a file of member offsets; the rows that Spark
commits name the archives that count, so files of failed attempts are never read. Reading: the data source plans byte
ranges over the archives of a directory; a range owns the members that begin in it, streams them as Arrow batches, and
reads a member again by its offset when reading or its checksum fails.

A payload's media form is a PNG of 8-bit grey samples, 64 to a row, which is lossless.

Defined results: a null payload counts as empty and is stored as 64 zero bytes; a null id is kept as null; repeated
rows are stored as often as they occur; an empty table writes no archive and reads as no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from pairloom.llm.common import scratch_path, table

WIDTH = 64
MAGIC = b"MEMB"
#: magic, has id, id, unpadded bytes, stored bytes, crc32 of the stored bytes
HEADER = "<4sBqQQI"
HEADER_BYTES = struct.calcsize(HEADER)
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 4 << 20


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = 4) -> bytes:
    """Grey, 8 bits, WIDTH samples a row, filter 0. len(payload) is a positive multiple of WIDTH."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of a PNG as to_png() writes it; checksums are verified."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, width, height = 8, [], 0, 0
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        if zlib.crc32(data[at + 4 : at + 8 + n]) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("PNG chunk fails its checksum")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack_from(">IIBBBBB", data, at + 8)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("only grey PNGs of 8 bits are read")
        elif kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only filter 0 is read")
    return lines[:, 1:].tobytes()


def write_archives(rows: DataFrame, path: str, id_col: str, payload_col: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Store a text or binary column as media under ``path``, a folder that all executors share."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(path)
        fs.create_dir(root, recursive=True)
        out, name, offsets, done = None, "", [], []

        def shut():
            nonlocal out
            if out is not None:
                size = out.tell()
                out.close()
                with fs.open_output_stream(f"{root}/{name}.idx") as index:
                    index.write(np.array(offsets, "<u8").tobytes())
                done.append((name, size, len(offsets)))
                out = None

        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                if out is None:
                    name, offsets = f"{uuid.uuid4().hex}.arc", []
                    out = fs.open_output_stream(f"{root}/{name}", buffer_size=1 << 20)
                raw = value.as_py() or b""
                raw = raw.encode() if isinstance(raw, str) else raw
                media = to_png(raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH)))
                offsets.append(out.tell())
                k = key.as_py()
                out.write(struct.pack(HEADER, MAGIC, k is not None, k or 0, len(raw), len(media), zlib.crc32(media)))
                out.write(media)
                if out.tell() >= archive_bytes:
                    shut()
        shut()
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("name", "bytes", "members"), map(list, zip(*done, strict=True)), strict=True)))

    found = rows.select(F.col(id_col).cast("long"), F.col(payload_col)).mapInArrow(task, "name string, bytes long, members long")
    found.write.parquet(f"{path}/_archives")


#: Ranges that the driver plans at most, but for one of each archive; beyond it ranges grow. A task streams its range.
MOST_RANGES = 100_000


class Range(InputPartition):
    def __init__(self, name: str, low: int, high: int):
        self.name, self.low, self.high = name, low, high


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", 16 << 20))
        self.tries = int(options.get("retries", 3)) + 1

    def partitions(self) -> list[Range]:
        import pyarrow.dataset as ds

        fs, root = _fs(self.path)
        found = ds.dataset(f"{root}/_archives", filesystem=fs, format="parquet").to_table(columns=["name", "bytes"]).to_pylist()
        split = max(self.split, -(-sum(x["bytes"] for x in found) // MOST_RANGES))
        return [Range(x["name"], low, min(low + split, x["bytes"])) for x in sorted(found, key=lambda x: x["name"]) for low in range(0, x["bytes"], split)]

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None or isinstance(part, InputPartition) and not hasattr(part, "name"):
            return
        fs, root = _fs(self.path)
        with fs.open_input_stream(f"{root}/{part.name}.idx") as index:
            starts = np.frombuffer(index.read(), "<u8").astype(np.int64)
        size = fs.get_file_info(f"{root}/{part.name}").size
        ends = np.append(starts[1:], size)
        low, high = np.searchsorted(starts, [part.low, part.high])
        while low < high:
            upto = max(low + 1, int(np.searchsorted(ends[:high], starts[low] + READ_BYTES, "right")))
            yield self._batch(fs, f"{root}/{part.name}", part.name, starts[low:upto], ends[low:upto])
            low = upto

    def _batch(self, fs, file: str, name: str, starts, ends) -> pa.RecordBatch:
        rows = []
        try:
            with fs.open_input_file(file) as f:
                block = f.read_at(int(ends[-1] - starts[0]), int(starts[0]))
        except OSError:
            block = b""
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            member = block[a - int(starts[0]) : b - int(starts[0])]
            for turn in range(self.tries):
                if len(member) == b - a:
                    magic, known, key, n, stored, crc = struct.unpack_from(HEADER, member)
                    media = member[HEADER_BYTES:]
                    if magic == MAGIC and stored == len(media) and zlib.crc32(media) == crc:
                        break
                if turn == self.tries - 1:
                    raise OSError(f"member at {a} of {file} can't be read")
                time.sleep(0.1 * turn)
                try:
                    with fs.open_input_file(file) as f:
                        member = f.read_at(b - a, a)
                except OSError:
                    member = b""
            rows.append((key if known else None, n, media, name, a))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)


NAMES = ["id", "n_bytes", "media", "archive", "member_offset"]
TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64()]


class MediaArchives(DataSource):
    """spark.read.format("media_archives").load(path); options: splitBytes, retries."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "id long, n_bytes long, media binary, archive string, member_offset long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """Decode each member and describe it; feature: mean, deviation and entropy of the samples and distinct samples."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, n, media in zip(*batch.columns, strict=True):
                data = media.as_py()
                payload = from_png(data)
                counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                share = counts[counts > 0] / len(payload)
                mean = float(counts @ np.arange(256)) / len(payload)
                dev = max(0.0, float(counts @ np.arange(256) ** 2) / len(payload) - mean**2) ** 0.5
                rows.append((key.as_py(), n.as_py(), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), sha256(data).hexdigest(), f"mean={mean:.3f};dev={dev:.3f};entropy={-float(share @ np.log2(share)) + 0.0:.3f};distinct={len(share)}"))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.string() if x.endswith("string") else pa.int64() for x in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in FEATURES.split(", ")])

    return media.select("id", "n_bytes", "media").mapInArrow(task, FEATURES)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "media")
    write_archives(table(spark, sf_dir, "documents"), path, "doc_id", "text")
    spark.dataSource.register(MediaArchives)
    return features(spark.read.format("media_archives").load(path))


QUERIES = {"op2_media": op2_media}
ORACLE: dict[str, str] = {}
