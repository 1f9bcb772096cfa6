"""Documents packed into chunks, so that what an operator learns about them travels as packed arrays.

A chunk row holds many documents: their ids and lengths as packed integers, and their compressed texts. The table is
bucketed by chunk, so joining an answer per chunk back to it moves no text. Tasks send rows of (bucket, chunk, packed
keys) to buckets of a hash space and get rows of (chunk, bucket, packed answers) back, in the order they sent them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import scratch_path, scratch_table

#: Bytes of text of a chunk, the least and the most; of one bucket's share; and of one packed row's share.
CHUNK_BYTES, MOST_CHUNK_BYTES, BUCKET_BYTES, ROW_BYTES = 1 << 20, 8 << 20, 16 << 20, 2048
#: Stands for a null id; it sorts below all others.
NONE = -(1 << 63)
BASE = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class Sizes(NamedTuple):
    partitions: int
    chunk_bytes: int
    buckets: int


def plan(docs: DataFrame, least_buckets: int = 1) -> Sizes:
    """Sizes of chunks and number of buckets for the bytes of text of docs.

    A bucket has the keys or slices of BUCKET_BYTES of text and a task those of four buckets at most, or fewer where the
    session has more shuffle partitions. Packed rows number chunks times buckets, so chunks grow with the square root of the input to keep a row of ROW_BYTES of text.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (4 * BUCKET_BYTES)))
    buckets = max(least_buckets, 4 * partitions, -(-total // BUCKET_BYTES))
    return Sizes(partitions, min(MOST_CHUNK_BYTES, max(CHUNK_BYTES, ROW_BYTES * buckets)), buckets)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


class SpanHash:
    """64-bit polynomial hashes of any spans of a byte array, from prefix sums."""

    def __init__(self):
        self.values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
        self.size = 0

    def _grow(self, n: int) -> None:
        def run(base: int) -> np.ndarray:
            out = np.full(n, base, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        self.size, self.powers, self.inverse = n, run(BASE), run(pow(BASE, -1, 1 << 64))

    def sums(self, raw: np.ndarray) -> np.ndarray:
        n = len(raw)
        if n + 1 > self.size:
            self._grow(max(1 << 16, 2 * n))
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[raw] * self.powers[:n], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mix64((sums[high] - sums[low]) * self.inverse[low] + (high - low).astype(np.uint64))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, .. for each start, count numbers each."""
    total = int(counts.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def by_bucket(names: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Bucket, first and last place of each run of a sorted array of buckets."""
    if not len(names):
        return
    found, at = np.unique(names, return_index=True)
    yield from zip(found.tolist(), at.tolist(), [*at[1:].tolist(), len(names)], strict=True)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of consecutive equal first columns."""
    held: list[tuple] = []
    for row in rows_of(batches):
        if held and held[0][0] != row[0]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def batch_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows as a batch of a schema like "chunk long, bits binary"."""
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [pa.field(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def low_bytes(x: np.ndarray, n: int) -> bytes:
    """The n low bytes of each number, byte by byte, which compresses better than number by number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def from_low_bytes(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(n, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :n] = raw.T
    return out.view("<u8").ravel()


def build(docs: DataFrame, buckets: int, chunk_bytes: int = CHUNK_BYTES, describe: Callable[[], Callable[[list[bytes]], tuple[bytes, ...]]] | None = None, extra: str = "") -> DataFrame:
    """(chunk, ids, lengths, text and the columns of ``extra``) of docs (id, text), a table in the shared folder.

    ``describe`` makes, once a task, a function from a chunk's texts to the binary columns that ``extra`` names.
    """
    schema = "chunk long, ids binary, lengths binary, text binary" + extra

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, more = zstandard.ZstdCompressor(3), describe() if describe else lambda parts: ()
        base, n = TaskContext.get().partitionId() << 33, 0
        ids, parts, size = [], [], 0

        def out() -> pa.RecordBatch:
            nonlocal ids, parts, size, n
            row = (base + n, np.array(ids, "<i8").tobytes(), np.array([len(p) for p in parts], "<i8").tobytes(), pack.compress(b"".join(parts)), *more(parts))
            ids, parts, size, n = [], [], 0, n + 1
            return batch_of(schema, [row])

        for key, text in rows_of(batches):
            raw = (text or "").encode()
            if parts and size + len(raw) > chunk_bytes:
                yield out()
            ids.append(key)
            parts.append(raw)
            size += len(raw)
        if parts:
            yield out()

    path = scratch_path(docs.sparkSession, "chunks")
    name = scratch_table(docs.sparkSession, "chunks_" + path[-12:])
    rows = docs.mapInArrow(task, schema).repartition(buckets, "chunk")
    rows.write.format("parquet").option("compression", "uncompressed").option("path", path).bucketBy(buckets, "chunk").sortBy("chunk").saveAsTable(name)
    return docs.sparkSession.table(name)


def with_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NONE)).alias("doc_id"), F.col(text_col).alias("text"))


def unpack(ids: bytes, lengths: bytes, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    return np.frombuffer(ids, "<i8"), np.frombuffer(lengths, "<i8"), np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8)


def to_buckets(sent: DataFrame, partitions: int, task: Callable, schema: str) -> DataFrame:
    """Run ``task`` over batches in which each bucket's rows follow one another."""
    return sent.repartition(partitions, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(task, schema)
