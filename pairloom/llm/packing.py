"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

Each task packs the rows of its own input split, with no shuffle. A document is cut into whole sequences from its
front; what remains of it waits in a bounded pool. A bin takes, again and again, the pool's item with the largest dot
product of its demands and the bin's free room, both as shares of the limits, among those that fit. When none fits, an
item is cut to fill the bin, so that only a task's last sequence, or one whose segments or loss tokens are used up, is
padded. Memory: the pool (``POOL`` items shorter than a sequence) and one Arrow batch.

Defined results: a null text counts as empty, and an empty text is the one id END; a null id is kept as null; repeated
rows are packed as often as they occur; texts of any length are cut, long runs of white space included; an empty table
gives no rows; extra columns are ignored, whatever their names. A task that runs again on the same split gives the same
sequences.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import table

END = 0
POOL = 4096
#: Sequences of one task; task t numbers its own from t * TASK_SEQUENCES.
TASK_SEQUENCES = 1 << 33


class Limits(NamedTuple):
    tokens: int = 1024
    segments: int = 256
    loss: int = 1024


class Item(NamedTuple):
    key: object
    ids: np.ndarray  # of the whole document or a view of its rest
    base: int  # where ids begin in the document
    loss: np.ndarray | None  # loss tokens before each place of ids; None: every token bears loss
    total: int  # ids of the whole document


class Packer:
    """Call add() for each document and close() at the end; take() hands out the pieces so far."""

    def __init__(self, limits: Limits, first_sequence: int = 0, pool: int = POOL):
        self.limits, self.pool, self.next = limits, pool, first_sequence
        self.kinds: dict[tuple[int, int], int] = {}
        self.tokens, self.losses, self.counts = np.zeros(64, np.int64), np.zeros(64, np.int64), np.zeros(64, np.int64)
        self.items: list[list[Item]] = []
        self.held = 0
        self.bin: list[int] | None = None  # free tokens, segments, loss tokens of the open sequence
        self.sequence = first_sequence
        self.pieces: list[tuple] = []

    def add(self, key, ids: np.ndarray, loss: np.ndarray | None = None) -> None:
        item = Item(key, ids, 0, None if loss is None else np.concatenate([[0], np.cumsum(loss)]), len(ids))
        while len(item.ids) >= self.limits.tokens or (item.loss is not None and item.loss[-1] - item.loss[0] > self.limits.loss):
            n = self._fits(item, self.limits.tokens, self.limits.loss)
            self._emit(item, n, self.next, 0)
            self.next += 1
            item = self._rest(item, n)
        if len(item.ids):
            self._hold(item)
        if self.held >= self.pool:
            self._drain(self.pool // 2)

    def close(self) -> None:
        self._drain(0)
        self.bin = None

    def take(self) -> list[tuple]:
        out, self.pieces = self.pieces, []
        return out

    @staticmethod
    def _fits(item: Item, tokens: int, loss: int) -> int:
        if item.loss is None:
            return min(len(item.ids), tokens, loss)
        return min(len(item.ids), tokens, int(np.searchsorted(item.loss, item.loss[0] + loss, "right")) - 1)

    @staticmethod
    def _rest(item: Item, n: int) -> Item:
        return Item(item.key, item.ids[n:], item.base + n, None if item.loss is None else item.loss[n:], item.total)

    def _emit(self, item: Item, n: int, sequence: int, offset: int) -> None:
        self.pieces.append((item.key, item.base, n, zlib.crc32(item.ids[:n].tobytes()), item.total, sequence, offset))

    def _hold(self, item: Item) -> None:
        kind = (len(item.ids), len(item.ids) if item.loss is None else int(item.loss[-1] - item.loss[0]))
        k = self.kinds.get(kind)
        if k is None:
            k = self.kinds[kind] = len(self.items)
            self.items.append([])
            if k == len(self.counts):
                self.tokens, self.losses, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.tokens, self.losses, self.counts))
            self.tokens[k], self.losses[k] = kind
        self.items[k].append(item)
        self.counts[k] += 1
        self.held += 1

    def _pop(self, k: int) -> Item:
        self.counts[k] -= 1
        self.held -= 1
        return self.items[k].pop()

    def _drain(self, keep: int) -> None:
        lim = self.limits
        while self.held > keep:
            if self.bin is None:
                self.bin, self.sequence = list(lim), self.next
                self.next += 1
            free, segments, loss = self.bin
            n = len(self.items)
            t, s = self.tokens[:n], self.losses[:n]
            fits = (self.counts[:n] > 0) & (t <= free) & (s <= loss)
            # An item's segment demand is 1 for all, so it adds the same to every product.
            dot = np.where(fits, t * (free / lim.tokens**2) + s * (loss / lim.loss**2), -1.0)
            k = int(dot.argmax())
            if dot[k] >= 0:
                item, size = self._pop(k), None
            else:
                k = int(np.where(self.counts[:n] > 0, t, -1).argmax())
                item = self._pop(k)
                size = self._fits(item, free, loss)
                if size == 0:  # no loss tokens left, and this item begins with one
                    self._hold(item)
                    self._shut()
                    continue
            size = len(item.ids) if size is None else size
            self._emit(item, size, self.sequence, lim.tokens - free)
            if size < len(item.ids):
                self._hold(self._rest(item, size))
            self.bin = [free - size, segments - 1, loss - (size if item.loss is None else int(item.loss[size] - item.loss[0]))]
            if self.bin[0] == 0 or self.bin[1] == 0 or (self.bin[2] <= 0 and lim.loss >= lim.tokens):
                self._shut()

    def _shut(self) -> None:
        self.bin = None


def encoder(path: str, pattern: str, specials: dict[str, int]):
    """The byte-level BPE of a rank file; for this vocabulary its ids are those of the tokenizers file, several times faster."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials)


#: Unicode white space. The tokenizer's search for the end of a run of it goes as deep as the run is long.
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_BLANK = re.compile(f"[{BLANKS}]{{5000,}}+")


def encode(enc, text: str) -> list[int]:
    """The ids of a text of any length.

    A long run of white space is handed over as the one piece that the pattern makes of it: all of it at the end of a
    text, else all but its last character, which belongs to what follows. Pieces never reach from text into white space.
    """
    ids: list[int] = []
    at = 0
    for run in LONG_BLANK.finditer(text):
        last = run.end() == len(text) or any(text.startswith(x, run.end()) for x in enc.special_tokens_set)
        end = run.end() - (not last)
        ids += enc.encode(text[at : run.start()], allowed_special="all")
        ids += enc._encode_single_piece(text[run.start() : end])
        at = end
    return ids + enc.encode(text[at:], allowed_special="all")


def loss_mask(enc, ids: list[int], spans: list[dict], length: int) -> np.ndarray:
    """1 for each of ids, and END after them, that bears loss."""
    chars = np.zeros(length + 1, np.int64)
    for span in spans:
        chars[max(0, span["start"]) : max(0, span["stop"])] = 1
    chars[length] = chars[length - 1] if length else 0
    return np.append(chars[enc.decode_with_offsets(ids)[1]] if ids else chars[:0], chars[length])


SPANS = "array<struct<start:int,stop:int>>"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])


def pack(docs: DataFrame, limits: Limits = Limits(), vocabulary: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``vocabulary`` names a file of the public_tokenizers package, which every executor has. ``loss_col`` is an array of
    (start, stop) character spans of the text: tokens that begin in one bear loss, and END does if the last character
    does. Without the column, or where it is null, every token bears loss.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        enc = encoder(public_tokenizers.path(vocabulary), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})
        packer = Packer(limits, TaskContext.get().partitionId() * TASK_SEQUENCES)

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.take(), strict=True)) or [()] * len(ARROW)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=ARROW)

        for batch in batches:
            for key, text, spans in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                ids = encode(enc, text.as_py() or "")
                loss = None if spans.as_py() is None else loss_mask(enc, ids, spans.as_py(), len(text.as_py() or ""))
                ids.append(END)
                packer.add(key.as_py(), np.array(ids, "<u4"), loss)
                if len(packer.pieces) >= 20_000:
                    yield out()
        packer.close()
        yield out()

    spans = F.lit(None) if loss_col is None else F.col(loss_col)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col), spans.cast(SPANS).alias("spans")).mapInArrow(task, SCHEMA)


def from_turns(turns: DataFrame, roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """doc_id, text (turns joined by \\n) and spans (the turns of ``roles``) of every conversation, for pack()."""
    rows = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(done, turn):
        end = done["at"] + F.length(turn["text"])
        span = F.array(F.struct(done["at"].alias("start"), end.alias("stop"))).cast(SPANS)
        mine = F.coalesce(turn["role"].isin(*roles), F.lit(False))
        return F.struct((end + 1).alias("at"), F.when(mine, F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    return rows.select("doc_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"), F.aggregate("t", zero, step)["spans"].alias("spans"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op4_packing": op4_packing}
ORACLE: dict[str, str] = {}
