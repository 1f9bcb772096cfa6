"""Substring dedup by blockwise suffix sorting with a difference cover.

Every byte covered by a WIDTH-byte string that also starts in a document with a smaller doc_id goes.

1. Documents are packed into chunks, a bucketed table, so that later joins by chunk move no text. A chunk also keeps
   its anchors: the GRAM-byte string with the least hash within each WIDTH bytes, the leftmost of equals. Equal strings
   have equal anchors, and neighbouring suffixes mostly share one: a slice is the text under such a run of suffixes.
2. Chunks send the names of their anchors, packed, a row per chunk and block; a bit for each comes back that says
   whether another chunk has it too. Anchors that only one document has end here: no string under them repeats.
3. Chunks send the slices of shared anchors to the block that the anchor names, of each distinct slice that of the
   smallest doc_id. So a block holds every occurrence of its strings, and blocks need nothing of each other.
4. A block's task sorts all suffixes of its distinct slices. The difference-cover sample of the block's text is ranked
   once; splitters from it deal the suffixes into buckets by prefix range; one bucket is sorted at a time, by PERIOD
   bytes and then, in long ties, by the sample's ranks (for any two suffixes some shift below PERIOD takes both to
   sample suffixes). Neighbours with a common prefix of WIDTH bytes, over the borders of buckets too, are the equal
   strings. What comes back is a mask for each slice.
5. Chunks put masks together into removed runs.

There is one suffix array for each block, not one for the corpus: dealing suffixes by prefix range over the whole corpus
would send WIDTH bytes for every suffix that may repeat, where a slice sends its bytes once for a run of them.

Memory: one chunk, or one block's slices (plan() sizes both to the input) and one bucket of its suffixes.

Defined results: null counts as empty; documents under WIDTH bytes lose nothing; documents with equal ids never remove
from each other (repeated rows are judged alike); a null id sorts below all others; texts of any length are judged whole;
an empty table gives no rows; extra columns are ignored, whatever their names. Hashes only choose what meets: slices and
suffixes are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.chunks import NONE, batch_of, build, by_bucket, from_low_bytes, low_bytes, mix64, plan, ranges, rows_of, runs, to_buckets, unpack, with_ids
from pairloom.llm.common import materialise, table

WIDTH = 50
GRAM = 20
#: A perfect difference set: every shift modulo PERIOD is a difference of two of its members.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Suffixes of one bucket, the most that are sorted at a time.
BUCKET = 1 << 16
#: Bits of an anchor's name. The upper ones are its block, so that a name within its block takes 5 bytes.
NAME_BITS, LEAST_BLOCKS = 48, 256
FACTORS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number; zeros beyond the end."""
    x = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    x = (x[:-1] << np.uint64(8)) | x[1:]
    x = (x[:-2] << np.uint64(16)) | x[2:]
    return ((x[:-4] << np.uint64(32)) | x[4:])[: len(text)]


class Anchors:
    """Anchors of a text: names (NAME_BITS each), and of each slice the place of its first suffix and how many it has."""

    def __init__(self, names: np.ndarray, low: np.ndarray, count: np.ndarray):
        self.names, self.low, self.count = names, low, count

    @classmethod
    def of(cls, raw: np.ndarray, lengths: np.ndarray) -> Anchors:
        n = len(raw)
        if n < WIDTH:
            return cls(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        words = _words(raw)
        m = n - GRAM + 1
        grams = mix64(words[:m] * FACTORS[0] + words[8 : m + 8] * FACTORS[1] + (words[12 : m + 12] ^ (words[:m] >> np.uint64(31))) * FACTORS[2])
        # 40 bits of the hash, then 24 of the place: the least is the leftmost of the least. Longer chunks go in parts.
        reach, suffixes = WIDTH - GRAM + 1, n - WIDTH + 1
        place = np.empty(suffixes, np.int64)
        step = (1 << 24) - WIDTH
        for at in range(0, suffixes, step):
            m = min(step, suffixes - at)
            part = (grams[at : at + m + reach - 1] >> np.uint64(24) << np.uint64(24)) | np.arange(m + reach - 1, dtype=np.uint64)
            width = 1
            while 2 * width <= reach:
                part = np.minimum(part[:-width], part[width:])
                width *= 2
            part = np.minimum(part[:m], part[reach - width : reach - width + m])
            place[at : at + m] = (part & np.uint64((1 << 24) - 1)).astype(np.int64) + at
        doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        inside = doc[:suffixes] == doc[WIDTH - 1 :]
        new = np.append(True, (place[1:] != place[:-1]) | (doc[1:suffixes] != doc[: suffixes - 1]) | (inside[1:] != inside[:-1]))
        low = np.flatnonzero(new)
        count = np.diff(np.append(low, suffixes))
        good = inside[low]
        low, count = low[good], count[good]
        return cls(mix64(grams[place[low]]) >> np.uint64(64 - NAME_BITS), low, count)

    def pack(self) -> tuple[bytes, bytes]:
        import zstandard

        gaps = self.low - np.append(0, (self.low + self.count)[:-1])
        return low_bytes(self.names, 6), zstandard.ZstdCompressor(3).compress(self.count.astype("<u1").tobytes() + gaps.astype("<i4").tobytes())

    @classmethod
    def unpack(cls, names: bytes, spans: bytes) -> Anchors:
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(spans)
        n = len(raw) // 5
        count = np.frombuffer(raw[:n], "<u1").astype(np.int64)
        return cls(from_low_bytes(names, 6), np.cumsum(np.frombuffer(raw[n:], "<i4") + np.append(0, count[:-1])[:n]), count)


def _describe():
    """Names and spans of a chunk's anchors."""

    def of(parts: list[bytes]) -> tuple[bytes, bytes]:
        return Anchors.of(np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts], np.int64)).pack()

    return of


def _block_of(names: np.ndarray, blocks: int) -> np.ndarray:
    """Blocks are ranges of names, so sorted names are sorted by block."""
    return (names >> np.uint64(16)) * np.uint64(blocks) >> np.uint64(NAME_BITS - 16)


def _base(block: int, blocks: int) -> int:
    """The least name of a block."""
    return -(-(block << (NAME_BITS - 16)) // blocks) << 16


def sort_heads(words: list[np.ndarray], last: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The order of PERIOD bytes in four words, then of ``last``, which takes the 32nd byte; and which differ from the one before."""
    words = [*words[:3], words[3] >> np.uint64(8) << np.uint64(8) | np.uint64(0) + np.asarray(last).astype(np.uint64)]
    heads = np.stack([w.byteswap() for w in words], 1).view("S32").ravel()
    order = np.argsort(heads)
    heads = heads[order]
    return order, heads[1:] != heads[:-1]


class CoverRanks:
    """Ranks of a block's difference-cover sample: the suffixes at places whose residue modulo PERIOD lies in COVER.

    The block's text is a row of slices; a suffix ends with its slice. For any two places some shift below PERIOD takes
    both to sample places, so what ties on PERIOD bytes is settled by two ranks, however long the tie is.
    """

    def __init__(self, text: np.ndarray, ends: np.ndarray):
        """ends: ends of the slices, ascending."""
        self.size = len(text)
        self.words = _words(np.concatenate([text, np.zeros(64, np.uint8)]))
        member = np.zeros(PERIOD, bool)
        member[list(COVER)] = True
        r = np.arange(PERIOD)
        self.shift = np.zeros((PERIOD, PERIOD), np.int64)  # takes residues r and s to members of the cover
        for d in range(PERIOD - 1, -1, -1):
            both = member[(r + d) % PERIOD][:, None] & member[(r + d) % PERIOD][None, :]
            self.shift[both] = d
        at = np.flatnonzero(np.resize(member, self.size))
        self.rank = np.zeros(self.size + PERIOD, np.int32)  # 0 beyond the text
        if not len(at):
            return
        left = ends[np.searchsorted(ends, at, "right")] - at
        order, differs = self._by_head(at, left)
        rank = self._dense(order, differs)
        self.rank[at] = rank
        depth = PERIOD
        while (left > depth).any():
            # The suffix depth bytes on has the same residue modulo PERIOD, so it is in the sample too.
            then = np.where(left > depth, self.rank[np.minimum(at + depth, self.size)], 0)
            both = rank.astype(np.uint64) << np.uint64(32) | then.astype(np.uint64)
            order = np.argsort(both)
            rank = self._dense(order, both[order][1:] != both[order][:-1])
            self.rank[at] = rank
            depth *= 2

    @staticmethod
    def _dense(order: np.ndarray, differs: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), np.int32)
        rank[order] = np.cumsum(np.append(1, differs))
        return rank

    def _by_head(self, at: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sample in the order of its first PERIOD bytes, cut at the slices' ends; and which differ from the one before."""
        words = [self.words[np.minimum(at + k, self.size)] for k in range(0, PERIOD, 8)]
        cut = np.flatnonzero(left < PERIOD + 1)
        for k, word in enumerate(words):
            room = np.clip(left[cut] - 8 * k, 0, 8).astype(np.uint64)
            drop = np.minimum(np.uint64(64) - np.uint64(8) * room, np.uint64(63))
            word[cut] = np.where(room > 0, word[cut] >> drop << drop, np.uint64(0))
        return sort_heads(words, np.minimum(left, PERIOD))

    def of(self, at: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return self.rank[at + shift]


class BlockSuffixes:
    """The suffixes of WIDTH bytes or more of a block of slices, sorted one bucket at a time.

    Splitters are sample suffixes at even distances; every suffix is dealt to the bucket between two of them by whole
    comparisons, so equal prefixes never make a large bucket. Besides the text and the ranks, memory is for one bucket.
    """

    def __init__(self, text: np.ndarray, lengths: np.ndarray, width: int = WIDTH, bucket: int = BUCKET):
        ends = np.cumsum(lengths)
        self.width = width
        self.cover = CoverRanks(text, ends)
        counts = np.maximum(0, lengths - width + 1)
        self.at = ranges(ends - lengths, counts)
        self.slice = np.repeat(np.arange(len(lengths)), counts)
        self.splitters = self._splitters(-(-len(self.at) // bucket) - 1)
        self.bucket = self._deal()

    def _heads(self, at: np.ndarray) -> list[np.ndarray]:
        """The first PERIOD bytes; a suffix here is longer than that."""
        w = self.cover.words
        return [w[at], w[at + 8], w[at + 16], w[at + 24] >> np.uint64(8) << np.uint64(8)]

    def _splitters(self, n: int) -> np.ndarray:
        """n of the suffixes that lie in the sample, in suffix order."""
        cover = np.isin(self.at % PERIOD, COVER)
        mine = self.at[cover]
        if n < 1 or not len(mine):
            return np.zeros(0, np.int64)
        ranked = mine[np.argsort(self.cover.rank[mine], kind="stable")]
        picked = ranked[np.linspace(0, len(ranked) - 1, n + 2).astype(np.int64)[1:-1]]
        rank = self.cover.rank[picked]
        return picked[np.append(True, rank[1:] != rank[:-1])]

    def _compare(self, at: np.ndarray, pivot: int) -> np.ndarray:
        """-1, 0 or 1: suffixes against one, by PERIOD bytes and then by the cover's ranks."""
        side = np.zeros(len(at), np.int8)
        for mine, its in zip(self._heads(at), self._heads(np.array([pivot])), strict=True):
            side = np.where(side == 0, (mine > its[0]).astype(np.int8) - (mine < its[0]).astype(np.int8), side)
        tied = np.flatnonzero(side == 0)
        d = self.cover.shift[at[tied] % PERIOD, pivot % PERIOD]
        side[tied] = np.sign(self.cover.of(at[tied], d) - self.cover.of(np.full(len(tied), pivot), d))
        return side

    def _deal(self) -> np.ndarray:
        """The bucket of each suffix: how many splitters are not above it."""
        first = self.cover.words[self.splitters]
        mine = self.cover.words[self.at]
        low, high = np.searchsorted(first, mine, "left"), np.searchsorted(first, mine, "right")
        out = low
        for k in range(len(first)):  # only those that share eight bytes with the splitter are compared whole
            near = np.flatnonzero((low <= k) & (k < high))
            out[near] += self._compare(self.at[near], int(self.splitters[k])) >= 0
        return out

    def _sort(self, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One bucket in suffix order, and which suffixes differ from the one before within PERIOD bytes."""
        order, differs = sort_heads(self._heads(self.at[idx]))
        idx = idx[order]
        group = np.cumsum(np.append(0, differs))
        open_ = np.bincount(group)[group] > 1
        while open_.any():  # long ties: split all groups by their first suffix, again and again: smaller, equal, larger
            place = np.flatnonzero(open_)
            at, g = self.at[idx[place]], group[place]
            first = np.append(True, g[1:] != g[:-1])
            pivot = at[np.maximum.accumulate(np.where(first, np.arange(len(place)), 0))]
            d = self.cover.shift[at % PERIOD, pivot % PERIOD]
            side = np.sign(self.cover.of(at, d) - self.cover.of(pivot, d))
            sub = np.lexsort((side, g))
            idx[place] = idx[place][sub]
            side, g = side[sub], g[sub]
            new = np.append(True, (g[1:] != g[:-1]) | (side[1:] != side[:-1]))
            sizes = np.diff(np.append(np.flatnonzero(new), len(place)))
            group[place] = np.cumsum(new)
            open_[place] = np.repeat(sizes > 1, sizes) & (side != 0)
        return idx, differs

    def _same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffixes a and b have their first width bytes in common."""
        w = self.cover.words
        out = np.ones(len(a), bool)
        for k in range(0, self.width, 8):
            drop = np.uint64(max(0, 8 * (k + 8 - self.width)))
            out &= w[a + k] >> drop == w[b + k] >> drop
        return out

    def classes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Bucket by bucket, suffixes (places in at) in order and their classes: neighbours with width bytes in common.

        A class goes on over the border to the next bucket if the last suffix and its neighbour there are alike.
        """
        order = np.argsort(self.bucket, kind="stable")
        ends = np.cumsum(np.bincount(self.bucket, minlength=1)) if len(order) else np.zeros(0, np.int64)
        begin, number, last = 0, 0, None
        for end in ends.tolist():
            if end == begin:
                continue
            idx, differs = self._sort(order[begin:end])
            at = self.at[idx]
            new = differs
            tied = np.flatnonzero(~differs)
            new[tied] = ~self._same(at[tied], at[tied + 1])
            if last is not None:
                number += int(not self._same(np.array([last]), at[:1])[0])
            kind = number + np.cumsum(np.append(0, new))
            yield idx, kind
            begin, number, last = end, int(kind[-1]), int(at[-1])


def owners(text: np.ndarray, lengths: np.ndarray, docs: np.ndarray, width: int = WIDTH, bucket: int = BUCKET) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix of width bytes or more of the slices: its slice, and the smallest doc that has its first width bytes."""
    block = BlockSuffixes(text, lengths, width, bucket)
    mine = docs[block.slice]
    least = np.empty(len(mine), np.int64)
    at_border: tuple[int, int, list] | None = None  # class that reached the last bucket's end, its least doc, its members
    for idx, kind in block.classes():
        base = int(kind[0])
        low = np.full(int(kind[-1]) - base + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, kind - base, mine[idx])
        if at_border is not None and at_border[0] == base:
            low[0] = min(low[0], at_border[1])
            for earlier in at_border[2]:
                least[earlier] = low[0]
            members = at_border[2]
        else:
            members = []
        least[idx] = low[kind - base]
        tail = idx[kind == kind[-1]]
        at_border = (int(kind[-1]), int(low[-1]), [*members, tail] if int(kind[-1]) == base else [tail])
    return block.slice, least


def _send_anchors(chunks: DataFrame, blocks: int) -> DataFrame:
    schema = "bucket long, chunk long, keys binary"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, *packed in rows_of(batches):
            names = np.unique(Anchors.unpack(*packed).names)
            yield batch_of(schema, [(b, chunk, low_bytes(names[lo:hi] - np.uint64(_base(b, blocks)), 5)) for b, lo, hi in by_bucket(_block_of(names, blocks))])

    return chunks.select("chunk", "names", "spans").mapInArrow(task, schema)


def _shared_bits(sent: DataFrame, partitions: int) -> DataFrame:
    """(chunk, bucket, bits): for each anchor that the chunk sent to the bucket, whether another chunk has it."""
    schema = "chunk long, bucket long, bits binary"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches):
            parts = [from_low_bytes(r[2], 5) for r in rows]
            ordered = np.sort(np.concatenate(parts))
            twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
            out = []
            for r, p in zip(rows, parts, strict=True):
                at = np.searchsorted(twice, p)
                at[at == len(twice)] = 0
                out.append((r[1], r[0], np.packbits(twice[at] == p if len(twice) else np.zeros(len(p), bool)).tobytes()))
            yield batch_of(schema, out)

    return to_buckets(sent, partitions, task, schema)


def _padded_words(text: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The bytes of each slice as big-endian words, zeros beyond its end."""
    longest = int(sizes.max(initial=8))
    words = _words(np.concatenate([text, np.zeros(longest + 8, np.uint8)]))
    columns = []
    for k in range(0, longest, 8):
        room = np.clip(sizes - k, 0, 8).astype(np.uint64)
        drop = np.minimum(np.uint64(64) - np.uint64(8) * room, np.uint64(63))
        columns.append(np.where(room > 0, words[begins + k] >> drop << drop, np.uint64(0)))
    return columns


def _differs(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Which rows, in order, differ from the one before in any column."""
    out = np.zeros(max(0, len(order) - 1), bool)
    for c in columns:
        c = c[order]
        out |= c[1:] != c[:-1]
    return out


def _shared(anchors: Anchors, ids: np.ndarray, lengths: np.ndarray, raw: np.ndarray, bits: dict[int, bytes], blocks: int) -> dict[str, np.ndarray]:
    """The chunk's slices under anchors that two documents share, sorted by name, bytes and doc_id; first: of equal ones."""
    keys, at = np.unique(anchors.names, return_inverse=True)
    wide = np.zeros(len(keys), bool)
    for b, lo, hi in by_bucket(_block_of(keys, blocks)):
        if b in bits:
            wide[lo:hi] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=hi - lo).astype(bool)
    who = ids[np.searchsorted(np.cumsum(lengths), anchors.low, "right")]
    least, most = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), NONE)
    np.minimum.at(least, at, who)
    np.maximum.at(most, at, who)
    use = np.flatnonzero((wide | (least < most))[at])
    name, who, low, count = anchors.names[use], who[use], anchors.low[use], anchors.count[use]
    columns = _padded_words(raw, low, count + WIDTH - 1)
    form = count.astype(np.uint64)
    for c in columns:
        form = mix64(form + c * FACTORS[0])
    order = np.lexsort((low, who, form, name))
    # The hash only brings equal slices together; whether they are equal, their bytes say.
    first = np.append(True, _differs(order, name, count, *columns)) if len(order) else np.zeros(0, bool)
    return {"name": name[order], "id": who[order], "low": low[order], "count": count[order], "first": first}


def _send_slices(joined: DataFrame, blocks: int) -> DataFrame:
    """(bucket, chunk, keys, docs, sizes, text): the slices of shared anchors, of each distinct one its smallest doc."""
    schema = "bucket long, chunk long, keys binary, docs binary, sizes binary, text binary"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(3)
        for chunk, ids, lengths, text, names, spans, bits in rows_of(batches):
            ids, lengths, raw = unpack(ids, lengths, text)
            found = _shared(Anchors.unpack(names, spans), ids, lengths, raw, {x["bucket"]: x["bits"] for x in bits or ()}, blocks)
            f = found["first"]
            name, doc, low, size = found["name"][f], found["id"][f], found["low"][f], found["count"][f] + WIDTH - 1
            rows = []
            for b, lo, hi in by_bucket(_block_of(name, blocks)):
                data = raw[ranges(low[lo:hi], size[lo:hi])].tobytes()
                rows.append((b, chunk, low_bytes(name[lo:hi] - np.uint64(_base(b, blocks)), 5), doc[lo:hi].astype("<i8").tobytes(), size[lo:hi].astype("<u1").tobytes(), pack.compress(data)))
            yield batch_of(schema, rows)

    return joined.mapInArrow(task, schema)


def masks(keys: np.ndarray, docs: np.ndarray, sizes: np.ndarray, text: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For each slice of a block, the suffixes (bit 0: the first) whose first width bytes a smaller doc of the block has too.

    Equal slices of an anchor are one: all but the smallest doc's lose everything, and that one is sorted for all.
    """
    begins = np.cumsum(sizes) - sizes
    counts = sizes - width + 1
    full = (np.uint64(1) << counts.astype(np.uint64)) - np.uint64(1)
    columns = _padded_words(text, begins, sizes)
    form = sizes.astype(np.uint64)
    for c in columns:
        form = mix64(form + c * FACTORS[0])
    order = np.lexsort((docs, form, keys))
    head = np.append(True, _differs(order, keys, sizes, *columns))
    kind = np.cumsum(head) - 1
    head_doc = docs[order][head][kind]
    at = order[head]
    which, smallest = owners(text[ranges(begins[at], sizes[at])], sizes[at], docs[at], width)
    nth = ranges(np.zeros(len(at), np.int64), counts[at])
    lost = smallest < docs[at][which]
    least = np.zeros(len(at), np.uint64)
    np.bitwise_or.at(least, which[lost], np.uint64(1) << nth[lost].astype(np.uint64))
    out = np.empty(len(keys), np.uint64)
    out[order] = np.where(docs[order] > head_doc, full[order], least[kind])
    return out


def _answer_slices(sent: DataFrame, partitions: int) -> DataFrame:
    """(chunk, bucket, masks): a mask for each slice that the chunk sent to the bucket."""
    schema = "chunk long, bucket long, masks binary"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor().decompress
        for rows in runs(batches):
            keys = np.concatenate([from_low_bytes(r[2], 5) for r in rows])
            docs = np.concatenate([np.frombuffer(r[3], "<i8") for r in rows])
            sizes = np.concatenate([np.frombuffer(r[4], "<u1") for r in rows]).astype(np.int64)
            text = np.concatenate([np.frombuffer(unzip(r[5]), np.uint8) for r in rows])
            found = np.split(masks(keys, docs, sizes, text).astype("<u4"), np.cumsum([len(r[4]) for r in rows])[:-1])
            yield batch_of(schema, [(r[1], r[0], x.tobytes()) for r, x in zip(rows, found, strict=True)])

    return to_buckets(sent, partitions, task, schema)


def _remove(joined: DataFrame, blocks: int) -> DataFrame:
    """Per document: what is removed, and the remaining bytes."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, lengths, text, names, spans, bits, sent in rows_of(batches):
            ids, lengths, raw = unpack(ids, lengths, text)
            found = _shared(Anchors.unpack(names, spans), ids, lengths, raw, {x["bucket"]: x["bits"] for x in bits or ()}, blocks)
            f = found["first"]
            own = {x["bucket"]: x["masks"] for x in sent or ()}
            mask = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(own[b], "<u4").astype(np.uint64) for b, _, _ in by_bucket(_block_of(found["name"][f], blocks)))])
            group = np.cumsum(f) - 1
            size = found["count"]
            full = (np.uint64(1) << size.astype(np.uint64)) - np.uint64(1)
            mine = np.where(found["id"] > found["id"][f][group], full, mask[group]) if len(group) else np.zeros(0, np.uint64)
            at = ranges(found["low"], size)
            nth = ranges(np.zeros(len(size), np.int64), size)
            lost = at[(np.repeat(mine, size) >> nth.astype(np.uint64)) & np.uint64(1) == 1]
            edges = np.zeros(len(raw) + 1, np.int32)
            np.add.at(edges, lost, 1)
            np.add.at(edges, lost + WIDTH, -1)
            gone = np.cumsum(edges[:-1]) > 0
            rows = []
            end = np.cumsum(lengths)
            for key, a, b in zip(ids.tolist(), (end - lengths).tolist(), end.tolist(), strict=True):
                g = gone[a:b]
                n = int(np.count_nonzero(g))
                spans = int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1])) if n else 0
                rest = (raw[a:b][~g] if n else raw[a:b]).tobytes()
                rows.append((None if key == NONE else key, b - a, n, spans, sha256(rest).hexdigest(), rest))
            yield batch_of(schema, rows)

    return joined.mapInArrow(task, schema)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row."""
    rows = with_ids(docs, id_col, text_col)
    sizes = plan(rows, LEAST_BLOCKS)
    chunks = build(rows, sizes.partitions, chunk_bytes or sizes.chunk_bytes, _describe, ", names binary, spans binary")
    bits = _shared_bits(_send_anchors(chunks, sizes.buckets), sizes.partitions)
    bits = materialise(bits.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits")), "bits")
    joined = chunks.join(bits.hint("merge"), "chunk", "left").select("chunk", "ids", "lengths", "text", "names", "spans", "bits")
    answers = _answer_slices(_send_slices(joined, sizes.buckets), sizes.partitions)
    answers = materialise(answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "masks")).alias("masks")), "masks")
    return _remove(joined.join(answers.hint("merge"), "chunk", "left").select("chunk", "ids", "lengths", "text", "names", "spans", "bits", "masks"), sizes.buckets)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
#: Every WIDTH-byte string of every text, in hexadecimal; long texts are cut into overlapping parts first, as substr counts from the front.
ORACLE = {
    "op9_suffix_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS k, coalesce(doc_id, -9223372036854775808) AS id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        p AS (SELECT k, id, low, substr(h, 2 * low + 1, 610) AS part, least(256, len(h) // 2 - 49 - low) AS m FROM (SELECT k, id, h, unnest(range(0, greatest(0, len(h) // 2 - 49), 256)) AS low FROM d)),
        s AS (SELECT k, id, low + j AS i, substr(part, 2 * j + 1, 100) AS x FROM (SELECT k, id, low, part, unnest(range(0, m)) AS j FROM p)),
        m AS (SELECT x, min(id) AS least FROM s GROUP BY x),
        w AS (SELECT k, i, id > least AS lost FROM s JOIN m USING (x)),
        n AS (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS next, lag(i) OVER (PARTITION BY k ORDER BY i) AS prior FROM w WHERE lost),
        c AS (SELECT k, sum(least(50, coalesce(next, i + 50) - i))::BIGINT AS n_removed, sum((prior IS NULL OR prior + 50 < i)::INT)::BIGINT AS n_spans FROM n GROUP BY k),
        b AS (SELECT k, i, row_number() OVER (PARTITION BY k ORDER BY i) AS r FROM n WHERE prior IS NULL OR prior + 50 < i),
        e AS (SELECT k, i + 50 AS stop, row_number() OVER (PARTITION BY k ORDER BY i) AS r FROM n WHERE next IS NULL OR next > i + 50),
        g AS (SELECT b.k, b.r, b.i AS low, coalesce(lag(e.stop) OVER (PARTITION BY b.k ORDER BY b.r), 0) AS since, e.stop AS upto FROM b JOIN e ON b.k = e.k AND b.r = e.r),
        t AS (SELECT g.k, string_agg(substr(h, 2 * since + 1, 2 * (low - since)), '' ORDER BY r) || substr(any_value(h), 2 * max(upto) + 1) AS rest FROM g JOIN d ON g.k = d.k GROUP BY g.k)
        SELECT nullif(id, -9223372036854775808) AS doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
        FROM d LEFT JOIN c ON d.k = c.k LEFT JOIN t ON d.k = t.k
    """
}
