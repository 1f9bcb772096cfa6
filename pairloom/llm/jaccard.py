"""N-gram Jaccard join with a count-vector R-tree.

1. Texts become sets of word-shingle hashes; equal sets are one vertex from here on.
2. Every vertex is a point: for each of DIMENSIONS groups, the number of its shingles whose hash falls there. The
   overlap of two sets is at most the sum of their points' smaller coordinates.
3. The R-tree holds the points under one coordinate more, a shingle: sets with a similarity of at least t share one of
   their first n - ceil(t n) + 1 shingles in any common order, so a vertex is entered under those of its first shingles
   that another vertex has too. The order is by how many vertices have a shingle, rare first, counted over all of them.
   Without that coordinate the tree prunes next to nothing: at hundreds of shingles a node of some sets covers all
   groups. The tree is bulk-loaded: shingles are dealt to tasks by range of hash, a task sorts a range by shingle and
   size, packs LEAF points to a leaf and LEAF nodes to a node. It is joined with itself level by level: two nodes under
   one shingle meet if their sizes and the summed minima of their maxima allow the threshold, and points likewise. What
   survives is a candidate pair; pairs that already hang together are not looked at again, so copies never meet in all
   pairs. Points and keys travel as packed arrays, a row per chunk and bucket (chunks.py).
4. Candidates that hang together are verified on their sets, through a tree of their own with the same bound.
5. Those of more than GROUP sets or GROUP_SHINGLES shingles are cut by hash into groups; clusters are merged through
   their first members, and at last what lies outside the largest cluster meets the rest, so that no task holds more
   than two groups' sets.

Defined results: a null or blank text has an empty set and is linked with nothing; a null id sorts below all others;
rows that repeat an id are documents of their own, and a component's name is the smallest id in it; texts of any length
are read whole; an empty table gives no rows; extra columns are ignored, whatever their names (keep_one() returns them).
Shingles are named by 64 bits of a hash of their words' hashes, long words by a cryptographic one.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, md5
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.chunks import NONE, batch_of, build, by_bucket, from_low_bytes, low_bytes, mix64, plan, rows_of, runs, to_buckets, unpack, with_ids
from pairloom.llm.common import join_groups, materialise, one_row_each, table
from pairloom.llm.graph import components

WORDS = 5
#: Two sets link when DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
DIMENSIONS = 32
LEAF = 16
#: Counts below it are written as they are.
STEPS = 192
GROUP, GROUP_SHINGLES = 4000, 1 << 22
#: Bytes of a word up to which a fast hash names it, and that hash's seed.
SHORT_WORD, SEED = 32, 0x9E3779B97F4A7C15
#: A-Z to a-z and the six white-space bytes to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
LOW4 = (1 << 32) - 1


def word_name(word: bytes) -> int:
    """64 bits for a word; for long ones, of which many can be made that a fast hash confuses, a cryptographic hash's."""
    if len(word) <= SHORT_WORD:
        return xxhash.xxh3_64_intdigest(word, SEED)
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little")


class Shingler:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words of a text."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.factors = mix64(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(SEED)) | np.uint64(1)

    def __call__(self, text: bytes) -> np.ndarray:
        parts = text.translate(FOLD).split()
        if not parts:
            return np.zeros(0, np.uint64)
        names = np.fromiter(map(word_name, parts) if max(map(len, parts)) > SHORT_WORD else map(xxhash.xxh3_64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))
        k = min(self.words, len(parts))
        n = len(parts) - k + 1
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out += names[i : i + n] * self.factors[i]
        out = np.sort(mix64(out))
        return out[np.append(True, out[1:] != out[:-1])]


class Clusters:
    """Union-find that keeps every point's root up to date; the smaller cluster is relabelled."""

    def __init__(self, roots: np.ndarray):
        self.root = roots.copy()
        order = np.argsort(self.root, kind="stable")
        names, at = np.unique(self.root[order], return_index=True)
        self.members = dict(zip(names.tolist(), (x.tolist() for x in np.split(order, at[1:])), strict=True))

    def join(self, i: int, j: int) -> None:
        a, b = int(self.root[i]), int(self.root[j])
        if a == b:
            return
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        moved = self.members.pop(b)
        self.root[moved] = a
        self.members[a] += moved


class CountTree:
    """R-tree over count vectors, packed by sorting on size and then on the spread of the counts."""

    def __init__(self, sets: list[np.ndarray], dimensions: int = DIMENSIONS):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.points = np.stack([np.bincount((s >> np.uint64(8)).astype(np.int64) % dimensions, minlength=dimensions) for s in sets]).astype(np.int32)
        self.order = np.lexsort((*self.points[:, :4].T, self.sizes))
        self.place = np.empty(len(sets), np.int64)
        self.place[self.order] = np.arange(len(sets))
        self.levels = []  # per level: first, last point of each node in order, most of each coordinate, least and most size
        p, s, n = self.points[self.order], self.sizes[self.order], len(sets)
        low = np.arange(0, n, LEAF)
        high = np.minimum(low + LEAF, n)
        top, least, most = np.maximum.reduceat(p, low), np.minimum.reduceat(s, low), np.maximum.reduceat(s, low)
        self.levels.append((low, high, top, least, most))
        while len(low) > 1:
            at = np.arange(0, len(low), LEAF)
            low, high = low[at], high[np.minimum(at + LEAF, len(high)) - 1]
            top, least, most = np.maximum.reduceat(top, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((low, high, top, least, most))

    def search(self, i: int, clusters: Clusters, num: int, den: int) -> Iterator[np.ndarray]:
        """Points beyond i, in the tree's order, that may link with it and are in other clusters, leaf by leaf."""
        place, x, n = int(self.place[i]), self.points[i], self.sizes[i]
        nodes = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            low, high, top, least, most = (a[nodes] for a in self.levels[depth])
            bound = np.minimum(top, x).sum(1)
            # overlap >= num / (num + den) * (sum of sizes), and the sizes' ratio is num / den at least
            fits = (high > place + 1) & (bound * (num + den) >= num * (n + least)) & (least * num <= n * den) & (most * den >= n * num)
            nodes = nodes[fits]
            if depth:
                width = len(self.levels[depth - 1][0])
                nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
                nodes = nodes[nodes < width]
        for node in nodes:
            low, high = max(int(self.levels[0][0][node]), place + 1), int(self.levels[0][1][node])
            at = self.order[low:high]
            at = at[clusters.root[at] != clusters.root[i]]
            if len(at):
                bound = np.minimum(self.points[at], x).sum(1)
                sizes = self.sizes[at]
                yield at[(bound * (num + den) >= num * (n + sizes)) & (np.minimum(n, sizes) * den >= num * np.maximum(n, sizes))]


def point(found: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A set's counts by group in a byte each, rounded up from STEPS on, so that a bound never gets too small."""
    counts = np.bincount((found >> np.uint64(8)).astype(np.int64) % dimensions, minlength=dimensions)
    large = np.maximum(counts, STEPS)
    return np.where(counts < STEPS, counts, np.minimum(255, STEPS + np.ceil(4 * np.log2(large / STEPS) - 1e-9))).astype(np.uint8)


def counts_of(points: np.ndarray) -> np.ndarray:
    """Upper bounds of the counts that the bytes of points stand for; the last byte bounds nothing."""
    steps = np.arange(256, dtype=np.float64)
    steps[STEPS:] = np.ceil(STEPS * 2 ** ((steps[STEPS:] - STEPS) / 4) + 1e-6)
    steps[255] = 1 << 40
    return steps.astype(np.int64)[points]


def products(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each child of a with each child of b, pair by pair."""
    step = np.arange(LEAF)
    return np.repeat(a * LEAF, LEAF * LEAF) + np.tile(np.repeat(step, LEAF), len(a)), np.repeat(b * LEAF, LEAF * LEAF) + np.tile(np.tile(step, LEAF), len(b))


class PrefixTree:
    """Part of the R-tree: points under a range of shingles, joined with itself.

    Arrays of one element per entry: key (shingle), vertex (index of the rest), of which size (number of shingles) and
    counts (points) have a row per vertex.
    """

    def __init__(self, key: np.ndarray, vertex: np.ndarray, size: np.ndarray, counts: np.ndarray, num: int = NUM, den: int = DEN):
        order = np.lexsort((vertex, size[vertex], key))
        self.vertex, self.num, self.den = vertex[order], num, den
        self.size, self.counts = size, counts
        key = key[order]
        self.begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.end = np.append(self.begin, len(key))[1:]

    def fits(self, least_a, most_a, top_a, least_b, most_b, top_b) -> np.ndarray:
        """Whether sets of these sizes and counts may link: by the ratio of sizes and by the sum of the smaller counts."""
        out = (least_a * self.num <= most_b * self.den) & (least_b * self.num <= most_a * self.den)
        at = np.flatnonzero(out)
        bound = np.minimum(top_a[at], top_b[at]).sum(1)
        out[at] = bound * (self.num + self.den) >= self.num * (least_a[at] + least_b[at])
        return out

    def pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs of entries may link."""
        a, b = self.vertex[i], self.vertex[j]
        return self.fits(self.size[a], self.size[a], self.counts[a], self.size[b], self.size[b], self.counts[b])

    def _levels(self, low: int, high: int, label: np.ndarray) -> list[tuple]:
        """Nodes over the entries low..high-1 of one shingle: first, last entry, least, most size, top counts, and the one
        cluster that all of a node's entries are in, or -1."""
        v = self.vertex[low:high]
        size, counts, label = self.size[v], self.counts[v], label[v]
        first = np.arange(0, len(v), LEAF)
        levels = []
        least, most, top = np.minimum.reduceat(size, first), np.maximum.reduceat(size, first), np.maximum.reduceat(counts, first)
        one = np.where(np.minimum.reduceat(label, first) == np.maximum.reduceat(label, first), label[first], -1)
        levels.append((least, most, top, one))
        while len(least) > 1:
            at = np.arange(0, len(least), LEAF)
            least, most, top = np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.maximum.reduceat(top, at)
            same = np.minimum.reduceat(one, at) == np.maximum.reduceat(one, at)
            one = np.where(same, one[at], -1)
            levels.append((least, most, top, one))
        return levels

    def _descend(self, low: int, high: int, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves under one shingle that may hold a link between two clusters, level by level from the root."""
        levels = self._levels(low, high, label)

        def open_(depth: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            least, most, top, one = levels[depth]
            apart = (one[x] < 0) | (one[x] != one[y])
            x, y = x[apart], y[apart]
            good = self.fits(least[x], most[x], top[x], least[y], most[y], top[y])
            return x[good], y[good]

        a, b = open_(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))
        for depth in range(len(levels) - 2, -1, -1):
            width = len(levels[depth][0])
            keep = [(a[:0], b[:0])]
            for at in range(0, len(a), 1024):
                x, y = products(a[at : at + 1024], b[at : at + 1024])
                good = (x < width) & (y < width) & (x <= y)
                keep.append(open_(depth, x[good], y[good]))
            a, b = (np.concatenate(c) for c in zip(*keep, strict=True))
        for at in range(0, len(a), 256):
            yield a[at : at + 256], b[at : at + 256]

    def join(self) -> tuple[np.ndarray, np.ndarray]:
        """Edges (vertex, vertex) that hang together whatever the tree can't tell apart."""
        n = len(self.size)
        label = np.arange(n)
        edges: list[tuple[np.ndarray, np.ndarray]] = []

        def add(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal label
            apart = label[self.vertex[i]] != label[self.vertex[j]]
            i, j = i[apart], j[apart]
            good = self.pairs(i, j)
            x, y = self.vertex[i[good]], self.vertex[j[good]]
            if len(x):
                edges.append(stars(label[x], label[y]))
                moved = np.arange(n)
                moved[edges[-1][0]] = edges[-1][1]
                label = moved[label]

        # Neighbours first: copies under one shingle hang together before any pair of nodes is opened.
        reach = np.repeat(self.end, self.end - self.begin)
        at = np.arange(len(self.vertex))
        for step in range(1, LEAF):
            i = at[at + step < reach]
            if not len(i):
                break
            add(i, i + step)
        for low, high in zip(self.begin.tolist(), self.end.tolist(), strict=True):
            if high - low <= LEAF:
                continue
            for a, b in self._descend(low, high, label):
                i, j = products(a, b)
                good = (i < j) & (low + j < high)
                add(low + i[good], low + j[good])
        if not edges:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(c) for c in zip(*edges, strict=True))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def link(sets: list[np.ndarray], roots: np.ndarray | None = None, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Cluster of each set, beginning from ``roots``: the components of all links between the sets."""
    clusters = Clusters(np.arange(len(sets)) if roots is None else roots)
    tree = CountTree(sets)
    for i in tree.order.tolist():
        if len(clusters.members) == 1:
            break
        for found in tree.search(i, clusters, num, den):
            for j in found.tolist():
                if clusters.root[i] != clusters.root[j]:
                    common = overlap(sets[i], sets[j])
                    if common * den >= num * (len(sets[i]) + len(sets[j]) - common):
                        clusters.join(i, j)
    return clusters.root


def _describe(words: int):
    """Sizes and digests of a chunk's sets, and digests of its texts."""

    def begin():
        shingles = Shingler(words)

        def of(parts: list[bytes]) -> tuple[bytes, bytes, bytes]:
            sets = [shingles(p) for p in parts]
            return np.array([len(s) for s in sets], "<i4").tobytes(), b"".join(blake2b(s.tobytes(), digest_size=16).digest() for s in sets), b"".join(md5(p).digest() for p in parts)

        return of

    return begin


def _sets(chunks: DataFrame) -> DataFrame:
    """(chunk, place, doc_id, n, sig, tkey) of every document."""
    schema = "chunk long, place long, doc_id long, n long, sig binary, tkey binary"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, ns, sigs, tkeys in rows_of(batches):
            keys, sizes = np.frombuffer(ids, "<i8").tolist(), np.frombuffer(ns, "<i4").tolist()
            yield batch_of(schema, [(chunk, i, k, n, sigs[16 * i : 16 * i + 16], tkeys[16 * i : 16 * i + 16]) for i, (k, n) in enumerate(zip(keys, sizes, strict=True))])

    return chunks.select("chunk", "ids", "ns", "sigs", "tkeys").mapInArrow(task, schema)


def _keys(h: np.ndarray, buckets: int) -> np.ndarray:
    """bucket * 2**32 + 32 bits of a shingle's hash."""
    return ((h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (h & np.uint64(LOW4))


class Heads:
    """The shingles of a chunk's vertices: each vertex's sets one after the other (owner, found), and their keys
    (distinct, ascending) with the count of shingles that have them."""

    def __init__(self, shingles: Shingler, buckets: int, places: list, lengths: np.ndarray, raw: np.ndarray):
        ends = np.cumsum(lengths)
        self.places = sorted((x["place"], x["rep"]) for x in places)
        data = raw.tobytes()
        self.sets = [shingles(data[ends[i] - lengths[i] : ends[i]]) for i, _ in self.places]
        self.sizes = np.array([len(x) for x in self.sets], np.int64)
        self.owner = np.repeat(np.arange(len(self.sets)), self.sizes)
        self.found = np.concatenate([np.zeros(0, np.uint64), *self.sets])
        self.keys, self.at, self.count = np.unique(_keys(self.found, buckets), return_inverse=True, return_counts=True)


def _send_shingles(joined: DataFrame, buckets: int, words: int) -> DataFrame:
    schema = "bucket long, chunk long, keys binary, counts binary"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for chunk, ids, lengths, text, places in rows_of(batches):
            _, lengths, raw = unpack(ids, lengths, text)
            heads = Heads(shingles, buckets, places, lengths, raw)
            # Counts are mostly 1: only the others are written.
            rows = []
            for b, lo, hi in by_bucket(heads.keys >> np.uint64(32)):
                more = np.flatnonzero(heads.count[lo:hi] > 1)
                rows.append((b, chunk, low_bytes(heads.keys[lo:hi], 4), np.stack([more, heads.count[lo:hi][more]]).astype("<u4").tobytes()))
            yield batch_of(schema, rows)

    return joined.mapInArrow(task, schema)


def _rarity(sent: DataFrame, partitions: int) -> DataFrame:
    """(chunk, bucket, ranks): for each shingle that the chunk sent, four times the binary logarithm of its count, a byte."""
    schema = "chunk long, bucket long, ranks binary"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(3)
        for rows in runs(batches):
            parts = [from_low_bytes(r[2], 4) for r in rows]
            counts = []
            for r, p in zip(rows, parts, strict=True):
                count = np.ones(len(p), np.int64)
                more, n = np.frombuffer(r[3], "<u4").reshape(2, -1)
                count[more] = n
                counts.append(count)
            names, at = np.unique(np.concatenate(parts), return_inverse=True)
            total = np.bincount(at, np.concatenate(counts), len(names))
            out = []
            rank = np.ceil(4 * np.log2(total)).astype(np.uint8)[at]
            for r, x in zip(rows, np.split(rank, np.cumsum([len(p) for p in parts])[:-1]), strict=True):
                out.append((r[1], r[0], pack.compress(x.tobytes())))
            yield batch_of(schema, out)

    return to_buckets(sent, partitions, task, schema)


def _send_prefixes(joined: DataFrame, buckets: int, words: int, num: int, den: int) -> DataFrame:
    """(bucket, chunk, keys, who, ids, ns, points): the shared ones of each vertex's first shingles, rare first, and its point."""
    schema = "bucket long, chunk long, keys binary, who binary, ids binary, ns binary, points binary"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shingles, unzip = Shingler(words), zstandard.ZstdDecompressor().decompress
        for chunk, ids, lengths, text, places, ranks in rows_of(batches):
            ids, lengths, raw = unpack(ids, lengths, text)
            heads = Heads(shingles, buckets, places, lengths, raw)
            rank = np.zeros(len(heads.keys), np.uint8)
            of = {x["bucket"]: x["ranks"] for x in ranks or ()}
            for b, lo, hi in by_bucket(heads.keys >> np.uint64(32)):
                rank[lo:hi] = np.frombuffer(unzip(of[b]), np.uint8)
            # One order for all sets: rarity of the key, then the whole hash.
            mine = rank[heads.at]
            order = np.lexsort((heads.found, mine, heads.owner))
            begin = np.cumsum(heads.sizes) - heads.sizes
            nth = np.arange(len(order)) - begin[heads.owner[order]]
            first = heads.sizes - -(-num * heads.sizes // den) + 1
            use = order[(nth < first[heads.owner[order]]) & (mine[order] > 0)]
            key, who = heads.keys[heads.at[use]], heads.owner[use]
            reps = np.array([rep for _, rep in heads.places], np.int64)
            points = {i: point(heads.sets[i]) for i in np.unique(who).tolist()}
            order = np.argsort(key, kind="stable")
            key, who = key[order], who[order]
            rows = []
            for b, lo, hi in by_bucket(key >> np.uint64(32)):
                names, local = np.unique(who[lo:hi], return_inverse=True)
                rows.append((b, chunk, low_bytes(key[lo:hi], 4), local.astype("<u4").tobytes(), reps[names].astype("<i8").tobytes(), heads.sizes[names].astype("<i8").tobytes(), b"".join(points[i].tobytes() for i in names.tolist())))
            yield batch_of(schema, rows)

    return joined.mapInArrow(task, schema)


def _candidates(sent: DataFrame, partitions: int, num: int, den: int) -> DataFrame:
    """Edges (a, b) from each vertex to the first of those that the R-tree lets hang together with it."""

    def of_bucket(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        key = np.concatenate([from_low_bytes(r[2], 4) for r in rows])
        counts = [len(r[4]) // 8 for r in rows]
        base = np.cumsum(counts) - counts
        vertex = np.concatenate([np.frombuffer(r[3], "<u4").astype(np.int64) + b for r, b in zip(rows, base.tolist(), strict=True)])
        rep, size = (np.concatenate([np.frombuffer(r[i], "<i8") for r in rows]) for i in (4, 5))
        points = np.concatenate([np.frombuffer(r[6], np.uint8).reshape(-1, DIMENSIONS) for r in rows])
        # Shingles of one vertex only are no use; most of what was counted twice by a chance collision ends here.
        order = np.argsort(key, kind="stable")
        key, vertex = key[order], vertex[order]
        again = np.zeros(len(key), bool)
        again[1:] = key[1:] == key[:-1]
        again[:-1] |= again[1:]
        a, b = PrefixTree(key[again], vertex[again], size, counts_of(points), num, den).join()
        return stars(rep[a], rep[b])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [of_bucket(rows) for rows in runs(batches)]
        if parts:
            x, y = stars(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return to_buckets(sent, partitions, task, "a long, b long")


def _texts(joined: DataFrame) -> DataFrame:
    """(comp, parts, rep, text) of the wanted documents of each chunk."""
    schema = "comp long, parts long, rep long, text binary"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lengths, text, wanted in rows_of(batches):
            _, lengths, raw = unpack(ids, lengths, text)
            data, ends = raw.tobytes(), np.cumsum(lengths)
            yield batch_of(schema, [(w["comp"], w["parts"], w["rep"], data[ends[w["place"]] - lengths[w["place"]] : ends[w["place"]]]) for w in wanted])

    return joined.mapInArrow(task, schema)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest node of its component, by repeated minimum and shortcut."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def _verify(rows: DataFrame, words: int, num: int, den: int, partitions: int) -> DataFrame:
    """Links (a, b) within each group. rows: grp (any sortable columns as one string), rep, root, text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for rows_ in runs(batches):
            if len(rows_) < 2:
                continue
            reps = np.array([r[1] for r in rows_], np.int64)
            starts = np.unique(np.array([r[2] for r in rows_], np.int64), return_inverse=True)[1]
            roots = link([shingles(r[3]) for r in rows_], starts, num, den)
            order = np.lexsort((reps, roots))
            first = np.append(True, roots[order][1:] != roots[order][:-1])
            heads = reps[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
            moved = reps[order] != heads
            if moved.any():
                yield pa.RecordBatch.from_arrays([pa.array(reps[order][moved]), pa.array(heads[moved])], names=["a", "b"])

    sent = rows.select("grp", "rep", "root", "text").repartition(partitions, "grp").sortWithinPartitions("grp")
    return sent.mapInArrow(task, "a long, b long")


def _parts(weights: Column, count: Column, group: int) -> Column:
    """Into how many groups sets are cut, by their number and by their shingles."""
    return F.greatest(F.ceil(count / group), F.ceil(weights / GROUP_SHINGLES), F.lit(1)).cast("long")


def _large(rows: DataFrame, sizes: DataFrame, words: int, num: int, den: int, group: int, partitions: int) -> DataFrame:
    """Links within candidates of more than one group. rows: comp, parts, rep, text; sizes: rep, n."""
    rows = materialise(rows.join(sizes, "rep"), "large-candidates")
    links = None
    labels = rows.select("comp", F.col("rep").alias("node"), F.col("rep").alias("root"), "n")
    active = rows.select("comp", "parts", "rep", "text", F.col("rep").alias("root"))

    def merged() -> DataFrame:
        found = components(links)
        return materialise(rows.select("comp", "rep", "n").join(found, F.col("rep") == F.col("node"), "left").select("comp", F.col("rep").alias("node"), F.coalesce("component", "rep").alias("root"), "n"), "labels")

    for turn in range(3):  # clusters meet through their first members, dealt out anew each turn
        grp = F.concat_ws(":", "comp", F.pmod(F.xxhash64("rep", F.lit(turn)), "parts"))
        found = materialise(_verify(active.withColumn("grp", grp), words, num, den, partitions), "links")
        links = found if links is None else materialise(links.unionByName(found), "links")
        labels = merged()
        heads = labels.where("node = root").groupBy("comp").agg(_parts(F.sum("n"), F.count(F.lit(1)), group).alias("parts"), F.count(F.lit(1)).alias("left")).where("left > 1").drop("left")
        if heads.isEmpty():
            return links
        active = rows.drop("parts").join(labels.where("node = root").select(F.col("node").alias("rep"), "root"), "rep").join(heads, "comp")
    # Completion: sets outside a candidate's largest cluster meet everything, block against block.
    clusters = labels.groupBy("comp", "root").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("weight"))
    largest = clusters.groupBy("comp").agg(F.max(F.struct("count", "weight", "root")).alias("m"), F.sum("count").alias("count"), F.sum("weight").alias("weight")).where(F.col("count") > F.col("m.count"))
    largest = largest.select("comp", F.col("m.root").alias("main"), _parts(F.col("m.weight"), F.col("m.count"), group).alias("main_parts"), _parts(F.col("weight") - F.col("m.weight"), F.col("count") - F.col("m.count"), group).alias("parts"))
    full = rows.drop("parts").join(labels.select(F.col("node").alias("rep"), "root"), "rep").join(largest, "comp")
    within = F.col("root") == F.col("main")
    block = F.pmod(F.xxhash64("rep"), F.when(within, F.col("main_parts")).otherwise(F.col("parts")))
    full = full.withColumn("block", block)
    main_rows = full.where(within).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("grp", F.concat_ws(":", "comp", F.lit("m"), "block", "other"))
    rest = full.where(~within)
    against = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("main_parts") - 1))).withColumn("grp", F.concat_ws(":", "comp", F.lit("m"), "other", "block"))
    among = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("grp", F.concat_ws(":", "comp", F.lit("r"), F.least("block", "other"), F.greatest("block", "other")))
    cols = ["grp", "rep", "root", "text"]
    found = _verify(main_rows.select(cols).unionByName(against.select(cols)).unionByName(among.select(cols)), words, num, den, partitions)
    return links.unionByName(found)


def _vertices(whole: DataFrame) -> DataFrame:
    """(sig, size, n, first_id, rep, chunk, place): equal sets once. rep is the smallest doc_id; of different sets with one
    smallest doc_id all but one have a hash instead."""
    heads = whole.groupBy("sig").agg(F.min(F.struct("doc_id", "chunk", "place")).alias("head"), F.first("n").alias("n"), F.count(F.lit(1)).alias("size"))
    heads = materialise(heads.select("sig", "size", "n", F.col("head.doc_id").alias("first_id"), F.col("head.chunk").alias("chunk"), F.col("head.place").alias("place")), "heads")
    twice = materialise(heads.groupBy("first_id").agg(F.count(F.lit(1)).alias("count"), F.min("sig").alias("own")).where("count > 1").drop("count"), "repeated-ids")
    if twice.isEmpty():
        return heads.withColumn("rep", F.col("first_id"))
    other = F.xxhash64("sig", "first_id").bitwiseOR(1 << 62).bitwiseAND((1 << 63) - 1)
    rep = F.when(F.col("own").isNull() | (F.col("own") == F.col("sig")), F.col("first_id")).otherwise(other)
    return materialise(heads.join(twice, "first_id", "left").withColumn("rep", rep).drop("own"), "heads")


def clusters(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, component (names its cluster alone; null for an empty set) and tkey (md5 of the text) of every row."""
    rows = with_ids(docs, id_col, text_col)
    sizes = plan(rows)
    partitions, buckets = sizes.partitions, sizes.buckets
    chunks = build(rows, partitions, chunk_bytes or sizes.chunk_bytes, _describe(words), ", ns binary, sigs binary, tkeys binary")
    sets = materialise(_sets(chunks), "sets")
    whole = sets.where("n > 0")
    heads = _vertices(whole)
    # One row of places per chunk: as many numbers as the chunk has documents.
    places = heads.groupBy("chunk").agg(F.collect_list(F.struct("place", "rep")).alias("places"))
    joined = chunks.join(places.hint("merge"), "chunk").select("chunk", "ids", "lengths", "text", "places")
    ranks = _rarity(_send_shingles(joined, buckets, words), partitions)
    ranks = materialise(ranks.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "ranks")).alias("ranks")), "ranks")
    ranked = joined.join(ranks.hint("merge"), "chunk").select("chunk", "ids", "lengths", "text", "places", "ranks")
    coarse = materialise(components(_candidates(_send_prefixes(ranked, buckets, words, num, den), partitions, num, den)), "coarse")
    coarse = materialise(coarse.join(heads.select(F.col("rep").alias("node"), "n", "chunk", "place"), "node"), "coarse-vertices")
    counted = materialise(coarse.groupBy("component").agg(_parts(F.sum("n"), F.count(F.lit(1)), group).alias("parts")), "coarse-sizes")
    wanted = coarse.join(counted, "component").groupBy("chunk").agg(F.collect_list(F.struct("place", F.col("component").alias("comp"), "parts", F.col("node").alias("rep"))).alias("wanted"))
    texts = materialise(_texts(chunks.join(wanted.hint("merge"), "chunk").select("ids", "lengths", "text", "wanted")), "candidates")
    small = texts.where("parts = 1").select(F.col("comp").cast("string").alias("grp"), "rep", F.monotonically_increasing_id().alias("root"), "text")
    links = materialise(_verify(small, words, num, den, partitions), "links")
    if not counted.where("parts > 1").isEmpty():
        links = links.unionByName(_large(texts.where("parts > 1"), coarse.select(F.col("node").alias("rep"), "n"), words, num, den, group, partitions))
    labels = materialise(components(links), "components")
    linked = heads.select("sig", "rep", "size", "first_id").join(labels, F.col("rep") == F.col("node"), "left").select("sig", "size", "first_id", F.coalesce("component", "rep").alias("component"))
    linked = materialise(linked, "linked")
    # A component has as many rows here as it has different sets; they are counted before they move.
    named = linked.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    named = materialise(named, "names")
    total = linked.count()
    named = materialise(join_groups(linked, named, "component", "members", total).select("sig", "size", "component", "component_id"), "named")
    out = join_groups(whole.select("doc_id", "n", "sig", "tkey"), named, "sig", "size", sets.count()).select("doc_id", "n", "component_id", "component", "tkey")
    out = out.unionByName(sets.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"), "tkey"))
    real = lambda c: F.when(F.col(c) != NONE, F.col(c)).alias(c)
    return out.select(real("doc_id"), F.col("n").alias("n_shingles"), real("component_id"), "component", "tkey")


def similar(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; options as of clusters()."""
    return clusters(docs, **options).drop("component", "tkey")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest doc_id, of several texts of that id
    the one with the least md5, of equal rows one. Documents without words all stay."""
    found = materialise(clusters(docs).where("doc_id <=> component_id").select("doc_id", "component", "tkey"), "first-documents")
    heads = found.where("component is not null").groupBy("component").agg(F.min("tkey").alias("k_text"), F.first("doc_id").alias("k_id")).select("k_id", "k_text")
    kept = materialise(heads, "kept")
    blank = materialise(found.where("component is null").select(F.col("doc_id").alias("k_id"), F.col("tkey").alias("k_text")).distinct(), "kept-blank")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")))).alias("tkey"))
    same = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("tkey") == F.col("k_text"))
    first = rows.join(kept.hint("merge"), same, "left_semi")
    copies = found.where("component is not null").groupBy(F.col("doc_id").alias("k_id"), F.col("tkey").alias("k_text")).count().where("count > 1").drop("count")
    out = one_row_each(first, materialise(copies, "repeated-rows"), same, ["id", "tkey"], docs.schema)
    if not blank.isEmpty():
        out = out.unionByName(rows.join(blank.hint("merge"), same, "left_semi"))
    return out.select("row.*")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))


QUERIES = {"op10_jaccard": op10_jaccard}
#: All pairs of texts with a shingle in common, and what is reachable from each text.
ORACLE = {
    "op10_jaccard": r"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT k, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS x FROM d),
        n AS MATERIALIZED (SELECT k, count(*) AS n FROM s GROUP BY k),
        i AS (SELECT a.k AS a, b.k AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.k < b.k GROUP BY 1, 2),
        e AS MATERIALIZED (SELECT a, b FROM i JOIN n p ON p.k = a JOIN n q ON q.k = b WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
        z AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r(k, other) AS (SELECT k, k FROM d UNION SELECT r.k, z.b FROM r JOIN z ON r.other = z.a),
        c AS (SELECT r.k, min(o.doc_id) AS least, count(*) FILTER (o.doc_id IS NULL) AS unnamed FROM r JOIN d o ON r.other = o.k GROUP BY r.k)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, CASE WHEN unnamed = 0 THEN least END AS component_id FROM d JOIN c ON d.k = c.k LEFT JOIN n ON d.k = n.k
    """
}
