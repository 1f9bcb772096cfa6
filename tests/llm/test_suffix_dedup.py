import numpy as np
import pytest

from pairloom.llm import suffix_dedup as S
from tests.llm import brute, corpus


@pytest.mark.parametrize("chunk", [1 << 20, 3000, 1])
def test_brute_force(spark, chunk):
    rows = corpus.rows()
    got = {tuple(r)[:5] for r in S.deduplicate(corpus.frame(spark), chunk_bytes=chunk).collect()}
    assert got == set(brute.substring_dedup([r[:2] for r in rows]))


def test_edges(spark):
    assert S.deduplicate(corpus.frame(spark, [])).count() == 0
    t = "the quick brown fox jumps over the lazy dog and then some more"
    rows = [(5, t, "", "", 0), (5, t, "", "", 0), (None, t, "", "", 0), (7, None, "", "", 0)]
    got = sorted((str(r.doc_id), r.n_removed, r.n_spans) for r in S.deduplicate(corpus.frame(spark, rows).selectExpr("*", "1 as chunk", "2 as bucket")).collect())
    assert got == [("5", len(t), 1), ("5", len(t), 1), ("7", 0, 0), ("None", 0, 0)]


def slices_of(seed=2):
    rng = np.random.default_rng(seed)
    out = [bytes(rng.choice(list(b"ab"), rng.integers(50, 81)).astype(np.uint8)) for _ in range(40)] + [b"a" * 80, b"a" * 70, b"ab" * 35, b"\0" * 60, b"\0" * 59 + b"a"]
    same = b"forty bytes that every one of these has in common, here"[:44]
    return out + [same + bytes([98 + i % 4]) * 20 for i in range(24)]


def block(slices, bucket):
    text = np.frombuffer(b"".join(slices), np.uint8)
    return text, np.array([len(s) for s in slices]), S.BlockSuffixes(text, np.array([len(s) for s in slices]), bucket=bucket)


@pytest.mark.parametrize("bucket", [1 << 16, 40, 7])
def test_suffix_order(bucket):
    """Buckets of prefix ranges, one after the other, make up the sorted suffixes; classes are the equal strings."""
    slices = slices_of()
    text, lengths, found = block(slices, bucket)
    ends = np.cumsum(lengths)
    suffix = lambda i: bytes(text[found.at[i] : ends[found.slice[i]]])
    order, kinds = (np.concatenate(x) for x in zip(*found.classes(), strict=True))
    got = [suffix(i) for i in order]
    assert got == sorted(got) and sorted(got) == sorted(s[i:] for s in slices for i in range(len(s) - 49))
    assert len(found.splitters) >= (1 if bucket < 100 else 0)
    names = {}
    assert all(names.setdefault(s[:50], k) == k for s, k in zip(got, kinds, strict=True)) and len(set(names.values())) == len(names)


@pytest.mark.parametrize("bucket", [1 << 16, 40, 7])
def test_owners(bucket):
    slices = slices_of(3)
    text, lengths, _ = block(slices, bucket)
    docs = np.random.default_rng(0).integers(-5, 50, len(slices))
    which, least = S.owners(text, lengths, docs, bucket=bucket)
    want = {}
    for d, s in zip(docs.tolist(), slices, strict=True):
        for i in range(len(s) - 49):
            want[s[i : i + 50]] = min(d, want.get(s[i : i + 50], d))
    assert least.tolist() == [want[s[i : i + 50]] for s in slices for i in range(len(s) - 49)]


def test_long_ties_need_the_ranks(monkeypatch):
    """Without the cover's ranks, strings that tie on the sorted bytes stay mixed and repeats are missed."""
    slices = slices_of()
    text, lengths, _ = block(slices, 1 << 16)
    docs = np.arange(len(slices))
    keys, sizes = np.zeros(len(slices), np.uint64), lengths
    right = S.masks(keys, docs, sizes, text)
    monkeypatch.setattr(S.CoverRanks, "of", lambda self, at, shift: np.zeros(len(at), np.int32))
    assert (S.masks(keys, docs, sizes, text) != right).any()


def test_equal_hashes_do_not_make_equal_slices(monkeypatch):
    monkeypatch.setattr(S, "mix64", lambda x: x * np.uint64(0))
    slices = slices_of()
    text, lengths, _ = block(slices, 1 << 16)
    docs = np.arange(len(slices))
    least = {}
    for d, s in enumerate(slices):
        for i in range(len(s) - 49):
            least.setdefault(s[i : i + 50], d)
    want = [sum((least[s[i : i + 50]] < d) << i for i in range(len(s) - 49)) for d, s in enumerate(slices)]
    assert S.masks(np.zeros(len(slices), np.uint64), docs, lengths, text).tolist() == want


def test_long_texts_and_names(spark):
    passage = "a passage of more than fifty bytes that the long texts share with a short one. "
    rows = [(1, passage, "", "", 0), (2, "z" * 3_000_000 + passage, "", "", 0), (3, " " * 3_000_000, "", "", 0), (4, passage * 20_000, "", "", 0)]
    docs = corpus.frame(spark, rows).selectExpr("*", "1 as chunk", "2 as bucket", "3 as names", "4 as spans", "5 as ids", "6 as lengths", "7 as masks", "8 as kept")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in S.deduplicate(docs).collect()}
    n = len(passage)
    assert got[1] == (n, 0, 0) and got[2] == (3_000_000 + n, n, 1) and got[3] == (3_000_000, 0, 0) and got[4][1] == 20_000 * n


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_table_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in S.op9_suffix_dedup(spark, f"/root/testdata/{sf}").collect()}
    assert got == set(brute.substring_dedup(rows))


def test_cover():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))
