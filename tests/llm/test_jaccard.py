import numpy as np
import pytest

from pairloom.llm import jaccard as J
from pairloom.llm.graph import components
from tests.llm import brute, corpus


@pytest.mark.parametrize(("group", "chunk"), [(4000, 1 << 20), (3, 2000)])
def test_brute_force(spark, group, chunk):
    rows = corpus.rows()
    got = {tuple(r) for r in J.similar(corpus.frame(spark), group=group, chunk_bytes=chunk).collect()}
    assert got == brute.jaccard_components([r[:2] for r in rows])


def test_edges(spark):
    assert J.similar(corpus.frame(spark, [])).count() == 0
    rows = [(None, "a b c d e f", "en", "s", 1), (3, "a b c d e f", "en", "s", 1), (4, None, "en", "s", 1), (4, None, "en", "s", 1), (5, "A B\tC", None, None, None), (6, "a b c", None, None, None)]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.similar(corpus.frame(spark, rows).selectExpr("*", "1 as rep", "2 as n")).collect())
    assert got == [("3", 2, "None"), ("4", 0, "4"), ("4", 0, "4"), ("5", 1, "5"), ("6", 1, "5"), ("None", 2, "None")]


def test_tree_bound_loses_nothing():
    rng = np.random.default_rng(0)
    base = [np.unique(rng.integers(0, 1 << 63, 200).astype(np.uint64)) for _ in range(30)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) > x], rng.integers(0, 1 << 63, 10).astype(np.uint64)])) for b in base for x in (0.0, 0.05, 0.1, 0.2)]
    tree, own = J.CountTree(sets), J.Clusters(np.arange(len(sets)))
    for i in range(len(sets)):
        found = {j for part in tree.search(i, own, 75, 100) for j in part.tolist()}
        for j in range(len(sets)):
            common = J.overlap(sets[i], sets[j])
            if tree.place[j] > tree.place[i] and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                assert j in found


def near(seed=0, kinds=30):
    rng = np.random.default_rng(seed)
    base = [np.unique(rng.integers(0, 1 << 63, int(rng.integers(20, 400))).astype(np.uint64)) for _ in range(kinds)]
    return [np.unique(np.concatenate([b[rng.random(len(b)) > x], rng.integers(0, 1 << 63, 8).astype(np.uint64)])) for b in base for x in (0.0, 0.03, 0.05, 0.1, 0.2)]


def linked(x, y):
    common = J.overlap(x, y)
    return 100 * common >= 75 * (len(x) + len(y) - common)


def tree_of(sets, keys):
    """All sets as points under each of their keys."""
    vertex = np.repeat(np.arange(len(sets)), [len(k) for k in keys])
    return J.PrefixTree(np.concatenate(keys), vertex, np.array([len(x) for x in sets]), J.counts_of(np.stack([J.point(x) for x in sets])))


def together(n, edges):
    root = list(range(n))
    for a, b in zip(*(e.tolist() for e in edges), strict=True):
        ra, rb = root[a], root[b]
        root = [min(ra, rb) if r in (ra, rb) else r for r in root]
    return root


def test_prefix_tree_loses_no_link():
    sets = near()
    whole = [np.zeros(1, np.uint64) for _ in sets]  # one shingle for all: nodes and levels decide
    root = together(len(sets), tree_of(sets, whole).join())
    for i, x in enumerate(sets):
        for j in range(i):
            assert not linked(x, sets[j]) or root[i] == root[j]
    assert len(set(root)) >= 10  # and the bound keeps most strangers apart


def test_prefix_tree_decides(monkeypatch):
    """Without the summed minima everything under a shingle hangs together, so it is the tree that prunes."""
    sets = [x[:100] for x in near(1) if len(x) >= 100]
    whole = [np.zeros(1, np.uint64) for _ in sets]
    kept = len(set(together(len(sets), tree_of(sets, whole).join())))
    tree = tree_of(sets, whole)
    tree.counts = np.full_like(tree.counts, 1 << 20)
    assert len(set(together(len(sets), tree.join()))) == 1 < kept


def test_copies_under_a_hot_shingle_are_not_paired(monkeypatch):
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    sets = [np.unique(np.append(base[rng.random(len(base)) > 0.01], rng.integers(0, 1 << 63, 2).astype(np.uint64))) for _ in range(3000)]
    tree = tree_of(sets, [np.zeros(1, np.uint64) for _ in sets])
    seen = []
    fits = J.PrefixTree.fits
    monkeypatch.setattr(J.PrefixTree, "fits", lambda self, *x: (seen.append(len(x[0])), fits(self, *x))[1])
    assert len(set(together(1, (np.zeros(0, int),) * 2) + J.stars(*tree.join())[1].tolist())) == 1
    assert sum(seen) < 20 * len(sets)


def test_points_bound_counts():
    for n in (0, 1, 191, 192, 193, 1000, 54_321, 3_000_000):
        found = np.full(n, 256, np.uint64)
        assert J.counts_of(J.point(found))[1] >= n and J.counts_of(J.point(found))[0] == 0


def test_word_hashes_are_no_polynomial():
    """Two texts whose polynomial hashes modulo 2**64 are equal have different shingles."""
    thue, morse = "a", "b"
    for _ in range(11):
        thue, morse = thue + morse, morse + thue
    shingles = J.Shingler()
    assert not set(shingles(f"{thue} b c d e".encode()).tolist()) & set(shingles(f"{morse} b c d e".encode()).tolist())
    words = [f"w{i}" for i in range(40)]
    got = shingles(" ".join(words + words).encode())
    assert len(got) == 40 and len(shingles(b"a b")) == 1 and shingles(b"a b").tolist() != shingles(b"b a").tolist()


def test_repeated_ids_are_apart(spark):
    """Of one id's texts only the similar one hangs together with another document, and keep_one loses no other text."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, a + " more", "x", "", 0), (5, a, "y", "", 0), (5, b, "z", "", 0), (9, b, "v", "", 0), (5, None, "n", "", 0), (5, "", "m", "", 0), (3, a + " more", "u", "", 0)]
    docs = corpus.frame(spark, rows).selectExpr("*", "1 as row", "2 as id", "3 as k_id", "4 as tkey", "5 as component", "6 as _id")
    got = sorted((r.doc_id, r.component_id, r.n_shingles) for r in J.similar(docs).collect())
    assert got == [(3, 3, 57), (3, 3, 57), (5, 3, 56), (5, 5, 0), (5, 5, 0), (5, 5, 56), (9, 5, 56)]
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.lang) for r in kept.collect()) == [(3, "u"), (5, "m"), (5, "n"), (5, "z")]


def test_long_texts(spark):
    words = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, words, "", "", 0), (2, words + " end", "", "", 0), (3, " " * 5_000_000, "", "", 0), (4, "x" * 5_000_000, "", "", 0), (5, "same word " * 200_000, "", "", 0)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similar(corpus.frame(spark, rows)).collect()}
    assert got == {1: (299_996, 1), 2: (299_997, 1), 3: (0, 3), 4: (1, 4), 5: (2, 5)}


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_table_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in J.op10_jaccard(spark, f"/root/testdata/{sf}").collect()} == brute.jaccard_components(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (103, 101), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 103: 100}
