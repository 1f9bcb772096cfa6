import re
from collections import defaultdict

import pytest

from pairloom.llm import line_dedup as L
from tests.llm import corpus


def brute(rows, min_docs, similarity):
    """The same tree, one line at a time."""
    lines = []
    for i, (d, text) in enumerate(rows):
        for place, line in enumerate((text or "").split("\n")):
            plain = line.replace("\t", " ").replace("\r", " ").strip(" ")
            if plain:
                t = [L.WILDCARD if re.search("[0-9]", x) else x for x in plain.split(" ")]
                lines.append(((d, text or ""), i, place, (len(t), tuple(t[:3])), tuple(t)))
    in_leaf = defaultdict(set)
    for doc, _, _, leaf, _ in lines:
        in_leaf[leaf].add(doc)
    support, pairs = defaultdict(int), {(doc, leaf, t) for doc, _, _, leaf, t in lines}
    for _, leaf, t in pairs:
        for at, token in enumerate(t):
            support[leaf, at, token] += 1
    docs, template = defaultdict(set), {}
    for doc, _, _, leaf, t in lines:
        stays = [support[leaf, at, x] >= min_docs and x != L.WILDCARD for at, x in enumerate(t)]
        if len(in_leaf[leaf]) >= min_docs and sum(stays) >= similarity * len(t):
            template[leaf, t] = (leaf, tuple(x if s else L.WILDCARD for x, s in zip(t, stays, strict=True)))
            docs[template[leaf, t]].add(doc)
    gone = {(i, place) for _, i, place, leaf, t in lines if len(docs.get(template.get((leaf, t)), ())) >= min_docs}
    out = []
    for i, (d, text) in enumerate(rows):
        all_ = (text or "").split("\n")
        out.append((d, len(all_), sum((i, k) in gone for k in range(len(all_))), "\n".join(x for k, x in enumerate(all_) if (i, k) not in gone)))
    return out


def logs():
    out = []
    for i in range(30):
        own = f"document {chr(97 + i % 26)} tells its own story with words like w{chr(97 + i)}x and q{chr(97 + i)}z\n"
        out.append((i, own + f"user u{i} logged in from host alpha at 10:0{i % 10}\r\n\n" + (f"please read our terms of {'abcdefgh'[i % 8] * 3} service\n" if i % 2 else "") + "one two three four"[: 3 + i % 4]))
    return [*out, (5, out[5][1]), (None, out[7][1]), (40, None), (41, ""), (42, "\n\n"), (43, "  \t\n12 34 56\n12 34 57")]


@pytest.mark.parametrize(("min_docs", "similarity"), [(5, 0.7), (2, 0.5), (3, 1.0), (100, 0.7)])
def test_brute_force(spark, min_docs, similarity):
    rows = logs() + [(1000 + r[0], r[1]) for r in corpus.rows(60)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, leaf string, h int")
    got = L.deduplicate(df, min_docs, similarity).collect()
    assert sorted(map(str, brute(rows, min_docs, similarity))) == sorted(str(tuple(r)) for r in got)


def test_variable_fields_generalise(spark):
    df = spark.createDataFrame(logs(), "doc_id long, text string")
    rows = df.selectExpr("doc_id as id", "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h")
    found = {r.template for r in L.dropped_lines(rows).select("template").distinct().collect()}
    assert "user <*> logged in from host alpha at <*>" in found and "please read our terms of <*> service" in found
    assert not any(t.startswith("document") and "story" in t and "<*>" not in t for t in found)


def test_empty(spark):
    assert L.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_tokens_take_one_pass(spark):
    """A token without a digit is not searched again from each of its characters."""
    import time

    long = [(i, f"{'x' * 2_000_000} {'é' * 100_000}1 tail\n{' ' * 1_000_000}\n{'word ' * 200_000}", "", "", 0) for i in range(6)]
    began = time.time()
    got = L.deduplicate(corpus.frame(spark, long)).select("doc_id", "n_lines", "n_dropped").collect()
    assert time.time() - began < 60
    assert sorted((r.doc_id, r.n_lines) for r in got) == [(i, 3) for i in range(6)]
    clash = corpus.frame(spark, corpus.rows(20)).selectExpr("*", "1 as id", "2 as h", "3 as key", "4 as leaf", "5 as gone", "6 as place")
    assert L.deduplicate(clash).count() == len(corpus.rows(20)) and L.deduplicate(corpus.frame(spark, [])).count() == 0
