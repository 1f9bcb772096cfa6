import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairloom.llm import packing as P
from tests.llm import corpus

TOK = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENC = P.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})
RUNS = [" ", "\n", "\r\n", "\t ", "　", "a", "Z9", "1", "!", "é", "\x1c", "\x85 "]


@pytest.mark.parametrize("run", RUNS)
@pytest.mark.parametrize("around", [("", ""), ("x", "y"), ("x ", " y"), ("1", "<|endoftext|>"), ("<|endoftext|>", "!")])
def test_long_runs_have_the_files_ids(run, around):
    text = around[0] + run * 30_000 + around[1]
    assert P.encode(ENC, text) == TOK.encode(text, add_special_tokens=False).ids


@given(st.lists(st.sampled_from([" " * 5000, "\n" * 6000, " " * 4999, "a", " b", " ", "<|endoftext|>", "'s", "7"]), max_size=8))
@settings(max_examples=60, deadline=None)
def test_mixed_runs(parts):
    text = "".join(parts)
    assert P.encode(ENC, text) == TOK.encode(text, add_special_tokens=False).ids


def test_long_texts_through_spark(spark):
    rows = [(1, " " * 1_000_000, "", "", 0), (2, "x" + " " * 2_000_000 + "y", "", "", 0), (3, "ab " * 300_000, "", "", 0)]
    docs = corpus.frame(spark, rows).selectExpr("*", "1 as start", "2 as length", "3 as spans", "4 as sequence_id", "5 as offset")
    got = P.pack(docs).groupBy("doc_id", "doc_tokens").sum("length").collect()
    assert {r.doc_id: r.doc_tokens for r in got} == {i: len(TOK.encode(t, add_special_tokens=False).ids) + 1 for i, t, *_ in rows}
    assert all(r[1] == r[2] for r in got)
