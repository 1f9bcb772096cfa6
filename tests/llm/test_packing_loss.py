from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pairloom.llm import packing as P


def test_loss_limit_through_spark(spark):
    turns = []
    for c in range(60):
        turns += [(c, 0, "user", "short é question " * (1 + c % 9)), (c, 1, "assistant", "a long answer of words " * (2 + c % 7)), (c, 2, "user", None), (c, 3, "assistant", f"end {c}")]
    docs = P.from_turns(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"))
    rows = {r.doc_id: r for r in docs.collect()}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    masks = {}
    for d, r in rows.items():
        assert [r.text[s.start : s.stop] for s in r.spans] == [t[3] for t in turns if t[0] == d and t[2] == "assistant"]
        inside = [any(s.start <= a < s.stop for s in r.spans) for a, _ in tok.encode(r.text, add_special_tokens=False).offsets]
        masks[d] = np.array([*inside, True], int)
    limits = P.Limits(128, 64, 40)
    use = lambda got: [sum(x) for x in loads(got, masks).values()]
    assert max(use(P.pack(docs.coalesce(1), limits, loss_col="spans").collect())) <= 40
    plain = loads(P.pack(docs.coalesce(1), limits).collect(), masks)
    masked = loads(P.pack(docs.coalesce(1), limits, loss_col="spans").collect(), masks)
    assert len(masked) < len(plain)  # prompt tokens no longer use up the loss limit


def loads(pieces, masks):
    out, seen = defaultdict(list), defaultdict(int)
    for r in pieces:
        assert r.doc_tokens == len(masks[r.doc_id])
        out[r.sequence_id].append(int(masks[r.doc_id][r.start : r.start + r.length].sum()))
        seen[r.doc_id] += r.length
    assert seen == {d: len(m) for d, m in masks.items()}
    return out
