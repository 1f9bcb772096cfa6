import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairloom.llm import packing as P
from tests.llm import corpus


def test_pieces(spark):
    rows = [*corpus.rows(), (5000, "two <|endoftext|> texts", "", "", 0), (5001, "word " * 3000, "", "", 0), (None, "null id", "", "", 0)]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r[0]: np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4") for r in rows}
    got = P.pack(corpus.frame(spark, rows).coalesce(2)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for d, ps in pieces.items():
        at = 0
        for r in sorted(ps, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want[d]) and r.ids_crc32 == zlib.crc32(want[d][at : at + r.length].tobytes())
            at += r.length
        assert at == len(want[d])
    fills = []
    for ps in sequences.values():
        at = 0
        for r in sorted(ps, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        fills.append(at)
    assert sum(f < 1024 for f in fills) <= 2


def test_pool_overflow_keeps_sequences_apart():
    packer = P.Packer(P.Limits(16, 8, 16), pool=4)
    for k in range(200):
        packer.add(k, np.arange(1 + k * 7 % 40, dtype=np.uint32))
    packer.close()
    fill = defaultdict(list)
    for _, _, n, _, _, sequence, offset in packer.take():
        fill[sequence].append((offset, n))
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 16


def test_empty(spark):
    assert P.pack(corpus.frame(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 9)), max_size=60), st.integers(8, 20), st.integers(1, 6), st.integers(3, 20), st.integers(1, 30))
def test_limits(items, tokens, segments, loss, pool):
    """All three limits hold, and every id lies in one piece."""
    packer = P.Packer(P.Limits(tokens, segments, loss), pool=pool)
    masks = {}
    for k, (n, every) in enumerate(items):
        masks[k] = (np.arange(n) % (every + 1) == 0).astype(np.int64)
        packer.add(k, np.arange(n, dtype=np.uint32), masks[k])
    packer.close()
    use, covered = defaultdict(list), defaultdict(list)
    for key, start, n, _, _, sequence, offset in packer.take():
        use[sequence].append((offset, n, int(masks[key][start : start + n].sum())))
        covered[key].append((start, n))
    for k, (n, _) in enumerate(items):
        at = 0
        for start, size in sorted(covered[k]):
            assert start == at and size > 0
            at += size
        assert at == n
    for parts in use.values():
        at = 0
        for offset, n, _ in sorted(parts):
            assert offset == at
            at += n
        assert at <= tokens and len(parts) <= segments and sum(x[2] for x in parts) <= loss


