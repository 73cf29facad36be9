import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from stockroom.llm import packing as P
from stockroom.llm.queries import op8_packing
from texts import MEDIUM, docs_frame, table_rows


def check(pieces, rows, window=P.WINDOW):
    """Every id in one piece, sequences gapless and within the window, checksums of the tokenizer's own ids."""
    tok = Tokenizer.from_file(public_tokenizers.path(P.VOCABULARY))
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [P.END_ID] for i, t in rows}
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(ids)
    for i, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[i])
            part = np.array(ids[i][at:at + p.length], "<u4")
            assert p.ids_crc32 == zlib.crc32(part.tobytes())
            at += p.length
        assert at == len(ids[i])
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    total = sum(map(len, ids.values()))
    return len(by_seq) * window / max(total, 1) - 1


def test_the_table_with_little_padding(spark):
    assert check(op8_packing(spark, MEDIUM).collect(), table_rows(MEDIUM)) < 0.01


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "x " * 3000), (4, "<|endoftext|> a<|endoftext|>"),
            (5, "a" * 30_000), (6, "é​ \n\n  \t漢字")]
    got = P.pack(docs_frame(spark, rows)).collect()
    check(got, rows)
    assert all(len(p.ids) == p.length for p in got)
    assert P.pack(docs_frame(spark, [])).count() == 0
    twice = P.pack(docs_frame(spark, [(1, "a b c")] * 2)).collect()
    assert len(twice) == 2


def plain_differencing(sizes, k):
    """Differencing with full vectors, as it is defined."""
    parts = [[[s]] + [[] for _ in range(k - 1)] for s in sizes]
    spread = lambda p: max(map(sum, p)) - min(map(sum, p))
    while len(parts) > 1:
        parts.sort(key=spread)
        a, b = sorted(parts.pop(), key=sum), sorted(parts.pop(), key=sum, reverse=True)
        parts.append([x + y for x, y in zip(a, b)])
    return sorted(sum(x) for x in parts[0])


def test_differencing():
    assert P.divide([], 10) == []
    r = random.Random(1)
    for _ in range(50):
        k = r.randrange(1, 7)
        sizes = random.Random(r.random()).sample(range(1, 4000), r.randrange(1, 30))
        groups = P.difference(sizes, k)
        assert sorted(i for g in groups for i in g) == list(range(len(sizes)))
        assert len(groups) <= k
        sums = sorted([sum(sizes[i] for i in g) for g in groups] + [0] * (k - len(groups)))
        want = plain_differencing(sizes, k)
        assert sums[-1] - sums[0] <= 1.3 * (want[-1] - want[0]) + 60
        for g in P.divide([min(s, 512) for s in sizes], 512):
            assert sum(min(sizes[i], 512) for i in g) <= 512
    # two windows can't hold these: the count rises
    assert len(P.divide([4, 4, 4], 6)) == 3


def test_same_ids_as_the_tokenizer():
    tok = Tokenizer.from_file(public_tokenizers.path(P.VOCABULARY))
    for t in ("It's  a\n\n test…", "naïve 漢字 😀 x1y2", "a  b", " " * 50, "<|endoftext|>", "'ll 'LL ' s"):
        assert P.encode(t, public_tokenizers.path(P.VOCABULARY), public_tokenizers.path(P.RANKS)).tolist() == tok.encode(
            t, add_special_tokens=False).ids
