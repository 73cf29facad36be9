import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece

from stockroom.llm import piece_match as M
from stockroom.llm.queries import op10_piece_match
from texts import SMALL, docs_frame, table_rows

PATH = public_tokenizers.path(M.MODEL)


def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_query_equals_the_library_on_the_table(spark):
    sp, texts = library(), dict(table_rows(SMALL))
    for r in op10_piece_match(spark, SMALL).collect():
        ids = sp.encode(texts[r.doc_id])
        assert r.n_ids == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_any_text_encodes_as_in_the_library():
    sp, p, r = library(), M.Pieces(PATH), random.Random(1)
    parts = ["a", " ", "  ", "\n", "the", "ing", "é", "漢字", "😀", "\x00", "　", "1", "!!", "ß", "\U0010ffff", "_", "<s>"]
    texts = ["", " ", "\n", "a" * 3000, "<unk></s><0x41>", "é" * 300 + " " * 100, "\r\n\t", "x" * 49 + " " + "y" * 48]
    texts += ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(400)]
    for lot in (texts, texts[::-1], texts[:3]):
        got = [np.frombuffer(x, "<i4").tolist() for x in p.encode(lot)]
        assert got == sp.encode(lot)
        assert [p.decode(x) for x in got] == lot
    assert np.frombuffer(p.encode(["a▁b"])[0], "<i4").tolist() == sp.encode("a▁b")


def test_suffixes_and_occurrences():
    p = M.Pieces(PATH)
    text = "▁there▁is▁the\U0010ffffthe"
    codes = np.array([ord(c) for c in text])
    assert [text[i:i + p.longest] for i in p.suffixes(codes)[0]] == sorted(text[i:i + p.longest] for i in range(len(text)))
    edge, piece = p.occurrences(codes)
    assert edge.tolist() == sorted(edge.tolist())
    assert sorted(zip((edge // (p.longest + 1)).tolist(), (p.text[i] for i in p.ids[piece]))) == sorted(
        (i, text[i:i + n]) for i in range(len(text)) for n in range(1, p.longest + 1)
        if i + n <= len(text) and text[i:i + n] in {p.text[j] for j in p.ids})


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, " a  b "), (3, "word " * 30_000), (3, "same"), (3, "same"), (4, "z" * 20_000)]
    docs = docs_frame(spark, rows)
    back = M.decode_ids(M.encode_texts(docs)).collect()
    assert sorted([(r.doc_id, r.text) for r in back], key=repr) == sorted(rows, key=repr)
    assert M.decode_ids(M.encode_texts(docs_frame(spark, []))).count() == 0
    odd = spark.createDataFrame([(1, [3 + 0xE9, 1, 300, None]), (2, [0]), (3, [])], "doc_id long, ids array<int>")
    sp = library()
    got = {r.doc_id: r.text for r in M.decode_ids(odd).collect()}
    assert got == {1: sp.decode([3 + 0xE9, 1, 300]), 2: sp.decode([0]), 3: ""}
