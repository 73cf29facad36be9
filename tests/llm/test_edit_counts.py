import random

import public_tokenizers
from tokenizers import Tokenizer

from stockroom.llm import edit_counts as E
from stockroom.llm.queries import edit_requests, op7_edit_counts
from texts import SMALL, docs_frame

PARTS = ["a", "b", " ", "  ", "\n", "'", "s", "'ll", "1", "23", "é", "漢", "!", "...", "\t", "😀", "The", "re"]


def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def brute(rows, edits):
    """Every edit on the plain text, and the whole text counted anew."""
    tok, out = tokenizer(), []
    by_doc = {}
    for i, seq, a, b, new in edits:
        if i is not None:
            by_doc.setdefault(i, []).append((seq, a is not None, a or 0, b is not None, b or 0, new or "", a, b))
    for i, text in rows:
        text = text or ""
        before, n = len(tok.encode(text).ids), 0
        for *_, new, a, b in sorted(by_doc.get(i, [])):
            if a is None or b is None:
                continue
            a = min(max(a, 0), len(text))
            b = min(max(b, a), len(text))
            text, n = text[:a] + new + text[b:], n + 1
        out.append((i, before, len(tok.encode(text).ids), len(text), n))
    return sorted(out, key=repr)


def test_equals_recounting_on_the_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = op7_edit_counts(spark, SMALL).collect()
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()],
                 [tuple(r) for r in edit_requests(docs).collect()])
    assert sorted([tuple(r)[:5] for r in got], key=repr) == want
    long = [r for r in got if r.n_tokens > 1000]
    assert long and all(r.n_recounted < 150 for r in long)  # only what edits touch


def test_tree_after_random_edits():
    count, r = E.counter(public_tokenizers.path(E.RANKS)), random.Random(4)
    word = lambda n: "".join(r.choice(PARTS) for _ in range(n))
    for _ in range(400):
        text = word(r.choice([0, 1, 5, 40, 300]))
        tree = E.Tree(text, count)
        for _ in range(r.randrange(1, 8)):
            a = r.randrange(-2, len(text) + 4)
            b = r.choice([a, a + 1, a + r.randrange(60), a - 1])
            new = word(r.choice([0, 0, 1, 2, 8, 200, 900]))
            s = min(max(a, 0), len(text))
            text = text[:s] + new + text[min(max(b, s), len(text)):]
            tree.edit(a, b, new)
            assert [p for leaf in tree.leaves for p in leaf] == count.pattern.findall(text)
            assert (tree.n_chars, tree.n_tokens) == (len(text), len(count.encoding.encode_ordinary(text)))


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (None, "c"), (3, "it's <|endoftext|> here"), (4, "x y"), (4, "z"),
            (5, "word " * 20_000), (6, "never edited é")]
    edits = [(1, 0, 0, 5, "new text"), (2, 0, None, 5, "no"), (None, 0, 0, 1, "no"), (3, 1, 2, 2, None), (3, 0, 5, 99, "!"),
             (3, 0, 5, 99, "!"), (4, 0, 1, 1, "Q"), (99, 0, 0, 0, "none"), (5, 2, 50_000, 50_003, "cut"),
             (5, 2, 50_000, 50_001, "tie"), (5, None, 3, 1, "back")]
    docs = docs_frame(spark, rows)
    frame = spark.createDataFrame([(*e, "x") for e in edits],
                                  "doc_id long, seq int, start long, stop long, replacement string, text string")
    got = sorted([tuple(r)[:5] for r in E.follow_edits(docs, frame).collect()], key=repr)
    edits = [(i, -1 if s is None else s, a, b, n) for i, s, a, b, n in edits]  # nulls come first
    assert got == brute(rows, edits)
    assert E.follow_edits(docs_frame(spark, []), frame).count() == 0
    assert E.follow_edits(docs, frame.where("false")).count() == len(rows)


def test_stored_trees_are_edited_without_documents(spark, tmp_path):
    """Trees written once take one batch of edits after another; the counts are those of the whole texts counted anew."""
    r = random.Random(11)
    word = lambda n: "".join(r.choice(PARTS) for _ in range(n))
    texts = {i: word(n) for i, n in enumerate([0, 1, 40, 300, 9000, 30_000])}
    docs_frame(spark, list(texts.items())).write.parquet(str(tmp_path / "docs"))
    E.plant(spark.read.parquet(str(tmp_path / "docs"))).write.parquet(str(tmp_path / "trees0"))
    assert spark.read.parquet(str(tmp_path / "trees0")).where("part > 0").count() > 0
    for step in range(3):
        trees = spark.read.parquet(str(tmp_path / f"trees{step}"))
        edits = [(i, s, a, a + r.randrange(40), word(r.choice([0, 1, 5, 400])))
                 for i, t in texts.items() for s, a in enumerate(r.randrange(len(t) + 1) for _ in range(4))]
        frame = spark.createDataFrame(edits, "doc_id long, seq int, start long, stop long, replacement string")
        after = E.edit_trees(trees, frame)
        plan = after._jdf.queryExecution().executedPlan().toString()
        assert str(tmp_path / "docs") not in plan and plan.count("FileScan") == 1
        got = sorted(tuple(x)[:5] for x in E.edit_figures(trees, frame).collect())
        assert got == brute(list(texts.items()), edits)
        after.write.parquet(str(tmp_path / f"trees{step + 1}"))
        for i, _, a, b, new in edits:
            texts[i] = texts[i][:a] + new + texts[i][b:]
        held = {}
        for x in spark.read.parquet(str(tmp_path / f"trees{step + 1}")).orderBy("doc_id", "part").collect():
            assert x.n_chars == len(x.text) == E.unpack(x.sizes).sum() and x.n_tokens == E.unpack(x.counts).sum()
            held[x.doc_id] = held.get(x.doc_id, "") + x.text
        assert held == texts


def test_a_stored_tree_encodes_only_what_an_edit_touches():
    whole = E.counter(public_tokenizers.path(E.RANKS))
    text = "some words that stay, and 1234 others. " * 2000

    class Asked(dict):
        pattern = whole.pattern

        def __missing__(self, piece):
            asked.append(piece)
            return whole[piece]

    asked = []
    parts = [row[3:] for row in E.Tree(text, whole).rows()]
    tree = E.Tree.stored(parts, Asked())
    assert not asked and tree.n_tokens == len(whole.encoding.encode_ordinary(text))
    tree.edit(40_000, 40_010, "new")
    assert 0 < len(asked) <= tree.recounted < 20
    assert sum(callable(list.__getitem__(tree.leaves, i)) for i in range(len(tree.leaves))) >= len(tree.leaves) - 4
    assert tree.text() == text[:40_000] + "new" + text[40_010:]


def test_numbers_are_packed_in_the_least_width():
    for numbers in ([], [0], [255], [256, 1], [1 << 16], [1 << 32, 7]):
        assert E.unpack(E.pack(numbers)).tolist() == numbers
    assert len(E.pack([255] * 10)) == 11 and len(E.pack([256])) == 3
