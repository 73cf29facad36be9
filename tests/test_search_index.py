"""The trigram index finds what a scan finds."""

import random

import pyarrow as pa

from stockroom.operators import search_index as SI
from stockroom.operators.parties import search_rows
from stockroom.session import cut_lineage

KEY, CELLS = ["a", "b"], ["Name", "Note", "n"]
SCHEMA = "a long, b long, Name string, Note string, n long"
WORDS = ["10%", "_x_", "Straße", "ÉCLAIR", "漢字テスト", "😀😀😀", "bolt", "Bo", "lt", "aaa", "aaaa", " ", ""]
TERMS = ["10%", "%_x", "_x_", "STRASSE", "straße", "éclair", "漢字テ", "😀😀😀", "aaaa", "bolt", "BOLT ", "lt bo", "123", "no such", "lt", "%", ""]


def some(rng, n, first=0):
    text = lambda: None if rng.random() < 0.1 else "".join(rng.choice(WORDS) + rng.choice(["", " "]) for _ in range(rng.randrange(5)))
    return [(rng.choice([None, first + i, first + i // 2]), rng.choice([None, 1, 2]), text(), text(), rng.choice([None, 7, 12345])) for i in range(n)]


def same(rows, index):
    for term in TERMS:
        order = lambda d: sorted(map(repr, d.collect()))
        assert order(SI.indexed_search(rows, index, term, KEY, CELLS)) == order(search_rows(rows, term, CELLS)), term


def test_equals_a_scan_and_follows_changes(spark):
    rng = random.Random(6)
    held = some(rng, 60)
    frame = lambda r: cut_lineage(spark.createDataFrame(r, SCHEMA))
    index = cut_lineage(SI.build_index(frame(held), KEY, CELLS))
    same(frame(held), index)
    gone = {r[:2] for r in held[::4]}
    new = some(rng, 15, first=1000) + [(*k, "edited bolt", "10%_x_", 123456) for k in sorted(gone, key=repr)[:3]]
    held = [r for r in held if r[:2] not in gone] + new
    keys = spark.createDataFrame(list(gone), "a long, b long")
    same(frame(held), cut_lineage(SI.reindexed(index, KEY, CELLS, keys, frame(new))))


def test_a_lookup_reads_the_terms_grams_only(spark, tmp_path):
    rows = spark.createDataFrame([(i, 1, f"name {i}", "note", i) for i in range(50)], SCHEMA)
    SI.build_index(rows, KEY, CELLS).write.parquet(str(tmp_path / "index"))
    found = SI.indexed_search(rows, spark.read.parquet(str(tmp_path / "index")), "me 17", KEY, CELLS)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(Gram, [" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert [r.a for r in found.collect()] == [17]
    empty = rows.limit(0)
    assert SI.indexed_search(empty, SI.build_index(empty, KEY, CELLS), "name", KEY, CELLS).count() == 0


def test_the_index_is_lists_not_a_row_for_each_trigram(spark):
    rows = spark.createDataFrame([(i, 1, f"name {i}", "a note", None) for i in range(3000)], SCHEMA).coalesce(1)
    index = cut_lineage(SI.build_index(rows, KEY, CELLS))
    assert index.count() < 3000  # of some 24,000 postings
    assert index.selectExpr("max(size(a))").first()[0] <= SI.LIST
    same(rows, index)
    gone = rows.where("a % 7 = 0").select(*KEY)
    left = SI.reindexed(index, KEY, CELLS, gone)
    assert left.where("Gram = 'not'").selectExpr("sum(size(a))").first()[0] == 3000 - gone.count()
    assert left.selectExpr("max(size(a))").first()[0] <= SI.LIST


def test_trigrams_of_odd_texts():
    texts = ["", None, "ab", "aaaa", "漢字テスト", "😀😀😀x", "ab", "abc", b"\xffabc"]
    held = pa.array([t.encode() if isinstance(t, str) else t for t in texts], pa.binary())
    shown = [t.decode("utf-8", "replace") if isinstance(t, bytes) else t or "" for t in texts]
    want = sorted({(t[i:i + 3], n) for n, t in enumerate(shown) for i in range(len(t) - 2)})
    got = lambda x: [("".join(map(chr, c)), n) for c, n in zip(*(v.tolist() for v in SI._grams(x)))]
    assert got(held) == want
    assert got(pa.concat_arrays([held[:3], held])[3:]) == want
    many = pa.array(["".join(map(chr, range(0x20000 + 30000 * i, 0x20000 + 30000 * (i + 1)))) for i in range(5)] * 2)
    assert len(got(many)) == 10 * (30000 - 2)  # more characters than one number has room for
