import corpus_pipeline as C
from stockroom.llm import language_id, secret_scan
from stockroom.llm.common import table
from texts import MEDIUM, SMALL, docs_frame, table_rows
from pyspark.sql import functions as F
import test_packing
import test_set_join
import test_substring_dedup


def staged(spark, docs, upto):
    for _, stage in C.STAGES[:upto]:
        docs = stage(spark, docs, SMALL)
    return docs


def brute(rows):
    """The first four stages in plain Python: documents (doc_id, text) that reach the packing."""
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    groups = {i: c for i, _, c in test_set_join.brute(rows)}
    least = {}
    for i, t in sorted(rows, key=lambda r: r[1].encode()):
        if i is not None and groups[i] == i:
            least.setdefault(i, t)
    rows = [(i, t) for i, t in rows if i is None] + list(least.items())
    out = []
    kept = {}
    for i, n, gone, text in test_substring_dedup.brute(rows):
        kept.setdefault(i, []).append((n, gone, text))
    for i, t in rows:
        n, gone, text = next(x for x in kept[i] if i is not None or x[2] == b" ".join(t.encode().split()).decode())
        if gone < n:
            text = text if gone else t
            out.append((i, secret_scan.redact(text.encode()).decode()))
    return sorted(out, key=repr)


def test_all_stages_on_the_table(spark):
    rows = table_rows(MEDIUM)
    docs = table(spark, MEDIUM, "documents")
    clean = staged(spark, docs, 4).cache()
    assert clean.columns == docs.columns and clean.schema == docs.schema
    assert sorted([(r.doc_id, r.text) for r in clean.collect()], key=repr) == brute(rows)
    assert all(r.n_chars == len(r.text) for r in clean.collect())
    pieces = C.run(spark, MEDIUM)
    got = pieces.collect()
    assert test_packing.check(got, [(r.doc_id, r.text) for r in clean.collect()]) < 0.02
    clean.unpersist()


def test_each_stage_on_edge_rows(spark):
    p = " ".join(f"w{i}" for i in range(20))
    rows = [(1, None), (2, ""), (3, "12 34"), (4, p), (5, p), (5, p + " x"), (None, p), (6, "A\nb  token=abcdef"),
            (7, "é " * 4000), (8, "x " + p), (9, p.upper() + " more words here"), (9, "aa bb"), (9, "aa bb")]
    docs = docs_frame(spark, rows)
    got = staged(spark, docs, 4)
    assert got.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=repr) == brute(rows)
    assert staged(spark, docs_frame(spark, []), 5).count() == 0
    unnamed = docs.withColumn("lang", F.when(F.col("doc_id") > 6, F.col("lang")))
    assert {r.lang for r in staged(spark, unnamed, 1).collect()} == {"en"}  # predicted where there is no label
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    without = staged(spark, nothing, 1)
    assert without.schema == nothing.schema and {r.lang for r in without.collect()} == {None}
    assert sorted([(r.doc_id, r.text) for r in staged(spark, nothing, 4).collect()], key=repr) == brute(rows)


def test_names_with_dots_and_clashes_pass_all_stages(spark):
    docs = docs_frame(spark, [(1, "some words here."), (2, "12"), (None, "more words")]).withColumn("a.b", F.lit(3)).withColumn(
        "row", F.lit("x")).withColumn("lang_pred", F.lit("y"))
    got = staged(spark, docs, 4)
    assert got.columns == docs.columns and sorted(r["text"] for r in got.collect()) == ["more words", "some words here."]
    assert staged(spark, docs, 5).count() == 2


def test_names_of_the_stages():
    assert [n for n, _ in C.STAGES] == ["language_id", "ngram_jaccard_join", "substring_dedup", "secret_scan", "packing"]
    assert language_id.UNKNOWN == "und"
