import pytest
from stockroom.llm import set_join, sieve
from stockroom.llm.set_join import link_components
from test_set_join import brute, near_copies
from texts import docs_frame


def test_sift_lets_marked_ids_pass_and_keeps_every_row(spark):
    rows = [(i, f"text {i}") for i in range(3000)] + [(None, "no id"), (7, None), (7, "again")]
    docs = docs_frame(spark, rows)
    bitmap = sieve.make(spark.range(0, 3000, 3).toDF("doc_id"), "doc_id")
    through, held = ([tuple(r) for r in sieve.sift(docs, bitmap, "doc_id", x).select("row.doc_id", "row.text").collect()] for x in (True, False))
    assert sorted(through + held, key=repr) == sorted(rows, key=repr)
    assert {i for i in range(0, 3000, 3)} <= {i for i, _ in through}
    assert len(through) < 1100


@pytest.mark.parametrize("let_pass", [True, False])
def test_sift_sends_no_texts_to_python(spark, let_pass):
    docs = docs_frame(spark, [(1, "a text")])
    bitmap = sieve.make(docs, "doc_id")
    plan = sieve.sift(docs, bitmap, "doc_id", let_pass)._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "ArrowEvalPython" in plan


def test_members_are_held_back_where_they_are_unpacked(spark, monkeypatch):
    """Not by a second Python worker of the same task; and no list of rows goes through workers of another kind."""
    rows = near_copies(4)
    docs = docs_frame(spark, rows)

    def never(*_):
        raise AssertionError("a second Python worker")

    made = spark.createDataFrame

    def tables_only(data, *more, **kw):
        assert hasattr(data, "num_rows"), "a list of rows"
        return made(data, *more, **kw)

    monkeypatch.setattr(set_join.sieve, "sift", never)
    monkeypatch.setattr(spark, "createDataFrame", tables_only)
    found = link_components(docs).collect()
    assert sorted([tuple(r) for r in found], key=repr) == brute(rows)
