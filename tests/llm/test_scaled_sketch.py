import hashlib

from stockroom.llm import scaled_sketch as S
from stockroom.llm.queries import op3_scaled_sketch
from texts import MEDIUM, docs_frame, table_rows
from pyspark.sql import functions as F


def sketch(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    runs = [w[i:i + 5] for i in range(max(len(w) - 4, 1))] if w else []
    h = {hashlib.md5(b" ".join(r)).hexdigest()[:S.DIGITS] for r in runs}
    low = sorted(x for x in h if int(x, 16) < int(16**S.DIGITS * S.FRACTION))
    return low or sorted(h)[:1]


def alike(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    rows = [(i, t or "") for i, t in rows]
    rows.sort(key=lambda r: (r[0] if r[0] is not None else -2**63, r[1].encode()), reverse=True)
    out = []
    for n, (i, t) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        a, b, c = sketch(t), sketch(edited), sketch(following)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), ",".join(a), ",".join(b),
                    alike(a, b), alike(a, c)))
    return sorted(out, key=repr)


def test_query_equals_brute_force_on_the_table(spark):
    got = sorted([tuple(r)[:7] for r in op3_scaled_sketch(spark, MEDIUM).collect()], key=repr)
    assert got == brute(table_rows(MEDIUM))


def test_edge_rows(spark):
    out = lambda rows: sorted([(r.doc_id, r.edited, list(r.sketch), list(r.next_sketch)) for r in
                               S.edited_and_next(docs_frame(spark, rows)).collect()], key=repr)
    rows = [(5, "one"), (9, None), (3, "é ü ö 漢字 Ab cd"), (3, "zz"), (3, "zz"), (None, "no id"), (-4, "\t \n"),
            (8, "w " * 30_000), (2**62, "big"), (-2**62, "small one here")]
    assert [(i, t, a) for i, t, a, _ in out(rows)] == sorted(
        [(i, e, sketch(t)) for i, t, e in edits(rows)], key=repr)
    assert out([(1, "alone in here")]) == [(1, "alone ialone ", sketch("alone in here"), sketch("alone in here"))]
    assert out([]) == []


def edits(rows):
    rows = sorted([(i, t or "") for i, t in rows],
                  key=lambda r: (r[0] if r[0] is not None else -2**63, r[1].encode()), reverse=True)
    return [(i, t, t[:len(t) - len(t) // 2] + rows[(n + 1) % len(rows)][1][:len(t) // 2])
            for n, (i, t) in enumerate(rows)]


def test_likeness_and_merge(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), ([], ["a"])], "x array<string>, y array<string>")
    x, y = F.col("x"), F.col("y")
    got = df.select(S.likeness(x, y), S.containment(x, y), S.merge(F.array(x, y))).collect()
    assert [tuple(r) for r in got] == [(1 / 3, 0.5, ["a", "b", "c"]), (1.0, 1.0, []), (0.0, 1.0, ["a"])]


def test_no_python_in_the_plan(spark):
    plan = S.edited_and_next(docs_frame(spark, [(1, "a"), (2, "b")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
