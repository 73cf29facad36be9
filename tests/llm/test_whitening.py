import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from stockroom.llm import whitening as W
from stockroom.llm.queries import op12_whitening
from texts import MEDIUM, SMALL, table_rows

SCHEMA = "vec_id long, embedding array<double>, dim string, x int, key string, ids int, weight int"


def usable(rows):
    return [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) and abs(c) <= 2**43 for c in v)]


def check(got, rows, components=8, weights="count"):
    """Rows (vec_id, dim, deviation, whitened) against a fit with plain integers and one dense matrix."""
    want = usable(rows)
    assert sorted(r[0] is None or r[0] for r in got) == sorted(i is None or i for i, x in want)
    for dim in {len(x) for _, x in want}:
        some = [(i, x) for i, x in want if len(x) == dim]
        fitted = [x for _, x in some] if weights == "count" else [list(x) for x in {tuple(x) for _, x in some}]
        n, sums = len(fitted), [sum(c) for c in zip(*fitted)]
        mean = np.array([s / n for s in sums])
        a = np.array(fitted, dtype=float) - mean
        v = a.T @ a / n
        e, u = np.linalg.eigh(v)
        e, u = e[::-1], u[:, ::-1]
        k = int((e[:components] > 1e-11 * np.trace(v)).sum()) if np.trace(v) > 0 else 0
        here = {}
        for i, d, dev, y in got:
            if d == dim:
                here.setdefault(i, []).append((int(dev), tuple(y)))
        signs = None
        for i, x in some:
            dev = sum((n * c - s) ** 2 for c, s in zip(x, sums))
            y = (np.array(x, dtype=float) - mean) @ u[:, :k] / np.sqrt(e[:k])
            near = min(here[i], key=lambda r: (r[0] != dev, np.abs(np.abs(r[1]) - np.abs(y)).sum()))
            assert near[0] == dev and len(near[1]) == k
            assert np.allclose(np.abs(near[1]), np.abs(y), atol=1e-6 * (1 + np.abs(y).max(initial=0)))
            big = np.abs(y) > 1e-3
            mine = np.where(big, np.sign(near[1]) * np.sign(y), 0)
            signs = mine if signs is None else np.where(signs == 0, mine, signs)
            assert ((mine == 0) | (mine == signs)).all()


def whitened(spark, rows, **how):
    df = spark.createDataFrame([(i, v, "a", 1, "b", 2, 3) for i, v in rows], SCHEMA)
    out, fits, errors = W.whiten(df, **how)
    return [tuple(r) for r in out.collect()], fits, errors


def test_query_on_the_table(spark):
    rows = table_rows(MEDIUM, "vec_id, embedding", "embeddings")
    out = op12_whitening(spark, MEDIUM).collect()
    assert len(out) == 8 * len(usable(rows))
    by = {}
    for r in sorted(out, key=lambda r: r.component):
        by.setdefault(r.vec_id, []).append(r)
    check([(i, 64, rs[0].deviation, [r.whitened for r in rs]) for i, rs in by.items()], rows)
    y = np.array([[r.whitened for r in rs] for rs in by.values()])
    cov = np.cov(y.T, bias=True)
    assert len({r.identity_error for r in out}) == 1 and len({(r.component, r.explained) for r in out}) == 8
    assert abs(np.abs(cov - np.eye(8)).max() - out[0].identity_error) < 1e-9 and out[0].identity_error < 1e-6
    assert [c.name for c in op12_whitening(spark, SMALL).schema][:5] == ["vec_id", "component", "n", "deviation", "whitened"]


def test_copies_weigh_as_often_as_they_occur(spark, monkeypatch):
    monkeypatch.setattr(W, "GROUPED_AT_ONCE", 16)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 5)).tolist()
    rows = [(i, v) for i, v in enumerate(x)] + [(1000 + i, x[0]) for i in range(400)] + [(5, x[5]), (6, x[7])]
    for how in ("count", "one"):
        got, fits, errors = whitened(spark, rows, components=3, weights=how)
        check(got, rows, 3, how)
        assert fits[5].n == (462 if how == "count" else 60) and errors[5] < 1e-9
    with pytest.raises(ValueError):
        W.whiten(spark.createDataFrame([], SCHEMA), weights="none")


def test_edge_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, []), (4, [None, 1.0]), (5, [float("nan"), 0.0]), (6, [float("-inf"), 0.0]),
            (None, [0.5, 0.25]), (7, [-1.0, 0.0]), (7, [-1.0, 0.0]), (7, [2.0, 8.0]), (8, [3.0]), (9, [1e300, 0.0]),
            (10, [1.0, 1.0, 1.0]), (11, [1.0, 1.0, 1.0])]
    got, fits, errors = whitened(spark, rows)
    check(got, rows)
    assert fits[1].n == 1 and not len(fits[1].eigenvalues) and not len(fits[3].eigenvalues) and set(errors) == {2}
    got, fits, errors = whitened(spark, [])
    assert (got, fits, errors) == ([], {}, {})


def test_deviations_are_exact_beyond_64_bits():
    x = np.array([[2**50, -(2**50)], [3, 5]], dtype=np.int64)
    for n in (2, 10**6, 10**12):
        sums = (7 * n, 11)
        assert W.deviations(x, n, sums) == [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x.tolist()]
