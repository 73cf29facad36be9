import numpy as np
import pytest
from pyspark.sql import functions as F
from stockroom.llm import norm_search as N
from stockroom.llm.queries import op11_norm_search
from texts import MEDIUM, table_rows

SCHEMA = "vec_id long, embedding array<double>, dim string, floor int, block string, rank int"


def brute(rows, every, k):
    best = {}
    for i, v in rows:
        if i is None or not v or any(c is None or not np.isfinite(c) or abs(c) > 2**31 for c in v):
            continue
        x = tuple(int(np.floor(1024 * c)) for c in v)
        if sum(c * c for c in x) < 2**62:
            best[i] = min(best.get(i, x), x)
    out = []
    for q, a in best.items():
        if q % every == 0:
            scored = sorted((-sum(p * r for p, r in zip(a, b)), i) for i, b in best.items() if i != q and len(a) == len(b))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def found(spark, rows, every=100, k=10):
    df = spark.createDataFrame([(i, v, "x", 1, "y", 2) for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in N.top_products(df, F.col("vec_id") % every == 0, k).collect())


def test_query_equals_brute_force_on_the_table(spark):
    got = sorted(tuple(r) for r in op11_norm_search(spark, MEDIUM).collect())
    assert got == brute(table_rows(MEDIUM, "vec_id, embedding", "embeddings"), 100, 10)


def test_edge_rows(spark):
    rows = [(0, [1.0, 2.0]), (100, [0.5, -2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [None, 1.0]),
            (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [3.0]), (200, [4.0]), (None, [1.0, 1.0]),
            (9, [9.0, 9.0]), (9, [-9.0, 9.0]), (300, [0.0, 0.0]), (10, [1e300, 0.0]), (11, [2.0e6, -2.0e6]),
            (-100, [-1.0, -0.0004]), (2**62, [1.5, 2.0])]
    assert found(spark, rows, k=3) == brute(rows, 100, 3)
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0])]) == []


@pytest.mark.parametrize("spread", [1.0, 30.0])
def test_small_blocks_long_tails_and_many_copies(spark, spread, monkeypatch):
    monkeypatch.setattr(N, "VECTOR_BLOCK", 2048)
    monkeypatch.setattr(N, "QUERY_BLOCK", 512)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((700, 8)) * np.exp(rng.standard_normal((700, 1)) * np.log(spread) / 2)
    x[200:430] = x[200]
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(700), x)]
    assert found(spark, rows, 10, 5) == brute(rows, 10, 5)


def test_lengths_spare_pairs_and_partial_sums_spare_products():
    rng = np.random.default_rng(1)
    x = np.floor(rng.standard_normal((4000, 16)) * np.geomspace(400, 1, 16)).astype(np.int64)
    x = x[np.argsort(-(x * x).sum(axis=1))]
    turn = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1].T
    summed = []
    exact = N._exact
    N._exact = lambda a, b: (summed.append(len(a)), exact(a, b))[1]
    try:
        q, v, score = N.search_block(np.arange(4000), x, np.arange(50), x[:50], np.full(50, -np.inf), turn, 10)
    finally:
        N._exact = exact
    assert sum(summed) < 0.3 * 50 * 4000
    for j in range(50):
        s = x @ x[j]
        order = [i for i in np.lexsort((np.arange(4000), -s)) if i != j][:10]
        assert v[q == j].tolist() == order and score[q == j].tolist() == s[order].tolist()
