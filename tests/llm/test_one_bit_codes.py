import numpy as np

from stockroom.llm import one_bit_codes as N
from stockroom.llm.queries import op2_one_bit_neighbours
from texts import MEDIUM, table_rows


def brute(rows, is_query, k):
    out = []
    rows = [(i, np.array(v, dtype=np.float64)) for i, v in rows]
    for i, q in rows:
        if not is_query(i):
            continue
        scored = []
        for j, v in rows:
            if j != i and len(v) == len(q):
                dot = sum(float(a) * float(b) for a, b in zip(v, q))
                scored.append((-dot / (np.sqrt(sum(float(a) ** 2 for a in q)) * np.sqrt(sum(float(a) ** 2 for a in v))), j))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scored)[:k])]
    return out


def test_recall_on_the_table(spark):
    rows = table_rows(MEDIUM, "vec_id, embedding", "embeddings")
    got = [tuple(r) for r in op2_one_bit_neighbours(spark, MEDIUM).collect()]
    want = brute(rows, lambda i: i % 50 == 0, 5)
    assert len(got) == len(want)
    assert len({(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}) >= 0.99 * len(want)
    score = {(q, v): s for q, _, v, s in want}
    assert all(abs(s - score[q, v]) < 1e-12 for q, _, v, s in got if (q, v) in score)


def test_codes_estimate_within_their_bounds():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 96))
    x /= np.linalg.norm(x, axis=1)[:, None]
    turn = N.rotation(96)
    assert np.allclose(turn @ turn.T, np.eye(96))
    codes, scalars = N.encode(x, turn)
    assert codes.shape == (2000, 12)
    value, error = N.estimate(codes, scalars, (x[:50] @ turn.T))
    off = np.abs(value - x @ x[:50].T) / np.maximum(error[:, None], 1e-9)
    assert (off[50:] < N.ERROR_BOUND).mean() > 0.99
    assert abs((value - x @ x[:50].T)[50:].mean()) < 0.01


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows],
                                 "vec_id long, embedding array<float>, block int, score string")


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]),
            (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [0.0, 1.0]), (9, [-1.0, 0.0]), (10, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]),
            (50, [3.0, 0.0]), (50, [0.0, 3.0]), (100, []), (150, [1.0])]
    got = [tuple(r) for r in N.nearest(frame(spark, rows), "vec_id % 50 = 0").collect()]
    good = {i: v for i, v in sorted(rows, key=lambda r: (str(r[0]), r[1] is None, r[1] or []), reverse=True)
            if i is not None and i not in (3, 4, 5, 6, 7, 100)}
    assert sorted(got) == sorted(brute(list(good.items()), lambda i: i % 50 == 0, 5))
    assert [v for q, _, v, _ in sorted(got) if q == 0] == [1, 2, 8, 50, 9]
    assert N.nearest(frame(spark, []), "vec_id % 50 = 0").count() == 0


def test_many_equal_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    one = rng.standard_normal(16).astype(np.float32)
    rows = [(i, (one if i % 3 else rng.standard_normal(16).astype(np.float32)).tolist()) for i in range(300)]
    got = [tuple(r) for r in N.nearest(frame(spark, rows), "vec_id % 50 = 0").collect()]
    want = brute(rows, lambda i: i % 50 == 0, 5)
    assert sorted((q, n, v) for q, n, v, _ in got) == sorted((q, n, v) for q, n, v, _ in want)
