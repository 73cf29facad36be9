"""Order-dependent jobs against plain Python loops; skew-safe scans against plain windows."""

import datetime as dt
from decimal import Decimal, InvalidOperation

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from data_paths import SMALL
from stockroom.operators import scan
from stockroom.operators import sequential as Q
from stockroom.operators import stock as S
from stockroom.sources import RetailTables


def number(text):
    try:
        return Decimal(str(text).strip())
    except InvalidOperation:
        return None


def brute_record(reqs, prices, avail):
    """Requests in order; whole quantities in any numeric form; an amount must fit its column."""
    ok = set()
    for row in reqs.sort_values(["ts", "request_id"]).itertuples():
        q, pct = number(row.Quantity), number(row.Discount) or Decimal(0)
        if q is None or q != int(q) or q <= 0 or q >= 2**63 or row.ProductID not in prices:
            continue
        subtotal = prices[row.ProductID] * q
        if pct >= 10**8 or subtotal >= 10**16 or abs(subtotal * (100 - pct) / 100) >= 10**12:
            continue
        if avail.get(row.ProductID, 0) >= q:
            avail[row.ProductID] -= int(q)
            ok.add(row.request_id)
    return ok


def test_record_sales_matches_loop(spark):
    t = RetailTables.from_testdata(spark, SMALL)
    rec = Q.record_sales(t.products, t.stock, t.sales, t.sale_requests)
    assert rec.rounds > 1
    got = {r.request_id for r in rec.sales.select("request_id").collect()}
    prices = {r.ProductID: r.Price for r in t.products.collect()}
    avail = {r.ProductID: r.Available for r in S.stock_availability(t.sale_requests, t.stock, t.sales).collect()}
    assert got == brute_record(t.sale_requests.toPandas(), prices, avail)
    ids = [r.SaleID for r in rec.sales.collect()]
    assert len(ids) == len(set(ids))
    assert rec.rejects.count() + len(got) == t.sale_requests.count()


def test_reserve_matches_loop(spark):
    t = RetailTables.from_testdata(spark, SMALL)
    reqs = t.cart_events.where(F.col("action") == "add").select(
        F.col("event_id").alias("request_id"), "ts", F.col("product_id").alias("ProductID"),
        F.col("quantity").alias("q"))
    res = Q.reserve_stock(t.stock, reqs, wave_size=40)  # several waves
    got = {(r.request_id, r.StockID) for r in res.taken.collect()}
    lots = {}
    for r in t.stock.select("ProductID", "StockID", "QuantityAdded").collect():
        lots.setdefault(r.ProductID, []).append([r.QuantityAdded, r.StockID])
    exp = set()
    for row in reqs.toPandas().sort_values(["ts", "request_id"]).itertuples():
        best = None
        for lot in lots.get(row.ProductID, []):
            if lot[0] >= row.q and (best is None or lot[0] > best[0] or (lot[0] == best[0] and lot[1] < best[1])):
                best = lot
        if best is not None:
            best[0] -= row.q
            exp.add((row.request_id, best[1]))
    assert got == exp
    final = {r.StockID: r.QuantityAdded for r in res.stock.collect()}
    assert final == {lot[1]: lot[0] for ls in lots.values() for lot in ls}


def test_running_sums_hot_key_chunked_equals_window(spark):
    t = RetailTables.from_testdata(spark, SMALL)
    ev = t.cart_events.select("event_id", "ts", "product_id", "quantity")  # 3 keys, ~1/3 of rows each
    chunked = scan.running_sums(ev, ["product_id"], ["ts", "event_id"], {"c": F.col("quantity")}, n=7)
    w = Window.partitionBy("product_id").orderBy("ts", "event_id")
    plain = ev.withColumn("c", F.sum("quantity").over(w))
    assert sorted(map(tuple, chunked.collect())) == sorted(map(tuple, plain.collect()))
    nums = scan.number_rows(ev, ["ts", "event_id"], "n", base=100, n=5)
    assert sorted(r.n for r in nums.collect()) == list(range(101, 101 + ev.count()))


def test_rounds_are_bounded_by_distinct_quantities(spark):
    """Many rejected requests of few quantities still need few rounds."""
    rows = [(1, dt.datetime(2000, 1, 1) + dt.timedelta(minutes=i), i, 3 if i % 2 else 5) for i in range(200)]
    pending = spark.createDataFrame(rows, "ProductID long, ts timestamp_ntz, request_id long, q long")
    ok, rounds = Q.accept_in_order(pending, spark.createDataFrame([(1, 22)], "ProductID long, s long"))
    left, want = 22, set()
    for _, _, i, q in rows:
        if q <= left:
            left -= q
            want.add(i)
    assert {r.request_id for r in ok.collect()} == want
    assert rounds <= 3


def test_reserve_small_waves_only_top_lots(spark):
    """Waves of 2 requests see only each product's 2 largest lots, and the result is still exact."""
    import datetime as dt
    import random

    from stockroom.schema import from_rows

    rnd = random.Random(7)
    lots = [(i, i % 2, 1, rnd.randint(1, 9), dt.datetime(2000, 1, 1)) for i in range(12)]
    reqs = [(i, dt.datetime(2000, 1, 2) + dt.timedelta(minutes=i), i % 2, rnd.randint(1, 6)) for i in range(9)]
    t = from_rows(spark, {"stock": lots})
    req_df = spark.createDataFrame(reqs, "request_id long, ts timestamp_ntz, ProductID long, q long")
    res = Q.reserve_stock(t.stock, req_df, wave_size=2)
    state = {sid: [q, pid] for sid, pid, _, q, _ in lots}
    exp = set()
    for rid, _, pid, q in reqs:
        cands = [(v, -sid, sid) for sid, (v, p) in state.items() if p == pid and v >= q]
        if cands:
            sid = max(cands)[2]
            state[sid][0] -= q
            exp.add((rid, sid))
    assert {(r.request_id, r.StockID) for r in res.taken.collect()} == exp
    assert {r.StockID: r.QuantityAdded for r in res.stock.collect()} == {k: v[0] for k, v in state.items()}


def plain_fold(rows, left):
    """Accepted request ids of one product's requests in order."""
    ok = set()
    for i, q in rows:
        if q <= left:
            left -= q
            ok.add(i)
    return ok, left


def test_phases_equal_the_loop_and_are_bounded():
    import random

    rng = random.Random(11)
    for _ in range(3000):
        most = rng.choice([1, 3, 9, 60, 2**40, 2**62])
        q = [rng.randint(1, most) for _ in range(rng.randint(1, 40))]
        s = rng.choice([rng.randint(-3, 2 * most), rng.randint(1, 5 * most), most]) % 2**63
        ok, left = Q.play(np.array(q, dtype=np.int64), s)
        want, rest = plain_fold(enumerate(q), s)
        assert (set(np.flatnonzero(ok).tolist()), left) == (want, rest)


@pytest.mark.parametrize("cell", [1, 2, 7])
def test_rounds_are_bounded_by_digits_of_quantities(spark, cell, monkeypatch):
    """Requests over many cells, quantities of all sizes: exact, and no more rounds than log2(largest) + 2."""
    import random

    rng = random.Random(cell)
    monkeypatch.setattr(Q, "CELL_ROWS", cell)
    rows, avail, want = [], [], set()
    for p in range(12):
        most = rng.choice([1, 6, 50, 3000, 2**61])
        mine = [(p, dt.datetime(2000, 1, 1) + dt.timedelta(minutes=i), p * 1000 + i, rng.randint(1, most)) for i in range(60)]
        s = rng.choice([0, -5, 3, most * 2, most * 20 if most < 2**50 else 2**62])
        rows, avail = rows + mine, avail + [(p, s)]
        want |= plain_fold([(r[2], r[3]) for r in mine], s)[0]
    rng.shuffle(rows)
    pending = spark.createDataFrame(rows, "ProductID long, ts timestamp_ntz, request_id long, q long")
    ok, rounds = Q.accept_in_order(pending, spark.createDataFrame(avail, "ProductID long, s long"))
    assert {r.request_id for r in ok.collect()} == want
    assert 1 <= rounds <= max(r[3] for r in rows).bit_length() + 1
