"""Order-dependent change jobs: recording sales against stock, reserving lots.

Both jobs apply a batch of requests in request order, where a rejected
request must not use up stock.  A cumulative sum alone is therefore wrong
after the first rejection.

``record_sales`` runs exact *phases*, each a set of parallel Spark jobs over all
products at once.  With availability S in [2^j, 2^(j+1)) a request is

* large (2^(j+1) or more): it can't fit any more, as S only goes down;
* small (under 2^j): it fits as long as S stays at 2^j or more;
* middle: it fits if it and the small ones before it are no more than S, and
  takes S below 2^j.

So one running sum of small requests decides everything up to the first
event: a middle request that fits, or the small one that takes S below 2^j.
Where 2^j is above all of a product's quantities, every request is small.
After each phase S is below 2^j, so there are at most log2(largest quantity) + 2
of them whatever the number of requests.

Requests are dealt by ranges of (product, time) once and kept in *cells* of at
most ``CELL_ROWS`` requests of one product, each with what a phase asks of it: for every number of binary digits
the sum of quantities, and the least that a middle request needs.  A round finds from these the first cell of each
product that holds an event, decides all cells before it at once, and plays that
cell's phases out in a vectorised step.  A round so holds one phase or more;
``Recorded.rounds`` reports them.  A hot product spans many cells; only cells with events are read again.

``reserve_stock`` picks, per request, the single largest lot that covers it.
That choice depends on every earlier pick, so a product's requests are
applied in order by one function call per product and wave (``cogroup`` +
``applyInPandas`` with a heap).  A wave holds ``wave_size`` requests of a
product, and only its ``wave_size`` largest lots can be touched by them, so a
call never holds more than 2 x ``wave_size`` rows.  Lots of products without
requests are never moved; only lots that changed are joined to the stock table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import discount_pct, discounted, subtotal, whole_number
from ..session import cut_lineage
from .scan import number_rows, running_sums
from .stock import stock_availability

# ---- fixed values: the application's messages -------------------------------
INVALID_QUANTITY = "Invalid quantity specified"
PRODUCT_NOT_FOUND = "Product not found"
INSUFFICIENT_STOCK = "Insufficient stock"
AMOUNT_OUT_OF_RANGE = "Amount out of range"
NO_LOT = "Not enough stock available for this product."
ORDER = ["ts", "request_id"]


class Recorded(NamedTuple):
    sales: DataFrame      # new Sales rows
    rejects: DataFrame    # request_id, reason
    rounds: int


CELL = ["ProductID", "cell"]
# Requests of a cell at most.
CELL_ROWS = 1 << 16
_POWERS = 2 ** np.arange(63, dtype=np.int64)
_CELLS = ("ProductID long, cell long, ids array<long>, q array<long>, "
          "stats array<struct<bits:int,total:decimal(28,0),least:decimal(28,0)>>")


def _bits(q: np.ndarray) -> np.ndarray:
    """The number of binary digits of each quantity."""
    return np.searchsorted(_POWERS, q, "right")


def _wide(q: np.ndarray) -> np.ndarray:
    """``q`` in numbers whose sums don't overflow."""
    return q if not len(q) or int(q.max()) * len(q) < 2**62 else q.astype(object)


def cell_stats(q: np.ndarray) -> list[dict]:
    """For each number of digits: the sum of its quantities, and the least that one needs: itself and all smaller ones before it."""
    bits, wide, out = _bits(q), _wide(q), []
    for b in np.unique(bits).tolist():
        before = np.cumsum(np.where(bits < b, wide, 0))
        here = bits == b
        out.append({"bits": b, "total": Decimal(int(wide[here].sum())), "least": Decimal(int((before + wide)[here].min()))})
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of cells from sorted requests (ProductID, request_id, q); cells of a product are numbered in their order."""
    schema = pa.schema([("ProductID", pa.int64()), ("cell", pa.int64()), ("ids", pa.list_(pa.int64())), ("q", pa.list_(pa.int64())),
                        ("stats", pa.list_(pa.struct([("bits", pa.int32()), ("total", pa.decimal128(28, 0)),
                                                      ("least", pa.decimal128(28, 0))])))])
    number = TaskContext.get().partitionId() << 32
    held: list[tuple[np.ndarray, np.ndarray]] = []
    product = None

    def cell() -> pa.RecordBatch:
        ids, q = (np.concatenate(c) for c in zip(*held))
        return pa.RecordBatch.from_pylist([{"ProductID": product, "cell": number, "ids": ids, "q": q, "stats": cell_stats(q)}],
                                          schema)

    for batch in batches:
        products, ids, q = (batch.column(c).to_numpy() for c in ("ProductID", "request_id", "q"))
        cuts = [0, *(np.flatnonzero(np.diff(products)) + 1).tolist(), len(products)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            while a < b:
                room = CELL_ROWS - sum(len(i) for i, _ in held)
                if held and (products[a] != product or room <= 0):
                    yield cell()
                    held, number, room = [], number + 1, CELL_ROWS
                product = int(products[a])
                held.append((ids[a:min(b, a + room)], q[a:min(b, a + room)]))
                a += room
    if held:
        yield cell()


def play(q: np.ndarray, s: int) -> tuple[np.ndarray, int]:
    """(which requests are accepted in their order, what is left) of an availability ``s``; one vectorised step for each phase."""
    bits, wide = _bits(q), _wide(q)
    most, at, ok = int(bits.max(initial=0)), 0, np.zeros(len(q), dtype=bool)
    while s > 0 and at < len(q):
        level = min(int(s).bit_length(), most + 1)
        rest, small = wide[at:], bits[at:] < level
        used = np.cumsum(np.where(small, rest, 0))
        event = ((bits[at:] == level) & (used + rest <= s)) | (small & (used > s - (1 << (level - 1))))
        end = int(event.argmax()) + 1 if event.any() else len(rest)
        ok[at:at + end] = small[:end]
        s -= int(used[end - 1])
        if event[end - 1] and not small[end - 1]:
            ok[at + end - 1] = True
            s -= int(rest[end - 1])
        at += end
    return ok, s


def _played(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, ids = [], []
        for i, q, s in zip(batch.column("ids"), batch.column("q"), batch.column("s").to_pylist()):
            ok, rest = play(q.values.to_numpy(), s)
            left.append(rest)
            ids.append(i.values.to_numpy()[ok])
        yield pa.record_batch([batch.column("ProductID"), batch.column("cell"), pa.array(left, pa.int64()),
                               pa.array(ids, pa.list_(pa.int64()))], names=["ProductID", "cell", "left", "ids"])


# The first cell of each product that holds an event, and the availability it begins with.  ``state``: (ProductID, s, after,
# level): cells after ``after`` are pending, small requests have under ``level`` binary digits.
_EVENTS = """
WITH met AS (SELECT c.ProductID, c.cell, n.s, n.s - shiftleft(1L, n.level - 1) AS spare,
                    aggregate(c.stats, CAST(0 AS decimal(28,0)), (t, x) -> IF(x.bits < n.level, CAST(t + x.total AS decimal(28,0)), t)) AS inside,
                    get(filter(c.stats, x -> x.bits = n.level), 0).least AS least
             FROM {state} n JOIN {cells} c ON n.ProductID = c.ProductID AND c.cell > n.after),
placed AS (SELECT *, coalesce(sum(inside) OVER (PARTITION BY ProductID ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                    AS offset FROM met)
SELECT ProductID, first.cell AS cell, CAST(first.s AS long) AS s FROM (
  SELECT ProductID, min(struct(cell, s - offset AS s)) AS first FROM placed
  WHERE offset + inside > spare OR offset + least <= s GROUP BY ProductID)
"""


def accept_in_order(pending: DataFrame, available: DataFrame) -> tuple[DataFrame, int]:
    """Request ids accepted by the in-order availability fold, and the number of rounds it took.

    ``pending``: (ProductID, ts, request_id, q) with q >= 1.
    ``available``: (ProductID, s) starting availability (may be <= 0).
    """
    spark = pending.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)
    cells = cut_lineage(pending.repartitionByRange(n, "ProductID", *ORDER).sortWithinPartitions("ProductID", *ORDER)
                        .select("ProductID", "request_id", "q").mapInArrow(_cells, _CELLS))
    stats = cells.select(*CELL, "stats")
    most = stats.groupBy("ProductID").agg(F.max(F.expr("array_max(transform(stats, x -> x.bits))")).alias("most"))
    # Where S is above all quantities, every request is small.
    level = F.least(F.length(F.bin("s")), F.col("most") + 1).alias("level")
    state = cut_lineage(available.select("ProductID", F.col("s").cast("long").alias("s")).where("s > 0").join(most, "ProductID")
                        .select("ProductID", "s", F.lit(-1).cast("long").alias("after"), level, "most"))
    accepted, rounds = None, 0
    while not state.isEmpty():
        rounds += 1
        events = spark.sql(_EVENTS, state=state, cells=stats)
        played = cells.select(*CELL, "ids", "q").join(events, CELL).mapInArrow(
            _played, "ProductID long, cell long, left long, ids array<long>")
        done = cut_lineage(state.join(played, "ProductID", "left"))
        # Cells before the event's (all, without one) are decided by the size of their requests.
        spans = done.select("ProductID", "after", F.col("cell").alias("until"), F.expr("shiftleft(1L, level - 1)").alias("under"))
        plain = cells.join(spans, "ProductID").where((F.col("cell") > F.col("after")) & (
            F.col("until").isNull() | (F.col("cell") < F.col("until"))))
        small = F.expr("transform(filter(arrays_zip(ids, q), x -> x.q < under), x -> x.ids)")
        now = plain.select(small.alias("ids")).unionAll(done.where("cell is not null").select("ids"))
        accepted = now if accepted is None else accepted.unionAll(now)
        state = done.where("left > 0").select("ProductID", F.col("left").alias("s"), F.col("cell").alias("after"), "most").select(
            "ProductID", "s", "after", level, "most")
    if accepted is None:
        accepted = cells.select("ids").where("false")
    return accepted.select(F.explode("ids").alias("request_id")), rounds


def record_sales(products: DataFrame, stock: DataFrame, sales: DataFrame, requests: DataFrame,
                 last_id: int | None = None) -> Recorded:
    """Validate and record a batch of sale requests in (ts, request_id) order.

    Checks, in this order: whole quantity > 0, product exists, the amount fits
    its column (one that doesn't could not be stored, and uses no stock), and
    net availability (received - sold - accepted earlier in this batch) covers
    the quantity.  Amount = price x quantity less the discount percent, rounded
    to cents.  Sale date = the request time; new SaleIDs follow the current
    maximum (``last_id``, where it is known) in request order.
    """
    r = requests.select("request_id", "ts", "ProductID", "Quantity", "Discount", "UserID") \
        .withColumn("q", whole_number("Quantity"))
    p = products.select("ProductID", "Price", F.lit(True).alias("_known"))
    r = r.join(p, "ProductID", "left")
    reason0 = (F.when(F.col("q").isNull() | (F.col("q") <= 0), F.lit(INVALID_QUANTITY))
               .when(F.col("_known").isNull(), F.lit(PRODUCT_NOT_FOUND))
               .when(F.col("amount").isNull(), F.lit(AMOUNT_OUT_OF_RANGE)))
    amount = discounted(subtotal("Price", "q"), discount_pct("Discount"), "decimal(14,2)")
    r = cut_lineage(r.withColumn("amount", amount).withColumn("reason", reason0))
    valid = r.where(F.col("reason").isNull())
    avail = stock_availability(valid.select("ProductID"), stock, sales).select(
        "ProductID", F.col("Available").alias("s"))
    ok_ids, rounds = accept_in_order(valid.select("ProductID", "ts", "request_id", "q"), avail)
    ok_ids = cut_lineage(ok_ids)
    ok = valid.join(ok_ids, "request_id", "left_semi")
    rejects = (r.where(F.col("reason").isNotNull()).select("request_id", "reason")
               .unionByName(valid.join(ok_ids, "request_id", "left_anti")
                            .select("request_id", F.lit(INSUFFICIENT_STOCK).alias("reason"))))
    top = sales.agg(F.coalesce(F.max("SaleID"), F.lit(0)).cast("long")).scalar() if last_id is None else last_id
    rows = number_rows(ok, ORDER, "SaleID", base=top)
    new_sales = rows.select("SaleID", "ProductID", F.col("q").alias("QuantitySold"), F.col("ts").alias("SaleDate"),
                            F.col("amount").alias("TotalAmount"), "UserID", "request_id")
    return Recorded(new_sales, rejects, rounds)


# ---- reserve ---------------------------------------------------------------------
class Reserved(NamedTuple):
    stock: DataFrame      # whole stock table after the reservations
    taken: DataFrame      # request_id, StockID the request was served from
    rejects: DataFrame    # request_id, reason


_OUT_SCHEMA = "kind string, ProductID long, StockID long, QuantityAdded long, request_id long"


def _serve_largest(lots: pd.DataFrame, reqs: pd.DataFrame) -> pd.DataFrame:
    """Apply one product's requests in order to its lots (largest lot that covers, lowest id on ties)."""
    heap = [(-int(q), int(s)) for s, q in zip(lots["StockID"], lots["QuantityAdded"])]
    heapq.heapify(heap)
    pid = int(lots["ProductID"].iloc[0]) if len(lots) else int(reqs["ProductID"].iloc[0])
    out_kind, out_sid, out_q, out_req = [], [], [], []
    reqs = reqs.sort_values(["ts", "request_id"], kind="stable")
    for rid, q in zip(reqs["request_id"], reqs["q"]):
        q = int(q)
        if heap and -heap[0][0] >= q:
            negv, sid = heapq.heappop(heap)
            heapq.heappush(heap, (negv + q, sid))
            out_kind.append("take"), out_sid.append(sid), out_q.append(q), out_req.append(int(rid))
        else:
            out_kind.append("reject"), out_sid.append(None), out_q.append(q), out_req.append(int(rid))
    for negv, sid in heap:
        out_kind.append("lot"), out_sid.append(sid), out_q.append(-negv), out_req.append(None)
    return pd.DataFrame({"kind": out_kind, "ProductID": pid, "StockID": out_sid,
                         "QuantityAdded": out_q, "request_id": out_req}).astype(
        {"StockID": "Int64", "request_id": "Int64", "QuantityAdded": "int64", "ProductID": "int64"})


def _serve_group(key, lots: pd.DataFrame, reqs: pd.DataFrame) -> pd.DataFrame:
    if len(reqs) == 0:
        return pd.DataFrame({"kind": pd.Series(dtype=str), "ProductID": pd.Series(dtype="int64"),
                             "StockID": pd.Series(dtype="Int64"), "QuantityAdded": pd.Series(dtype="int64"),
                             "request_id": pd.Series(dtype="Int64")})
    return _serve_largest(lots, reqs)


def reserve_stock(stock: DataFrame, requests: DataFrame, wave_size: int = 100_000) -> Reserved:
    """Reserve units by decrementing, per request, the largest lot that can cover it.

    ``requests``: (request_id, ts, ProductID, q).  A request no single lot
    covers is rejected (no splitting across lots, even when the total would
    suffice); quantities <= 0 are rejected as invalid.  Requests of a product
    are applied in (ts, request_id) order, in waves of at most ``wave_size``
    per product; lots of untouched products pass through unchanged.
    """
    req = requests.select("request_id", "ts", "ProductID", F.col("q").cast("long").alias("q"))
    bad = req.where(F.col("q").isNull() | (F.col("q") <= 0)).select(
        "request_id", F.lit(INVALID_QUANTITY).alias("reason"))
    good = req.where(F.col("q") > 0)
    # Number each product's requests (skew-safe running count) and cut them into waves.
    good = running_sums(good, ["ProductID"], ORDER, {"rank": F.lit(1).cast("long")})
    good = cut_lineage(good.withColumn("wave", F.floor((F.col("rank") - 1) / F.lit(wave_size)).cast("long")))
    last = good.agg(F.max("wave")).first()[0]
    # Only lots of requested products take part.
    lots = stock.select("ProductID", "StockID", "QuantityAdded").join(
        good.select("ProductID").distinct(), "ProductID", "left_semi")
    served = []
    for w in range(0 if last is None else int(last) + 1):
        wr = good.where(F.col("wave") == w).select("ProductID", "request_id", "ts", "q")
        # W requests touch at most the W largest lots of a product (a lot is
        # only chosen once every lot ranked above it was cut below it), so
        # each call gets <= wave_size requests and <= wave_size lots.
        touched = lots.join(wr.select("ProductID").distinct(), "ProductID", "left_semi") if w else lots
        ranked = running_sums(touched, ["ProductID"], [F.desc("QuantityAdded"), F.asc("StockID")],
                              {"_lot_rank": F.lit(1).cast("long")})
        mine = ranked.where(F.col("_lot_rank") <= wave_size).drop("_lot_rank")
        res = cut_lineage(mine.groupBy("ProductID").cogroup(wr.groupBy("ProductID"))
                          .applyInPandas(_serve_group, _OUT_SCHEMA))
        served.append(res)
        if w < last:
            now = res.where(F.col("kind") == "lot").select("StockID", F.col("QuantityAdded").alias("_now"))
            lots = cut_lineage(lots.join(now, "StockID", "left").select(
                "ProductID", "StockID", F.coalesce("_now", "QuantityAdded").alias("QuantityAdded")))
    spark = stock.sparkSession
    t = spark.createDataFrame([], "request_id long, StockID long")
    used = spark.createDataFrame([], "StockID long, QuantityAdded long")
    rj = bad
    for res in served:
        t = t.unionByName(res.where(F.col("kind") == "take").select("request_id", "StockID"))
        rj = rj.unionByName(res.where(F.col("kind") == "reject").select(
            "request_id", F.lit(NO_LOT).alias("reason")))
        used = used.unionByName(res.where(F.col("kind") == "take").select("StockID", "QuantityAdded"))
    # What was taken from each changed lot; all other lots pass by a left join.
    used = used.groupBy("StockID").agg(F.sum("QuantityAdded").alias("_used"))
    new_stock = (stock.join(used, "StockID", "left")
                 .withColumn("QuantityAdded", F.col("QuantityAdded") - F.coalesce("_used", F.lit(0)))
                 .select(*stock.columns))
    return Reserved(new_stock, t, rj)
