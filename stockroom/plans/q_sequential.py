"""Registered order-dependent jobs (also checked against a Python loop in tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequential as Q
from .oracle import amount, percent, whole
from .registry import query


def _recorded(t):
    return Q.record_sales(t.products, t.stock, t.sales, t.sale_requests)


# The oracle folds each product's valid requests in order with a recursive
# CTE (one step per request), independent of the Spark rounds algorithm.
FOLD = f"""
r0 AS (SELECT request_id, ts, ProductID, {whole('Quantity')} AS q, {percent('Discount')} AS pct, UserID
       FROM sale_requests),
r1 AS (SELECT r0.*, p.Price,
              CASE WHEN r0.q IS NULL OR r0.q <= 0 THEN 'Invalid quantity specified'
                   WHEN p.ProductID IS NULL THEN 'Product not found'
                   WHEN {amount('p.Price', 'r0.q', 'r0.pct', 14)} IS NULL THEN 'Amount out of range' END AS reason0
       FROM r0 LEFT JOIN products p ON r0.ProductID = p.ProductID),
numbered AS (SELECT *, row_number() OVER (PARTITION BY ProductID ORDER BY ts, request_id) AS rn
             FROM r1 WHERE reason0 IS NULL),
avail AS (SELECT k.ProductID, COALESCE(a.TotalAdded, 0) - COALESCE(s.TotalSold, 0) AS s
          FROM (SELECT DISTINCT ProductID FROM numbered) k
          LEFT JOIN (SELECT ProductID, SUM(QuantityAdded) AS TotalAdded FROM stock GROUP BY ProductID) a
            ON k.ProductID = a.ProductID
          LEFT JOIN (SELECT ProductID, SUM(QuantitySold) AS TotalSold FROM sales GROUP BY ProductID) s
            ON k.ProductID = s.ProductID),
fold AS (
  SELECT n.ProductID, n.rn, n.request_id, n.q <= a.s AS ok,
         CASE WHEN n.q <= a.s THEN a.s - n.q ELSE a.s END AS lft
  FROM numbered n JOIN avail a ON n.ProductID = a.ProductID WHERE n.rn = 1
  UNION ALL
  SELECT n.ProductID, n.rn, n.request_id, n.q <= f.lft AS ok,
         CASE WHEN n.q <= f.lft THEN f.lft - n.q ELSE f.lft END AS lft
  FROM fold f JOIN numbered n ON n.ProductID = f.ProductID AND n.rn = f.rn + 1)
"""

RECORDED = f"""
SELECT (SELECT COALESCE(MAX(SaleID), 0) FROM sales) + row_number() OVER (ORDER BY n.ts, n.request_id) AS SaleID,
       n.ProductID, n.q AS QuantitySold, n.ts AS SaleDate,
       {amount('n.Price', 'n.q', 'n.pct', 14)} AS TotalAmount,
       n.UserID, n.request_id
FROM numbered n JOIN fold f ON n.request_id = f.request_id WHERE f.ok
"""


@query("record_sales", RECORDED, extra_ctes=FOLD, recursive=True)
def q_record_sales(t):
    """New Sales rows from the sale requests, applied in order against net availability."""
    return _recorded(t).sales


@query("record_sales_rejects", """
SELECT request_id, reason0 AS reason FROM r1 WHERE reason0 IS NOT NULL
UNION ALL
SELECT request_id, 'Insufficient stock' AS reason FROM fold WHERE NOT ok
""", extra_ctes=FOLD, recursive=True)
def q_record_sales_rejects(t):
    """Sale requests rejected: invalid quantity, unknown product or insufficient stock."""
    return _recorded(t).rejects


def _reserve_requests(t):
    return t.cart_events.where(F.col("action") == "add").select(
        F.col("event_id").alias("request_id"), "ts", F.col("product_id").alias("ProductID"),
        F.col("quantity").alias("q"))


def _reserved(t):
    return Q.reserve_stock(t.stock, _reserve_requests(t))


# Oracle: each product's lots travel as a list through a recursive CTE, one
# step per cart add; the step picks the largest lot that covers the request
# (lowest StockID on ties) and decrements it.
_RESERVE = """
rq AS (SELECT event_id AS request_id, ts, product_id AS ProductID, quantity AS q
       FROM cart_events WHERE action = 'add'),
good AS (SELECT *, row_number() OVER (PARTITION BY ProductID ORDER BY ts, request_id) AS rn
         FROM rq WHERE q > 0),
lots0 AS (SELECT ProductID, list({'v': QuantityAdded, 'id': StockID}) AS lots FROM stock
          WHERE ProductID IN (SELECT ProductID FROM good) GROUP BY ProductID),
fold AS (
  SELECT ProductID, rn, request_id, best AS taken_id,
         CASE WHEN best IS NULL THEN lots
              ELSE list_transform(lots, lambda x: CASE WHEN x.id = best THEN {'v': x.v - q, 'id': x.id} ELSE x END)
         END AS lots
  FROM (SELECT g.ProductID, g.rn, g.request_id, g.q, l.lots,
               list_sort(list_transform(list_filter(l.lots, lambda x: x.v >= g.q),
                                        lambda x: {'nv': -x.v, 'id': x.id}))[1].id AS best
        FROM good g LEFT JOIN lots0 l ON g.ProductID = l.ProductID WHERE g.rn = 1) s0
  UNION ALL
  SELECT ProductID, rn, request_id, best AS taken_id,
         CASE WHEN best IS NULL THEN lots
              ELSE list_transform(lots, lambda x: CASE WHEN x.id = best THEN {'v': x.v - q, 'id': x.id} ELSE x END)
         END AS lots
  FROM (SELECT g.ProductID, g.rn, g.request_id, g.q, f.lots,
               list_sort(list_transform(list_filter(f.lots, lambda x: x.v >= g.q),
                                        lambda x: {'nv': -x.v, 'id': x.id}))[1].id AS best
        FROM fold f JOIN good g ON g.ProductID = f.ProductID AND g.rn = f.rn + 1) s1),
final_lots AS (
  SELECT u.l.id AS StockID, u.l.v AS v FROM (
    SELECT unnest(f.lots) AS l FROM fold f
    JOIN (SELECT ProductID, MAX(rn) AS rn FROM good GROUP BY ProductID) m
      ON f.ProductID = m.ProductID AND f.rn = m.rn) u)
"""


@query("reserve_stock", """
SELECT s.StockID, s.ProductID, s.SupplierID, COALESCE(f.v, s.QuantityAdded) AS QuantityAdded, s.DateAdded
FROM stock s LEFT JOIN final_lots f ON s.StockID = f.StockID
""", extra_ctes=_RESERVE, recursive=True)
def q_reserve_stock(t):
    """Stock table after every cart add reserved units from the largest covering lot."""
    return _reserved(t).stock


@query("reserve_stock_taken", "SELECT request_id, taken_id AS StockID FROM fold WHERE taken_id IS NOT NULL",
       extra_ctes=_RESERVE, recursive=True)
def q_reserve_stock_taken(t):
    """For each served cart add, the lot (StockID) it was taken from."""
    return _reserved(t).taken


@query("reserve_stock_rejects", """
SELECT request_id, 'Invalid quantity specified' AS reason FROM rq WHERE q IS NULL OR q <= 0
UNION ALL
SELECT request_id, 'Not enough stock available for this product.' AS reason FROM fold WHERE taken_id IS NULL
""", extra_ctes=_RESERVE, recursive=True)
def q_reserve_stock_rejects(t):
    """Cart adds no single lot could cover."""
    return _reserved(t).rejects
