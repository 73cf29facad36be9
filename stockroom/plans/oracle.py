"""DuckDB oracle text.

``ADAPTER`` is the same column mapping as ``sources.retail.RetailTables
.from_testdata``, written as CTEs over the pre-registered test tables.  Each
oracle query is ``with_adapter(body)`` or ``with_adapter(body, extra_ctes)``.
"""

from __future__ import annotations

ADAPTER = """
products AS (
  SELECT p_partkey AS ProductID, p_name AS Name, p_type AS Category,
         CAST(p_retailprice AS DECIMAL(12,2)) AS Price, p_brand AS Description
  FROM part),
suppliers AS (
  SELECT s_suppkey AS SupplierID, s_name AS Name, s_name AS ContactInfo,
         CASE WHEN s_suppkey % 3 = 0 THEN NULL
              ELSE 'supplier' || CAST(s_suppkey AS VARCHAR) || '@example.com' END AS Email,
         CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE '555-' || CAST(s_suppkey AS VARCHAR) END AS Phone
  FROM supplier),
stock AS (
  SELECT (l_orderkey * 8 + l_linenumber) * 65536
           + row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice,
                                         l_discount, l_tax, l_returnflag, l_shipdate) - 1 AS StockID,
         l_partkey AS ProductID, l_suppkey AS SupplierID,
         CASE WHEN l_partkey % 40 = 0 THEN CAST(l_quantity AS BIGINT) % 2 ELSE CAST(l_quantity AS BIGINT) END
           AS QuantityAdded, l_shipdate AS DateAdded
  FROM lineitem WHERE l_linestatus = 'O'),
supplier_products AS (
  SELECT DISTINCT l_suppkey AS SupplierID, l_partkey AS ProductID
  FROM lineitem WHERE l_linestatus = 'O'),
sales AS (
  SELECT (l.l_orderkey * 8 + l.l_linenumber) * 65536
           + row_number() OVER (PARTITION BY l.l_orderkey, l.l_linenumber
                                ORDER BY l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice,
                                         l.l_discount, l.l_tax, l.l_returnflag, l.l_shipdate) - 1 AS SaleID,
         l.l_partkey AS ProductID, CAST(l.l_quantity AS BIGINT) AS QuantitySold,
         l.l_shipdate AS SaleDate,
         CAST(CAST(l.l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2)))
              AS DECIMAL(14,2)) AS TotalAmount,
         o.o_custkey AS UserID
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  WHERE l.l_linestatus = 'F'),
users AS (
  SELECT c_custkey AS UserID, c_name AS Username, CAST(c_nationkey AS BIGINT) AS RoleID FROM customer),
roles AS (
  SELECT CAST(n_nationkey AS BIGINT) AS RoleID,
         CASE n_nationkey % 4 WHEN 0 THEN ' Admin ' WHEN 1 THEN 'Custo mer' WHEN 2 THEN 'STAFF'
              ELSE n_name END AS RoleName
  FROM nation WHERE n_nationkey < 24),
cart_events AS (
  SELECT event_id, ts, user_id, user_id % 199 AS product_id,
         CASE event_type WHEN 'purchase' THEN 'buy' WHEN 'error' THEN 'remove' ELSE 'add' END AS action,
         event_id % 3 + 1 AS quantity
  FROM events),
sale_requests AS (
  SELECT event_id AS request_id, ts,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) = 99 THEN -1
              ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS ProductID,
         CASE WHEN event_id % 50 = 0 THEN 'abc' WHEN event_id % 51 = 0 THEN '0'
              WHEN event_id % 53 = 0 THEN '9000000000000000000' WHEN event_id % 54 = 0 THEN '1e30'
              WHEN event_id % 55 = 0 THEN '5.0' WHEN event_id % 57 = 0 THEN ' 1e1' WHEN event_id % 59 = 0 THEN '5.5'
              ELSE CAST(event_id % 60 + 1 AS VARCHAR) END AS Quantity,
         CASE WHEN event_id % 61 = 0 THEN '1e20' WHEN event_id % 62 = 0 THEN '0.00001'
              WHEN event_id % 63 = 0 THEN '99999999'
              ELSE CASE event_id % 4 WHEN 0 THEN '10' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'x' END END AS Discount,
         user_id AS UserID
  FROM events),
product_requests AS (
  SELECT p_partkey AS request_id,
         CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_name || ' ' END AS product_name,
         CASE WHEN p_partkey % 11 = 0 THEN '0' ELSE lower(p_type) END AS category,
         CASE WHEN p_partkey % 13 = 0 THEN '-5' WHEN p_partkey % 17 = 0 THEN 'abc'
              WHEN p_partkey % 19 = 0 THEN '99999999999' WHEN p_partkey % 23 = 0 THEN '1e30'
              ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) || 'x' END AS price,
         p_brand AS description
  FROM part),
receipt_requests AS (
  SELECT event_id AS request_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id,
         user_id AS supplier_id,
         CASE WHEN event_id % 25 = 0 THEN '0' WHEN event_id % 40 = 0 THEN 'many'
              WHEN event_id % 41 = 0 THEN '5.0' WHEN event_id % 42 = 0 THEN '5.5' WHEN event_id % 43 = 0 THEN '1e30'
              ELSE CAST(event_id % 30 + 1 AS VARCHAR) END AS quantity,
         ts AS date_added
  FROM events),
product_edits AS (
  SELECT (request_id // 2) * 3 AS ProductID, * FROM product_requests),
supplier_requests AS (
  SELECT c_custkey AS request_id,
         CASE WHEN c_custkey % 9 = 0 THEN '  ' ELSE ' ' || c_name END AS name,
         c_mktsegment AS contact_info, lower(c_mktsegment) || '@mail.test' AS email,
         CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '+1-' || CAST(c_custkey AS VARCHAR) END AS phone,
         CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 200 ELSE NULL END AS link_product
  FROM customer)
"""


_NUMBER = "[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?"


def whole(c: str) -> str:
    """A whole number of units given as text in any numeric form; NULL otherwise."""
    v = f"TRY_CAST(trim({c}) AS DECIMAL(38,10))"
    return f"CASE WHEN regexp_full_match(trim({c}), '{_NUMBER}') AND {v} = floor({v}) THEN TRY_CAST({v} AS BIGINT) END"


def percent(c: str) -> str:
    """A discount: numeric text, else 0; NULL if it is too large."""
    return (f"CASE WHEN regexp_full_match(trim({c}), '{_NUMBER}') THEN TRY_CAST(trim({c}) AS DECIMAL(16,8)) "
            "ELSE CAST(0 AS DECIMAL(16,8)) END")


def amount(price: str, quantity: str, pct: str, digits: int) -> str:
    """What a quantity costs after the discount; NULL if it or the subtotal is too large."""
    sub = f"TRY_CAST({price} * {quantity} AS DECIMAL(18,2))"
    share = f"CAST({pct} * 0.01 AS DECIMAL(16,10))"  # wide enough for the product's 38 digits
    return f"TRY_CAST(ROUND({sub} - CAST({sub} AS DECIMAL(22,2)) * {share}, 2) AS DECIMAL({digits},2))"


def with_adapter(body: str, extra_ctes: str = "", recursive: bool = False) -> str:
    ctes = ADAPTER.strip()
    if extra_ctes.strip():
        ctes = ctes + ",\n" + extra_ctes.strip()
    head = "WITH RECURSIVE" if recursive else "WITH"
    return f"{head} {ctes}\n{body.strip()}"
