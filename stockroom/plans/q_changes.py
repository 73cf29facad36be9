"""Registered change-apply jobs (new rows / new tables and rejects)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cart as C
from ..operators import changes as X
from ..operators import stock as S
from .oracle import whole
from .q_cart import _CART
from .registry import query

_PRICE = ("TRY_CAST(ROUND(TRY_CAST(COALESCE(TRY_CAST(NULLIF(regexp_extract(ltrim(price), "
          "'^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?', 0), '') AS DOUBLE), 0) "
          "AS DECIMAL(38,10)), 2) AS DECIMAL(12,2))")
_EMPTY = "({c} IS NULL OR {c} IN ('', '0'))"
_BAD_PRODUCT = (f"({_EMPTY.format(c='_name')} OR {_EMPTY.format(c='_cat')} OR _price IS NULL OR _price <= 0)")

_INTAKE = f"""
req AS (
  SELECT request_id, trim(product_name) AS _name, trim(category) AS _cat, {_PRICE} AS _price,
         trim(description) AS _desc
  FROM product_requests)
"""


@query("product_intake", f"""
SELECT (SELECT COALESCE(MAX(ProductID), 0) FROM products) + row_number() OVER (ORDER BY request_id) AS ProductID,
       _name AS Name, _cat AS Category, _price AS Price, _desc AS Description, request_id
FROM req WHERE NOT {_BAD_PRODUCT}
""", extra_ctes=_INTAKE)
def q_product_intake(t):
    """Validated new products with ids after the current maximum."""
    return X.product_intake(t.products, t.product_requests).accepted


@query("product_intake_rejects", f"""
SELECT request_id, 'invalid product fields' AS reason FROM req WHERE {_BAD_PRODUCT}
""", extra_ctes=_INTAKE)
def q_product_intake_rejects(t):
    """Product requests rejected by validation."""
    return X.product_intake(t.products, t.product_requests).rejects


EDITS = f"""
ed AS (
  SELECT ProductID, request_id, trim(product_name) AS _name, trim(category) AS _cat, {_PRICE} AS _price,
         trim(description) AS _desc,
         ProductID IN (SELECT ProductID FROM products) AS known
  FROM product_edits),
last AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY ProductID ORDER BY request_id DESC) AS rn
    FROM ed WHERE known AND NOT {_BAD_PRODUCT}) x
  WHERE rn = 1)
"""


UPSERTED = """
SELECT p.ProductID,
       CASE WHEN l.ProductID IS NULL THEN p.Name ELSE l._name END AS Name,
       CASE WHEN l.ProductID IS NULL THEN p.Category ELSE l._cat END AS Category,
       CASE WHEN l.ProductID IS NULL THEN p.Price ELSE l._price END AS Price,
       CASE WHEN l.ProductID IS NULL THEN p.Description ELSE l._desc END AS Description
FROM products p LEFT JOIN last l ON p.ProductID = l.ProductID
"""


@query("product_upsert", UPSERTED, extra_ctes=EDITS)
def q_product_upsert(t):
    """Products table after applying the edits (last valid edit per id wins)."""
    return X.product_upsert(t.products, t.product_edits).accepted


@query("product_upsert_rejects", f"""
SELECT request_id, CASE WHEN NOT known THEN 'product not found' ELSE 'invalid product fields' END AS reason
FROM ed WHERE NOT known OR {_BAD_PRODUCT}
""", extra_ctes=EDITS)
def q_product_upsert_rejects(t):
    """Edits rejected: unknown product id or invalid fields."""
    return X.product_upsert(t.products, t.product_edits).rejects


# ---- cascading deletes --------------------------------------------------------
_PROMO = "SELECT ProductID FROM products WHERE Category = 'PROMO'"


def _promo_keys(t):
    return t.products.where(F.col("Category") == "PROMO").select("ProductID")


def _deleted_products(t):
    return X.delete_products(t.products, t.stock, t.sales, t.supplier_products, _promo_keys(t))


@query("delete_products_products", f"SELECT * FROM products WHERE ProductID NOT IN ({_PROMO})")
def q_delete_products_products(t):
    """Products left after deleting the PROMO category's products."""
    return _deleted_products(t).products


@query("delete_products_stock", f"SELECT * FROM stock WHERE ProductID NOT IN ({_PROMO})")
def q_delete_products_stock(t):
    """Stock lots left after the cascading product delete."""
    return _deleted_products(t).stock


@query("delete_products_sales", f"SELECT * FROM sales WHERE ProductID NOT IN ({_PROMO})")
def q_delete_products_sales(t):
    """Sales left after the cascading product delete."""
    return _deleted_products(t).sales


@query("delete_products_links", f"SELECT * FROM supplier_products WHERE ProductID NOT IN ({_PROMO})")
def q_delete_products_links(t):
    """Supplier links left after the cascading product delete."""
    return _deleted_products(t).supplier_products


_NOPHONE = "SELECT SupplierID FROM suppliers WHERE Phone = ''"


def _deleted_suppliers(t):
    keys = t.suppliers.where(F.col("Phone") == "").select("SupplierID")
    return X.delete_suppliers(t.suppliers, t.stock, t.sales, t.supplier_products, keys)


@query("delete_suppliers_suppliers", f"SELECT * FROM suppliers WHERE SupplierID NOT IN ({_NOPHONE})")
def q_delete_suppliers_suppliers(t):
    """Suppliers left after deleting those without a phone number."""
    return _deleted_suppliers(t).suppliers


@query("delete_suppliers_stock", f"SELECT * FROM stock WHERE SupplierID NOT IN ({_NOPHONE})")
def q_delete_suppliers_stock(t):
    """Stock lots left after the cascading supplier delete."""
    return _deleted_suppliers(t).stock


@query("delete_suppliers_links", f"SELECT * FROM supplier_products WHERE SupplierID NOT IN ({_NOPHONE})")
def q_delete_suppliers_links(t):
    """Supplier links left after the cascading supplier delete."""
    return _deleted_suppliers(t).supplier_products


@query("delete_suppliers_net_stock", f"""
SELECT p.ProductID, p.Name AS ProductName, p.Category,
       COALESCE(a.TotalAdded, 0) AS TotalAdded, COALESCE(s.TotalSold, 0) AS TotalSold,
       COALESCE(a.TotalAdded, 0) - COALESCE(s.TotalSold, 0) AS CurrentStock,
       CASE WHEN COALESCE(a.TotalAdded, 0) - COALESCE(s.TotalSold, 0) <= 0 THEN 'Out of Stock'
            WHEN COALESCE(a.TotalAdded, 0) - COALESCE(s.TotalSold, 0) < 10 THEN 'Low Stock'
            ELSE 'In Stock' END AS Status
FROM products p
LEFT JOIN (SELECT ProductID, CAST(SUM(QuantityAdded) AS BIGINT) AS TotalAdded FROM stock
           WHERE SupplierID NOT IN ({_NOPHONE}) GROUP BY ProductID) a ON p.ProductID = a.ProductID
LEFT JOIN (SELECT ProductID, CAST(SUM(QuantitySold) AS BIGINT) AS TotalSold FROM sales GROUP BY ProductID) s
  ON p.ProductID = s.ProductID
""")
def q_delete_suppliers_net_stock(t):
    """Current stock after the supplier delete (sales kept, so it can go negative)."""
    d = _deleted_suppliers(t)
    return S.current_stock(t.products, d.stock, d.sales)


# ---- supplier intake and links ------------------------------------------------
_SUP = """
sreq AS (
  SELECT request_id, link_product, trim(name) AS name, trim(contact_info) AS contact_info,
         trim(email) AS email, trim(phone) AS phone
  FROM supplier_requests),
sok AS (
  SELECT (SELECT COALESCE(MAX(SupplierID), 0) FROM suppliers) + row_number() OVER (ORDER BY request_id)
           AS SupplierID, *
  FROM sreq WHERE NOT (name IS NULL OR name IN ('', '0')))
"""


@query("supplier_intake", """
SELECT SupplierID, name AS Name, contact_info AS ContactInfo, email AS Email, phone AS Phone, request_id FROM sok
""", extra_ctes=_SUP)
def q_supplier_intake(t):
    """New suppliers from the product-page form (trimmed, name required)."""
    return X.supplier_intake(t.suppliers, t.supplier_requests).suppliers


@query("supplier_intake_links", """
SELECT SupplierID, link_product AS ProductID FROM sok WHERE link_product IS NOT NULL
""", extra_ctes=_SUP)
def q_supplier_intake_links(t):
    """Links created for new suppliers added to a product."""
    return X.supplier_intake(t.suppliers, t.supplier_requests).links


@query("supplier_intake_rejects", """
SELECT request_id, 'supplier name required' AS reason FROM sreq WHERE name IS NULL OR name IN ('', '0')
""", extra_ctes=_SUP)
def q_supplier_intake_rejects(t):
    """Supplier requests without a name."""
    return X.supplier_intake(t.suppliers, t.supplier_requests).rejects


@query("supplier_intake_unvalidated", """
SELECT (SELECT COALESCE(MAX(SupplierID), 0) FROM suppliers) + row_number() OVER (ORDER BY request_id) AS SupplierID,
       name AS Name, contact_info AS ContactInfo, email AS Email, phone AS Phone, request_id
FROM supplier_requests
""")
def q_supplier_intake_unvalidated(t):
    """New suppliers from the suppliers page (stored as sent, no validation)."""
    return X.supplier_intake(t.suppliers, t.supplier_requests, validate=False).suppliers


def _pairs(t):
    return t.receipt_requests.select("request_id", F.col("supplier_id").alias("SupplierID"),
                                     F.col("product_id").alias("ProductID"))


@query("link_suppliers", """
SELECT DISTINCT SupplierID, ProductID FROM (
  SELECT supplier_id AS SupplierID, product_id AS ProductID FROM receipt_requests
  WHERE NOT (supplier_id IS NULL OR supplier_id = 0)
  UNION ALL SELECT SupplierID, ProductID FROM supplier_products) x
""")
def q_link_suppliers(t):
    """Link table after adding the requested (supplier, product) pairs."""
    return X.link_suppliers(t.supplier_products, _pairs(t)).accepted


@query("link_suppliers_rejects", """
SELECT request_id, 'supplier required' AS reason FROM receipt_requests WHERE supplier_id IS NULL OR supplier_id = 0
""")
def q_link_suppliers_rejects(t):
    """Link requests without a supplier."""
    return X.link_suppliers(t.supplier_products, _pairs(t)).rejects


@query("unlink_suppliers", """
SELECT * FROM supplier_products sp
WHERE NOT EXISTS (SELECT 1 FROM receipt_requests r
                  WHERE r.supplier_id = sp.SupplierID AND r.product_id = sp.ProductID)
""")
def q_unlink_suppliers(t):
    """Link table after removing the requested pairs."""
    return X.unlink_suppliers(t.supplier_products, _pairs(t))


# ---- stock receipts -----------------------------------------------------------
RECEIVED = f"""
rq AS (
  SELECT r.request_id, r.product_id AS ProductID, r.supplier_id AS SupplierID,
         {whole('r.quantity')} AS QuantityAdded,
         COALESCE(r.date_added, TIMESTAMP '2000-06-15 00:00:00') AS DateAdded,
         p.ProductID IS NOT NULL AS pk, s.SupplierID IS NOT NULL AS sk
  FROM receipt_requests r
  LEFT JOIN products p ON r.product_id = p.ProductID
  LEFT JOIN suppliers s ON r.supplier_id = s.SupplierID),
rq2 AS (
  SELECT *, CASE WHEN ProductID IS NULL OR ProductID = 0 OR SupplierID IS NULL OR SupplierID = 0
                      OR QuantityAdded IS NULL OR QuantityAdded <= 0 THEN 'invalid receipt fields'
                 WHEN NOT pk THEN 'unknown product' WHEN NOT sk THEN 'unknown supplier' END AS reason
  FROM rq)
"""


@query("receive_stock", """
SELECT (SELECT COALESCE(MAX(StockID), 0) FROM stock) + row_number() OVER (ORDER BY request_id) AS StockID,
       ProductID, SupplierID, QuantityAdded, DateAdded, request_id
FROM rq2 WHERE reason IS NULL
""", extra_ctes=RECEIVED)
def q_receive_stock(t):
    """New stock lots from valid receipt requests."""
    return X.receive_stock(t.stock, t.supplier_products, t.products, t.suppliers, t.receipt_requests,
                           t.params.as_of).stock


@query("receive_stock_links", """
SELECT DISTINCT SupplierID, ProductID FROM rq2 r WHERE reason IS NULL
AND NOT EXISTS (SELECT 1 FROM supplier_products sp WHERE sp.SupplierID = r.SupplierID AND sp.ProductID = r.ProductID)
""", extra_ctes=RECEIVED)
def q_receive_stock_links(t):
    """Supplier-product links created by the receipts."""
    return X.receive_stock(t.stock, t.supplier_products, t.products, t.suppliers, t.receipt_requests,
                           t.params.as_of).links


@query("receive_stock_rejects", "SELECT request_id, reason FROM rq2 WHERE reason IS NOT NULL", extra_ctes=RECEIVED)
def q_receive_stock_rejects(t):
    """Receipt requests rejected, with the reason."""
    return X.receive_stock(t.stock, t.supplier_products, t.products, t.suppliers, t.receipt_requests,
                           t.params.as_of).rejects


# ---- release ----------------------------------------------------------------
_BACK = """
back AS (SELECT product_id AS ProductID, SUM(quantity) AS b FROM eps
         WHERE closer_action = 'remove' AND adds > 0 GROUP BY product_id)
"""


def _removals(t):
    return C.cart_removals(C.cart_episodes(t.cart_events, t.products))


@query("release_stock", """
SELECT s.StockID, s.ProductID, s.SupplierID, s.QuantityAdded + COALESCE(b.b, 0) AS QuantityAdded, s.DateAdded
FROM stock s LEFT JOIN back b ON s.ProductID = b.ProductID
""", extra_ctes=_CART + "," + _BACK)
def q_release_stock(t):
    """Stock after cart removals: every lot of the product gets the quantity back."""
    return X.release_stock(t.stock, _removals(t))


@query("release_stock_once", """
SELECT s.StockID, s.ProductID, s.SupplierID,
       s.QuantityAdded + CASE WHEN s.StockID = f.first_id THEN COALESCE(b.b, 0) ELSE 0 END AS QuantityAdded,
       s.DateAdded
FROM stock s LEFT JOIN back b ON s.ProductID = b.ProductID
LEFT JOIN (SELECT ProductID, MIN(StockID) AS first_id FROM stock GROUP BY ProductID) f ON s.ProductID = f.ProductID
""", extra_ctes=_CART + "," + _BACK)
def q_release_stock_once(t):
    """Stock after cart removals, returning each quantity to one lot only (correction)."""
    return X.release_stock(t.stock, _removals(t), every_lot=False)
