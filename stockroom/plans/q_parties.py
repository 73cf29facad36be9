"""Registered catalogue, supplier, user and search queries."""

from __future__ import annotations

from ..operators import parties as PT
from pyspark.sql import functions as F

from .. import params as P
from ..functions import option_name
from ..operators import search_index as SI
from ..operators import stock as S
from ..session import cut_lineage
from .q_stock import RECEIPTS
from .registry import query

def _shown(c, default):
    """Oracle of a display default: empty text (also "0") shows as the default."""
    return f"COALESCE(NULLIF(NULLIF({c}, ''), '0'), '{default}')"


_SUPPLIER_TEXT = ", ".join(f"{_shown(c, P.DASH)} AS {a}" for c, a in (
    ("ContactInfo", "ContactText"), ("Email", "EmailText"), ("Phone", "PhoneText")))


@query("product_list", "SELECT * FROM products ORDER BY ProductID")
def q_product_list(t):
    """All products ordered by id."""
    return PT.product_list(t.products)


@query("product_detail", """
SELECT *, CASE WHEN Description IS NULL OR Description IN ('', '0') THEN 'No description available.'
               ELSE Description END AS DescriptionText FROM products
""")
def q_product_detail(t):
    """All products with the display text for their description."""
    return PT.product_detail(t.products)


@query("supplier_list", "SELECT * FROM suppliers")
def q_supplier_list(t):
    """All suppliers."""
    return t.suppliers


@query("product_options", "SELECT ProductID, Name FROM products ORDER BY Name, ProductID")
def q_product_options(t):
    """(ProductID, Name) sorted by name."""
    return PT.options(t.products, "ProductID")


@query("supplier_options", "SELECT SupplierID, Name FROM suppliers ORDER BY Name, SupplierID")
def q_supplier_options(t):
    """(SupplierID, Name) sorted by name."""
    return PT.options(t.suppliers, "SupplierID")


@query("category_list", "SELECT DISTINCT Category FROM products ORDER BY Category")
def q_category_list(t):
    """Distinct product categories."""
    return PT.category_list(t.products)


@query("product_lookup", """
SELECT * FROM products WHERE ProductID IN (SELECT ProductID FROM sale_requests)
""")
def q_product_lookup(t):
    """Products named by the sale requests that exist."""
    return PT.product_lookup(t.products, t.sale_requests)


@query("product_lookup_missing", """
SELECT DISTINCT ProductID FROM sale_requests
WHERE ProductID IS NOT NULL AND ProductID NOT IN (SELECT ProductID FROM products)
""")
def q_product_lookup_missing(t):
    """Product ids named by the sale requests that do not exist."""
    return PT.product_lookup_missing(t.products, t.sale_requests)


@query("user_roles", """
SELECT u.UserID, u.Username, u.RoleID, r.RoleName,
       CASE regexp_replace(lower(trim(COALESCE(r.RoleName, ''))), '\\s+', '', 'g')
            WHEN 'admin' THEN 'admin' WHEN 'customer' THEN 'customer' ELSE 'staff' END AS Role
FROM users u LEFT JOIN roles r ON u.RoleID = r.RoleID
""")
def q_user_roles(t):
    """Users with raw and cleaned role (admin / customer / staff)."""
    return PT.user_roles(t.users, t.roles)


@query("product_suppliers", f"""
SELECT ProductID, SupplierID, Name, ContactInfo, Email, Phone, {_SUPPLIER_TEXT}
FROM (FROM supplier_products SEMI JOIN products USING (ProductID)) pairs NATURAL JOIN suppliers
""")
def q_product_suppliers(t):
    """Every product's linked suppliers (bridge join over the whole link table)."""
    return PT.product_suppliers(t.products, t.suppliers, t.supplier_products)


@query("available_suppliers", f"""
SELECT suppliers.*, Name || ' (' || {_shown('Email', P.NO_EMAIL)} || ')' AS OptionText
FROM suppliers, linked WHERE unknown = 0 AND NOT list_contains(COALESCE(ids, []), SupplierID)
""", extra_ctes="""
linked AS (SELECT COUNT(*) FILTER (WHERE SupplierID IS NULL) AS unknown, list(SupplierID) AS ids
           FROM supplier_products WHERE ProductID = 7)
""")
def q_available_suppliers(t):
    """Suppliers not yet linked to product 7 (null-aware NOT IN)."""
    return PT.available_suppliers(t.suppliers, t.supplier_products, t.params.product_id)


@query("product_search", """
SELECT * FROM products
WHERE contains(lower(Name), 'sma') OR contains(lower(Category), 'sma')
""")
def q_product_search(t):
    """Products whose name or category contains "sMa", ignoring case."""
    return PT.product_search(t.products, term=t.params.search_term)


@query("category_filter", "SELECT * FROM products WHERE lower(Category) = 'small'")
def q_category_filter(t):
    """Products in category "small", ignoring case."""
    return PT.product_search(t.products, category=t.params.category)


@query("product_search_in_category", """
SELECT * FROM products
WHERE (contains(lower(Name), 'ring') OR contains(lower(Category), 'ring')) AND lower(Category) = 'small'
""")
def q_product_search_in_category(t):
    """Search "ring" within category "small" (the two filters compose)."""
    return PT.product_search(t.products, term="ring", category=t.params.category)


@query("product_search_count", """
SELECT COUNT(*) AS Showing FROM products
WHERE contains(lower(Name), 'sma') OR contains(lower(Category), 'sma')
""")
def q_product_search_count(t):
    """Number of products left visible by the "sMa" search."""
    return PT.visible_count(PT.product_search(t.products, term=t.params.search_term))


_CURRENT = """
current AS (
  SELECT p.ProductID, p.Name AS ProductName, p.Category,
         COALESCE(a.TotalAdded, 0) AS TotalAdded, COALESCE(s.TotalSold, 0) AS TotalSold,
         COALESCE(a.TotalAdded, 0) - COALESCE(s.TotalSold, 0) AS CurrentStock,
         CASE WHEN COALESCE(a.TotalAdded, 0) - COALESCE(s.TotalSold, 0) <= 0 THEN 'Out of Stock'
              WHEN COALESCE(a.TotalAdded, 0) - COALESCE(s.TotalSold, 0) < 10 THEN 'Low Stock'
              ELSE 'In Stock' END AS Status
  FROM products p
  LEFT JOIN (SELECT ProductID, CAST(SUM(QuantityAdded) AS BIGINT) AS TotalAdded FROM stock GROUP BY 1) a
    ON p.ProductID = a.ProductID
  LEFT JOIN (SELECT ProductID, CAST(SUM(QuantitySold) AS BIGINT) AS TotalSold FROM sales GROUP BY 1) s
    ON p.ProductID = s.ProductID)
"""

_STOCK_CELLS = ["ProductName", "Category", "TotalAdded", "TotalSold", "CurrentStock", "Status"]


def _sql_any_contains(cols, term):
    return " OR ".join(f"contains(lower(CAST({c} AS VARCHAR)), '{term.lower()}')" for c in cols)


@query("stock_search", f"SELECT * FROM current WHERE {_sql_any_contains(_STOCK_CELLS, 'low')}",
       extra_ctes=_CURRENT)
def q_stock_search(t):
    """Current-stock rows whose displayed text (including the status) contains "low"."""
    return PT.search_rows(S.current_stock(t.products, t.stock, t.sales), t.params.stock_search_term,
                          _STOCK_CELLS)


_RECEIPT_CELLS = ["StockID", "ProductName", "SupplierName", "QuantityAdded", "DateAdded"]


@query("receipt_search", f"""
SELECT * FROM (SELECT * EXCLUDE (ProductID, SupplierID) FROM newest) r
WHERE {_sql_any_contains(_RECEIPT_CELLS, 'bolt')}
""", extra_ctes=RECEIPTS)
def q_receipt_search(t):
    """Latest-receipt rows whose displayed text contains "bolt"."""
    return PT.search_rows(S.recent_receipts(t.stock, t.products, t.suppliers), t.params.receipt_search_term,
                          _RECEIPT_CELLS)


_SUPPLIER_STOCK_CELLS = ["SupplierName", "ProductName", "TotalSupplied"]


@query("supplier_stock_search", f"""
SELECT * FROM (
  SELECT x.SupplierID, x.ProductID, sup.Name AS SupplierName, p.Name AS ProductName, x.TotalSupplied
  FROM (SELECT SupplierID, ProductID, CAST(SUM(QuantityAdded) AS BIGINT) AS TotalSupplied
        FROM stock GROUP BY SupplierID, ProductID) x
  JOIN products p ON x.ProductID = p.ProductID JOIN suppliers sup ON x.SupplierID = sup.SupplierID) r
WHERE {_sql_any_contains(_SUPPLIER_STOCK_CELLS, 'ring')}
""")
def q_supplier_stock_search(t):
    """Per-supplier stock rows whose displayed text contains "ring"."""
    return PT.search_rows(S.stock_by_supplier(t.stock, t.products, t.suppliers),
                          t.params.supplier_search_term, _SUPPLIER_STOCK_CELLS)


@query("product_list_desc", "SELECT * FROM products ORDER BY ProductID DESC")
def q_product_list_desc(t):
    """All products, newest id first (the listing shown after a write)."""
    return PT.product_list(t.products, descending=True)


@query("sale_option_names", """
SELECT ProductID, trim(string_split(Name || ' - $' || CAST(Price AS VARCHAR), '-')[1]) AS OptionName FROM products
""")
def q_sale_option_names(t):
    """The product name read back from each sale-form option label ("name - $price")."""
    label = F.concat("Name", F.lit(" - $"), F.col("Price").cast("string"))
    return t.products.select("ProductID", option_name(label).alias("OptionName"))


def _by_index(rows, key, cells, term):
    return SI.indexed_search(rows, cut_lineage(SI.build_index(rows, key, cells)), term, key, cells)


_PRODUCT_CELLS = ["Name", "Category"]


@query("product_search_indexed", f"SELECT * FROM products WHERE {_sql_any_contains(_PRODUCT_CELLS, 'sma')}")
def q_product_search_indexed(t):
    """Products whose name or category contains "sMa", by the trigram index."""
    return _by_index(t.products, ["ProductID"], _PRODUCT_CELLS, t.params.search_term)


@query("stock_search_indexed", f"SELECT * FROM current WHERE {_sql_any_contains(_STOCK_CELLS, 'low')}", extra_ctes=_CURRENT)
def q_stock_search_indexed(t):
    """Current-stock rows whose displayed text contains "low", by the trigram index."""
    rows = cut_lineage(S.current_stock(t.products, t.stock, t.sales))
    return _by_index(rows, ["ProductID"], _STOCK_CELLS, t.params.stock_search_term)


@query("lot_search_indexed", f"""
SELECT * FROM (
  SELECT st.StockID, st.DateAdded, p.Name AS ProductName, sup.Name AS SupplierName, st.QuantityAdded
  FROM stock st JOIN products p ON st.ProductID = p.ProductID JOIN suppliers sup ON st.SupplierID = sup.SupplierID) r
WHERE {_sql_any_contains(["StockID", "ProductName", "SupplierName", "QuantityAdded"], 'bolt')}
""")
def q_lot_search_indexed(t):
    """All receipt lots, not only the newest ten, whose number, names or quantity contain "bolt", by the trigram index."""
    names = t.products.select("ProductID", F.col("Name").alias("ProductName"))
    rows = cut_lineage(t.stock.select("StockID", "ProductID", "SupplierID", "QuantityAdded", "DateAdded").join(names, "ProductID")
                       .join(t.suppliers.select("SupplierID", F.col("Name").alias("SupplierName")), "SupplierID")
                       .drop("ProductID", "SupplierID"))
    return _by_index(rows, ["StockID"], ["StockID", "ProductName", "SupplierName", "QuantityAdded"], t.params.receipt_search_term)


@query("supplier_stock_search_indexed", f"""
SELECT * FROM (
  SELECT SupplierID, ProductID, sup.Name AS SupplierName, p.Name AS ProductName, CAST(SUM(QuantityAdded) AS BIGINT) AS TotalSupplied
  FROM stock JOIN products p USING (ProductID) JOIN suppliers sup USING (SupplierID) GROUP BY ALL) r
WHERE {_sql_any_contains(_SUPPLIER_STOCK_CELLS, 'ring')}
""")
def q_supplier_stock_search_indexed(t):
    """Per-supplier stock rows whose displayed text contains "ring", by the trigram index."""
    rows = cut_lineage(S.stock_by_supplier(t.stock, t.products, t.suppliers))
    return _by_index(rows, ["SupplierID", "ProductID"], _SUPPLIER_STOCK_CELLS, t.params.supplier_search_term)
