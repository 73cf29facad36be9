"""Change-apply jobs: validated writes as batch table transforms.

Each job takes the current tables and a request DataFrame and returns the new
rows / new table(s) together with a rejects frame (``request_id``,
``reason``).  Nothing is updated in place: callers hand the returned frames to
``sources.TableStore`` (``append`` for new rows, ``replace`` for whole tables).

New ids are ``max(existing id) + n`` where n numbers the accepted requests in
request order (``scan.number_rows``, no single-task global window).
"""

from __future__ import annotations

import datetime as _dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import php_empty, php_floatval, php_trim, ts_lit, whole_number
from .scan import number_rows

# ---- fixed values: reject reasons -------------------------------------------
INVALID_PRODUCT = "invalid product fields"
PRODUCT_NOT_FOUND = "product not found"
SUPPLIER_NAME_REQUIRED = "supplier name required"
SUPPLIER_REQUIRED = "supplier required"
INVALID_RECEIPT = "invalid receipt fields"
UNKNOWN_PRODUCT = "unknown product"
UNKNOWN_SUPPLIER = "unknown supplier"


class Applied(NamedTuple):
    accepted: DataFrame
    rejects: DataFrame


def _split(df: DataFrame, reason: Column) -> Applied:
    tagged = df.withColumn("reason", reason)
    return Applied(tagged.where(F.col("reason").isNull()).drop("reason"),
                   tagged.where(F.col("reason").isNotNull()).select("request_id", "reason"))


def _next_ids(existing: DataFrame, id_col: str, accepted: DataFrame, out: str) -> DataFrame:
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).scalar()
    return number_rows(accepted, ["request_id"], out, base=top)


def _price(c) -> Column:
    """PHP floatval of the text, stored with cents; NULL if it doesn't fit the column."""
    return F.round(php_floatval(c).try_cast("decimal(38,10)"), 2).try_cast("decimal(12,2)")


def _product_fields(requests: DataFrame) -> DataFrame:
    return requests.select(
        "*",
        php_trim("product_name").alias("_name"), php_trim("category").alias("_cat"),
        _price("price").alias("_price"), php_trim("description").alias("_desc"))


def _product_reason() -> Column:
    return F.when(php_empty("_name") | php_empty("_cat") | F.col("_price").isNull() | (F.col("_price") <= 0),
                  F.lit(INVALID_PRODUCT))


# ---- CHG-1 --------------------------------------------------------------------
def product_intake(products: DataFrame, requests: DataFrame) -> Applied:
    """Add products: trimmed name and category must be non-empty and price > 0.

    Accepted rows get new ProductIDs after the current maximum, in request order.
    """
    ok, rej = _split(_product_fields(requests), _product_reason())
    new = _next_ids(products, "ProductID", ok, "ProductID")
    return Applied(new.select("ProductID", F.col("_name").alias("Name"), F.col("_cat").alias("Category"),
                              F.col("_price").alias("Price"), F.col("_desc").alias("Description"),
                              "request_id"), rej)


# ---- CHG-2 --------------------------------------------------------------------
def product_upsert(products: DataFrame, edits: DataFrame) -> Applied:
    """Update products by id with the same validation; the last valid edit per id wins.

    Returns the whole new products table and the rejected edits (invalid
    fields, or no such product).  The last edit per id is picked with a
    ``max`` over (request_id, fields) structs, a partial aggregation, so many
    edits of one id are not gathered into one task.
    """
    f = _product_fields(edits)
    known = products.select(F.col("ProductID").alias("_pid"), F.lit(True).alias("_known"))
    f = f.join(known, f.ProductID == known._pid, "left")
    reason = F.when(F.col("_known").isNull(), F.lit(PRODUCT_NOT_FOUND)).otherwise(_product_reason())
    ok, rej = _split(f, reason)
    last = ok.groupBy("ProductID").agg(F.max(F.struct("request_id", "_name", "_cat", "_price", "_desc"))
                                       .alias("e"))
    upd = products.join(last, "ProductID", "left")
    pick = lambda new, old: F.when(F.col("e").isNotNull(), F.col(f"e.{new}")).otherwise(F.col(old))
    table = upd.select("ProductID", pick("_name", "Name").alias("Name"), pick("_cat", "Category").alias("Category"),
                       pick("_price", "Price").alias("Price"), pick("_desc", "Description").alias("Description"))
    return Applied(table, rej)


# ---- CHG-3 / CHG-4 -------------------------------------------------------------
class Tables(NamedTuple):
    products: DataFrame | None
    suppliers: DataFrame | None
    supplier_products: DataFrame
    stock: DataFrame
    sales: DataFrame


def _drop_keys(df: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    return df.join(keys.select(col).where(F.col(col).isNotNull()).distinct(), col, "left_anti")


def delete_products(products: DataFrame, stock: DataFrame, sales: DataFrame, links: DataFrame,
                    keys: DataFrame) -> Tables:
    """Cascade delete: the products' stock lots, sales and supplier links, then the products."""
    return Tables(products=_drop_keys(products, keys, "ProductID"), suppliers=None,
                  supplier_products=_drop_keys(links, keys, "ProductID"),
                  stock=_drop_keys(stock, keys, "ProductID"), sales=_drop_keys(sales, keys, "ProductID"))


def delete_suppliers(suppliers: DataFrame, stock: DataFrame, sales: DataFrame, links: DataFrame,
                     keys: DataFrame) -> Tables:
    """Cascade delete: the suppliers' stock lots and links, then the suppliers.

    Sales are kept, so net stock of their products can go negative.
    """
    return Tables(products=None, suppliers=_drop_keys(suppliers, keys, "SupplierID"),
                  supplier_products=_drop_keys(links, keys, "SupplierID"),
                  stock=_drop_keys(stock, keys, "SupplierID"), sales=sales)


# ---- CHG-5 --------------------------------------------------------------------
class SupplierIntake(NamedTuple):
    suppliers: DataFrame   # new supplier rows
    links: DataFrame       # new (SupplierID, ProductID) rows
    rejects: DataFrame


def supplier_intake(suppliers: DataFrame, requests: DataFrame, validate: bool = True) -> SupplierIntake:
    """Add suppliers, optionally linking each to a product (``link_product``).

    ``validate=True`` is the product-page form: fields trimmed, name required.
    ``validate=False`` is the suppliers page, which stores the fields as sent.
    """
    fields = ["name", "contact_info", "email", "phone"]
    r = requests.select("request_id", "link_product",
                        *[(php_trim(c) if validate else F.col(c)).alias(c) for c in fields])
    reason = F.when(php_empty("name"), F.lit(SUPPLIER_NAME_REQUIRED)) if validate else F.lit(None).cast("string")
    ok, rej = _split(r, reason)
    new = _next_ids(suppliers, "SupplierID", ok, "SupplierID")
    rows = new.select("SupplierID", F.col("name").alias("Name"), F.col("contact_info").alias("ContactInfo"),
                      F.col("email").alias("Email"), F.col("phone").alias("Phone"), "request_id", "link_product")
    links = rows.where(F.col("link_product").isNotNull()).select(
        "SupplierID", F.col("link_product").alias("ProductID"))
    return SupplierIntake(rows.drop("link_product"), links, rej)


# ---- CHG-6 --------------------------------------------------------------------
def link_suppliers(links: DataFrame, pairs: DataFrame) -> Applied:
    """Add (SupplierID, ProductID) links; a missing supplier id is rejected.

    Linking an existing pair is idempotent (the table stays a set).
    """
    ok, rej = _split(pairs, F.when(php_empty(F.col("SupplierID").cast("string")), F.lit(SUPPLIER_REQUIRED)))
    new = ok.select("SupplierID", "ProductID").unionByName(links.select("SupplierID", "ProductID")).distinct()
    return Applied(new, rej)


def unlink_suppliers(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """Remove the given (SupplierID, ProductID) links."""
    return links.join(pairs.select("SupplierID", "ProductID").distinct(), ["SupplierID", "ProductID"], "left_anti")


# ---- CHG-7 --------------------------------------------------------------------
class Receipt(NamedTuple):
    stock: DataFrame      # new stock lots
    links: DataFrame      # links created because the supplier was not linked yet
    rejects: DataFrame


def receive_stock(stock: DataFrame, links: DataFrame, products: DataFrame, suppliers: DataFrame,
                  requests: DataFrame, as_of: _dt.date) -> Receipt:
    """Record stock receipts and create the missing supplier-product links.

    Product and supplier ids must be present and non-zero and the quantity a
    whole number > 0; receipts for unknown products or suppliers are rejected
    too (the source schema is unknown, so references are enforced here).  A
    missing date means ``as_of``.
    """
    qty = whole_number("quantity")
    r = requests.select("request_id", F.col("product_id").alias("ProductID"),
                        F.col("supplier_id").alias("SupplierID"), qty.alias("QuantityAdded"),
                        F.coalesce(F.col("date_added"), ts_lit(as_of)).alias("DateAdded"))
    pk = products.select("ProductID", F.lit(True).alias("_p"))
    sk = suppliers.select("SupplierID", F.lit(True).alias("_s"))
    r = r.join(pk, "ProductID", "left").join(sk, "SupplierID", "left")
    bad = (F.col("ProductID").isNull() | (F.col("ProductID") == 0) | F.col("SupplierID").isNull()
           | (F.col("SupplierID") == 0) | F.col("QuantityAdded").isNull() | (F.col("QuantityAdded") <= 0))
    reason = (F.when(bad, F.lit(INVALID_RECEIPT))
              .when(F.col("_p").isNull(), F.lit(UNKNOWN_PRODUCT))
              .when(F.col("_s").isNull(), F.lit(UNKNOWN_SUPPLIER)))
    ok, rej = _split(r, reason)
    ok = ok.drop("_p", "_s")
    new = _next_ids(stock, "StockID", ok, "StockID").select(
        "StockID", "ProductID", "SupplierID", "QuantityAdded", "DateAdded", "request_id")
    new_links = (ok.select("SupplierID", "ProductID").distinct()
                 .join(links.select("SupplierID", "ProductID"), ["SupplierID", "ProductID"], "left_anti"))
    return Receipt(new, new_links, rej)


# ---- CHG-11 -------------------------------------------------------------------
def release_stock(stock: DataFrame, removals: DataFrame, every_lot: bool = True) -> DataFrame:
    """Return removed cart quantities to stock; the whole new stock table.

    ``every_lot=True`` is the application's update: the quantity is added to
    *every* lot of the product (k lots receive k x the quantity in total).
    ``every_lot=False`` adds it once, to the product's lowest StockID.
    """
    back = removals.groupBy(F.col("product_id").alias("ProductID")).agg(F.sum("quantity").alias("_back"))
    if every_lot:
        out = stock.join(back, "ProductID", "left")
        add = F.coalesce(F.col("_back"), F.lit(0))
    else:
        first = stock.groupBy("ProductID").agg(F.min("StockID").alias("_first"))
        out = stock.join(back.join(first, "ProductID"), "ProductID", "left")
        add = F.when(F.col("StockID") == F.col("_first"), F.coalesce(F.col("_back"), F.lit(0))).otherwise(0)
    return out.select("StockID", "ProductID", "SupplierID",
                      (F.col("QuantityAdded") + add).alias("QuantityAdded"), "DateAdded")
