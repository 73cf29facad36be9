"""Stock levels.

Two meanings of stock are kept apart on purpose:

* **gross** stock = sum of receipt lots (``QuantityAdded``) only;
* **net** stock = received minus sold.

The shop decrements receipt lots *and* records a sale for the same purchase,
so net stock is charged twice for a shop purchase; both figures are reported
as the application computes them.

Every per-product figure is computed by aggregating the big tables on
``ProductID`` first (partial, map-side aggregation), and only the
one-row-per-product results are joined to ``products``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import sale_form_status, stock_status
from .topk import top_k_named


def levels(stock: DataFrame, sales: DataFrame | None, keys: DataFrame | None = None) -> DataFrame:
    """Per product: units received and (if ``sales`` given) units sold.

    ``keys`` limits both big tables to its products before they are aggregated.

    Each side is aggregated on ProductID (partial aggregation map-side), and
    the two per-product results are joined on ProductID.  Both arrive hash
    partitioned on that key, so the join adds no shuffle; on tables bucketed
    by ProductID neither the aggregations nor the join shuffle at all.
    """
    if keys is not None:
        stock = stock.join(keys.select("ProductID"), "ProductID", "left_semi")
        sales = None if sales is None else sales.join(keys.select("ProductID"), "ProductID", "left_semi")
    added = stock.groupBy("ProductID").agg(F.sum(F.col("QuantityAdded").cast("long")).alias("TotalAdded"))
    if sales is None:
        return added
    sold = sales.groupBy("ProductID").agg(F.sum(F.col("QuantitySold").cast("long")).alias("TotalSold"))
    return added.join(sold, "ProductID", "full")


def _with_levels(keys: DataFrame, stock: DataFrame, sales: DataFrame | None, only: bool = False) -> DataFrame:
    out = keys.join(levels(stock, sales, keys if only else None), "ProductID", "left") \
        .withColumn("TotalAdded", F.coalesce("TotalAdded", F.lit(0).cast("bigint")))
    if sales is not None:
        out = out.withColumn("TotalSold", F.coalesce("TotalSold", F.lit(0).cast("bigint")))
    return out


def current_stock(products: DataFrame, stock: DataFrame, sales: DataFrame) -> DataFrame:
    """Per product: received, sold, net stock and its status label (all products, by name)."""
    keys = products.select("ProductID", F.col("Name").alias("ProductName"), "Category")
    return (_with_levels(keys, stock, sales)
            .withColumn("CurrentStock", F.col("TotalAdded") - F.col("TotalSold"))
            .withColumn("Status", stock_status("CurrentStock"))
            .select("ProductID", "ProductName", "Category", "TotalAdded", "TotalSold",
                    "CurrentStock", "Status")
            .orderBy("ProductName", "ProductID"))


def sellable_products(products: DataFrame, stock: DataFrame, sales: DataFrame) -> DataFrame:
    """Products with net stock > 0 (the sale form list), with the form's status label."""
    out = (_with_levels(products, stock, sales)
           .withColumn("StockAvailable", F.col("TotalAdded") - F.col("TotalSold"))
           .where(F.col("StockAvailable") > 0)
           .withColumn("StockStatus", sale_form_status("StockAvailable")))
    return out.select(*products.columns, "StockAvailable", "StockStatus").orderBy("Category", "Name", "ProductID")


def shop_catalog(products: DataFrame, stock: DataFrame) -> DataFrame:
    """Products with gross stock > 0 (the shop list)."""
    return (_with_levels(products, stock, None)
            .withColumnRenamed("TotalAdded", "Stock")
            .where(F.col("Stock") > 0)
            .select("ProductID", "Name", "Category", "Price", "Description", "Stock")
            .orderBy("Name", "ProductID"))


def low_stock_products(products: DataFrame, stock: DataFrame, k: int | None = P.TOP_PRODUCTS,
                       threshold: int = P.LOW_STOCK_THRESHOLD) -> DataFrame:
    """Up to ``k`` products (None: all) whose gross stock is under ``threshold``.

    The application takes any five; here the order (TotalStock, ProductID)
    makes the pick deterministic.
    """
    keys = products.select("ProductID", "Name")
    low = (_with_levels(keys, stock, None)
           .withColumnRenamed("TotalAdded", "TotalStock")
           .where(F.col("TotalStock") < threshold)
           .orderBy("TotalStock", "ProductID"))
    return low if k is None else low.limit(k)


def low_lot_count(stock: DataFrame, threshold: int = P.LOW_LOT_THRESHOLD) -> DataFrame:
    """Number of receipt lots (rows, not products) with fewer than ``threshold`` units."""
    return stock.where(F.col("QuantityAdded") < threshold).agg(F.count(F.lit(1)).alias("LowLotCount"))


def stock_availability(keys: DataFrame, stock: DataFrame, sales: DataFrame) -> DataFrame:
    """For each requested ProductID: units added, sold and available (zeros when none)."""
    keys = keys.select("ProductID").where(F.col("ProductID").isNotNull()).distinct()
    return (_with_levels(keys, stock, sales, only=True)
            .withColumn("Available", F.col("TotalAdded") - F.col("TotalSold"))
            .select("ProductID", "TotalAdded", "TotalSold", "Available"))


def gross_stock(keys: DataFrame, stock: DataFrame) -> DataFrame:
    """For each requested ProductID: sum of its receipt lots, 0 when none."""
    keys = keys.select("ProductID").where(F.col("ProductID").isNotNull()).distinct()
    return _with_levels(keys, stock, None, only=True).withColumnRenamed("TotalAdded", "GrossStock")


def stock_by_supplier(stock: DataFrame, products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Units supplied per (supplier, product), ordered by supplier then product name."""
    per_pair = stock.groupBy("SupplierID", "ProductID").agg(F.sum("QuantityAdded").alias("TotalSupplied"))
    return (per_pair
            .join(products.select("ProductID", F.col("Name").alias("ProductName")), "ProductID")
            .join(suppliers.select("SupplierID", F.col("Name").alias("SupplierName")), "SupplierID")
            .select("SupplierID", "ProductID", "SupplierName", "ProductName", "TotalSupplied")
            .orderBy("SupplierName", "ProductName", "SupplierID", "ProductID"))


def recent_receipts(stock: DataFrame, products: DataFrame, suppliers: DataFrame,
                    k: int = P.RECENT_RECEIPTS) -> DataFrame:
    """The ``k`` newest receipt lots with product and supplier names.

    Ties on the date are broken by StockID (newest id first).
    """
    return (_newest_lots(stock, products, suppliers, k)
            .select("StockID", "ProductName", "SupplierName", "QuantityAdded", "DateAdded"))


def _newest_lots(stock: DataFrame, products: DataFrame, suppliers: DataFrame, k: int) -> DataFrame:
    """The ``k`` newest lots of known products and suppliers, with both names, newest first."""
    order = [F.desc("DateAdded"), F.desc("StockID")]
    base = stock.select("StockID", "ProductID", "SupplierID", "QuantityAdded", "DateAdded")
    return top_k_named(base, order, k, {
        "ProductID": products.select("ProductID", F.col("Name").alias("ProductName")),
        "SupplierID": suppliers.select("SupplierID", F.col("Name").alias("SupplierName"))}).orderBy(*order)


def receipt_history(stock: DataFrame, products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Every receipt lot of a known product and supplier with both names: the whole table behind the export."""
    return (stock.join(products.select("ProductID", F.col("Name").alias("ProductName")), "ProductID")
            .join(suppliers.select("SupplierID", F.col("Name").alias("SupplierName")), "SupplierID")
            .select("StockID", "ProductName", "SupplierName", "QuantityAdded", "DateAdded"))


def largest_lot(stock: DataFrame, quantity: int) -> DataFrame:
    """Per product, the single largest lot that can cover ``quantity`` units.

    Ties on size go to the lowest StockID.  A ``max`` over (size, -id) structs keeps this a
    partial (map-side) aggregation, so a product with very many lots is not
    gathered into one task.
    """
    key = F.struct(F.col("QuantityAdded"), (-F.col("StockID")).alias("neg_id"))
    return (stock.where(F.col("QuantityAdded") >= quantity)
            .groupBy("ProductID")
            .agg(F.max(key).alias("best"))
            .select("ProductID", (-F.col("best.neg_id")).alias("StockID"),
                    F.col("best.QuantityAdded").alias("QuantityAdded")))


def report_recent_stock(stock: DataFrame, products: DataFrame, suppliers: DataFrame,
                        k: int = P.RECENT_RECEIPTS) -> DataFrame:
    """The report page's "recent stock additions": the lot's columns, both names, display texts."""
    return (_newest_lots(stock, products, suppliers, k)
            .select("StockID", "ProductID", "SupplierID", "QuantityAdded", "DateAdded", "ProductName",
                    "SupplierName", F.date_format("DateAdded", P.LABEL_DATE).alias("DateText"),
                    F.format_number("QuantityAdded", 0).alias("QuantityText")))
