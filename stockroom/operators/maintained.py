"""Per-product levels that change batches are folded into.

A level row keeps what a product's receipt lots and sales add up to: their numbers and their quantities.  Sums and
counts take additions and removals alike, so a batch's new, deleted and edited rows (an edit is a removal
and an addition) change the stored levels by their own sums; neither table is read again.  Numbers tell a product
whose last row went (no figure) from one whose quantities add up to 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIGURES = ["Lots", "TotalAdded", "Sales", "TotalSold"]


def _side(rows: DataFrame, quantity: str, sign: int, figures: tuple[str, str]) -> DataFrame:
    """One side's changes by product; rows without a quantity count as rows only."""
    n, total = figures
    return rows.groupBy("ProductID").agg(
        (F.count("*") * sign).alias(n), (F.coalesce(F.sum(quantity), F.lit(0)) * sign).cast("long").alias(total)).select(
        "ProductID", *[F.col(c) if c in figures else F.lit(0).cast("long").alias(c) for c in FIGURES])


def level_changes(stock_added: DataFrame | None = None, stock_removed: DataFrame | None = None,
                  sales_added: DataFrame | None = None, sales_removed: DataFrame | None = None) -> DataFrame:
    """(ProductID, Lots, TotalAdded, Sales, TotalSold): what a change batch does to the levels; at least one side is needed."""
    lots, sold = ("Lots", "TotalAdded"), ("Sales", "TotalSold")
    sides = [(stock_added, "QuantityAdded", 1, lots), (stock_removed, "QuantityAdded", -1, lots),
             (sales_added, "QuantitySold", 1, sold), (sales_removed, "QuantitySold", -1, sold)]
    return reduce(DataFrame.unionAll, [_side(*side) for side in sides if side[0] is not None])


def fold_levels(levels: DataFrame, changes: DataFrame) -> DataFrame:
    """The stored ``levels`` after ``changes``; products that have no rows any more leave."""
    both = levels.select("ProductID", *FIGURES).unionAll(changes.select("ProductID", *FIGURES))
    return both.groupBy("ProductID").agg(*[F.sum(c).cast("long").alias(c) for c in FIGURES]).where("Lots <> 0 or Sales <> 0")


def stock_from_levels(products: DataFrame, levels: DataFrame) -> DataFrame:
    """(ProductID, ProductName, TotalAdded, TotalSold, CurrentStock) of every product from its stored levels."""
    added, sold = (F.when(F.col(n) > 0, F.col(c)).otherwise(0) for n, c in (("Lots", "TotalAdded"), ("Sales", "TotalSold")))
    return products.select("ProductID", F.col("Name").alias("ProductName")).join(levels, "ProductID", "left").select(
        "ProductID", "ProductName", F.coalesce(added, F.lit(0)).cast("long").alias("TotalAdded"),
        F.coalesce(sold, F.lit(0)).cast("long").alias("TotalSold")).withColumn(
        "CurrentStock", F.col("TotalAdded") - F.col("TotalSold"))
