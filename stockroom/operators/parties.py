"""Products, suppliers, users: listings, lookups, links and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import any_contains_ci, display_default, role_bucket


# ---- listings ---------------------------------------------------------------
def product_list(products: DataFrame, descending: bool = False) -> DataFrame:
    """All products by id (ascending; descending after a write)."""
    return products.orderBy(F.desc("ProductID") if descending else F.asc("ProductID"))


def options(df: DataFrame, id_col: str) -> DataFrame:
    """(id, Name) pairs sorted by name, then id (drop-down lists)."""
    return df.select(id_col, "Name").orderBy("Name", id_col)


def category_list(products: DataFrame) -> DataFrame:
    """Distinct categories, sorted."""
    return products.select("Category").distinct().orderBy("Category")


def product_lookup(products: DataFrame, keys: DataFrame, key: str = "ProductID") -> DataFrame:
    """Rows of the requested products that exist (a batch of keyed lookups)."""
    wanted = keys.select(F.col(key).alias("ProductID")).where(F.col("ProductID").isNotNull()).distinct()
    return products.join(wanted, "ProductID", "left_semi")


def product_lookup_missing(products: DataFrame, keys: DataFrame, key: str = "ProductID") -> DataFrame:
    """Requested product ids that do not exist ("not found")."""
    wanted = keys.select(F.col(key).alias("ProductID")).where(F.col("ProductID").isNotNull()).distinct()
    return wanted.join(products.select("ProductID"), "ProductID", "left_anti")


def product_detail(products: DataFrame) -> DataFrame:
    """Products with the display text for an empty description."""
    return products.withColumn("DescriptionText", display_default("Description", P.NO_DESCRIPTION))


# ---- users ------------------------------------------------------------------
def user_roles(users: DataFrame, roles: DataFrame) -> DataFrame:
    """Users with their raw role name and the cleaned role bucket (admin / customer / staff).

    Users without a role row keep a NULL RoleName and fall into "staff".
    No password column is read.
    """
    return (users.select("UserID", "Username", "RoleID")
            .join(roles.select("RoleID", "RoleName"), "RoleID", "left")
            .select("UserID", "Username", "RoleID", "RoleName", role_bucket("RoleName").alias("Role")))


# ---- supplier links ---------------------------------------------------------
def _supplier_display(df: DataFrame) -> DataFrame:
    return (df.withColumn("ContactText", display_default("ContactInfo", P.DASH))
              .withColumn("EmailText", display_default("Email", P.DASH))
              .withColumn("PhoneText", display_default("Phone", P.DASH)))


def product_suppliers(products: DataFrame, suppliers: DataFrame, links: DataFrame) -> DataFrame:
    """For every product, its linked suppliers (bridge join), with display text.

    One row per existing link; products without links have no rows.
    """
    linked = (links.select("ProductID", "SupplierID")
              .join(products.select("ProductID"), "ProductID", "left_semi")
              .join(suppliers, "SupplierID"))
    return _supplier_display(linked).select(
        "ProductID", "SupplierID", "Name", "ContactInfo", "Email", "Phone",
        "ContactText", "EmailText", "PhoneText").orderBy("ProductID", "Name", "SupplierID")


def available_suppliers(suppliers: DataFrame, links: DataFrame, product_id: int) -> DataFrame:
    """Suppliers not linked to ``product_id`` (``SupplierID NOT IN (...)``), SQL semantics kept.

    ``x NOT IN S`` keeps every row when S is empty; otherwise it drops rows
    whose x is NULL, and drops *all* rows when S contains a NULL.  Here the two
    facts about S (empty? has a NULL?) are scalar subqueries evaluated once,
    and the membership test is a plain ``left_anti`` join, which AQE runs as a
    broadcast or a shuffle join depending on the measured size of S (a
    null-aware anti join would have to broadcast S whatever its size).
    """
    mine = links.where(F.col("ProductID") == F.lit(product_id)).select("SupplierID")
    facts = mine.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("SupplierID").isNull()).alias("nulls"))
    empty = facts.select(F.col("n") == 0).scalar()
    has_null = facts.select(F.col("nulls") > 0).scalar()
    out = (suppliers.join(mine.where(F.col("SupplierID").isNotNull()).distinct(), "SupplierID", "left_anti")
           .where(empty | (F.col("SupplierID").isNotNull() & ~has_null)))
    return out.withColumn("OptionText", F.concat(
        F.col("Name"), F.lit(" ("), display_default("Email", P.NO_EMAIL), F.lit(")"))).orderBy("Name", "SupplierID")


# ---- searches ---------------------------------------------------------------
def product_search(products: DataFrame, term: str | None = None, category: str | None = None) -> DataFrame:
    """Case-insensitive substring search over name or category, and exact category filter.

    Both filters compose (the browser version lets one overwrite the other).
    An empty term or category means no filter.  The term is a literal
    substring (``%`` and ``_`` match themselves).
    """
    out = products
    if term:
        out = out.where(any_contains_ci(["Name", "Category"], term))
    if category:
        out = out.where(F.lower("Category") == F.lit(category.lower()))
    return out


def search_rows(df: DataFrame, term: str, cols: list[str] | None = None) -> DataFrame:
    """Rows where any displayed cell contains ``term`` (case-insensitive)."""
    if not term:
        return df
    return df.where(any_contains_ci(cols or df.columns, term))


def visible_count(df: DataFrame) -> DataFrame:
    """Number of rows left visible by a search."""
    return df.agg(F.count(F.lit(1)).alias("Showing"))
