"""Table access.

``RetailTables`` hands out the seven application tables (plus the request
tables that stand in for form posts) as lazy DataFrames.  Two loaders exist:

* ``from_testdata``: the adapter from the supplied TPC-H-style parquet tables
  (column mapping only; it does none of the jobs' work).
* ``from_parquet``: a directory holding the application tables themselves
  (``products/``, ``sales/`` ...), e.g. written by ``write_tables``.

Both read parquet, so filters and column selections reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, RunParams

TABLES = ("products", "suppliers", "supplier_products", "stock", "sales", "users", "roles")
REQUEST_TABLES = ("cart_events", "sale_requests", "product_requests", "receipt_requests",
                  "product_edits", "supplier_requests")

LINE_REPEAT_BITS = 16
CART_PRODUCTS = 199  # a user's cart holds product user_id % 199; product 0 doesn't exist

# Every lineitem column except the status, in a fixed order: a total order for
# numbering rows that share (l_orderkey, l_linenumber).
_LINE_ORDER = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
               "l_discount", "l_tax", "l_returnflag", "l_shipdate")


def _line_id(li: DataFrame) -> DataFrame:
    """Attach a unique ``line_id`` to lineitem rows.

    ``(l_orderkey, l_linenumber)`` repeats in the test data, so a per-pair
    sequence number of ``LINE_REPEAT_BITS`` bits is appended; a pair with more
    repeats is an error, never a collision.  The window is partitioned by the
    pair (a handful of rows each), never a global numbering.
    """
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*_LINE_ORDER)
    n = F.row_number().over(w).cast("long") - 1
    fits = (n < (1 << LINE_REPEAT_BITS)) & F.col("l_linenumber").between(0, 7)
    return li.withColumn("line_id", F.when(
        fits, (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * (1 << LINE_REPEAT_BITS) + n)
        .otherwise(F.raise_error(F.lit("a line repeats too often for its id")).cast("long")))


def cart_events_of(e: DataFrame) -> DataFrame:
    """Cart events from the ``events`` table (works on a stream too)."""
    action = (F.when(F.col("event_type") == "purchase", F.lit("buy"))
              .when(F.col("event_type") == "error", F.lit("remove"))
              .otherwise(F.lit("add")))
    return e.select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id",
        (F.col("user_id") % CART_PRODUCTS).alias("product_id"),
        action.alias("action"),
        (F.col("event_id") % 3 + 1).alias("quantity"))


class RetailTables:
    """Lazy application tables over one storage location."""

    def __init__(self, spark: SparkSession, frames: dict[str, callable], params: RunParams = DEFAULT,
                 paths: dict[str, str] | None = None):
        self.spark = spark
        self.paths = paths or {}
        self._frames = frames
        self.params = params
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        frames = self.__dict__.get("_frames", {})
        if name in frames:
            cache = self.__dict__["_cache"]
            if name not in cache:
                cache[name] = frames[name]()
            return cache[name]
        raise AttributeError(name)

    # ------------------------------------------------------------------ loaders
    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, params: RunParams = DEFAULT) -> "RetailTables":
        frames = {t: (lambda t=t: spark.read.parquet(f"{path}/{t}")) for t in TABLES}
        for extra in REQUEST_TABLES:
            frames[extra] = lambda t=extra: spark.read.parquet(f"{path}/{t}")
        return cls(spark, frames, params)

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str, params: RunParams = DEFAULT) -> "RetailTables":
        """Tables registered in the session catalog (e.g. written by ``write_bucketed``)."""
        frames = {t: (lambda t=t: spark.table(f"{database}.{t}")) for t in TABLES + REQUEST_TABLES}
        return cls(spark, frames, params)

    @classmethod
    def from_jdbc(cls, spark: SparkSession, url: str, properties: dict[str, str],
                  partitions: dict[str, tuple[str, int, int, int]] | None = None,
                  names: dict[str, str] | None = None, params: RunParams = DEFAULT) -> "RetailTables":
        """Tables read from a relational database over JDBC.

        ``partitions`` maps a table to (column, lower, upper, n): the read is
        split into n parallel range queries on that numeric column (use it for
        the big tables: stock, sales).  ``names`` maps our table names to the
        database's (e.g. ``{"supplier_products": "SupplierProducts"}``).
        Filters and selected columns are pushed into the generated SQL by
        Spark's JDBC source.
        """
        partitions = partitions or {}
        names = names or {}

        def reader(t: str):
            def read() -> DataFrame:
                table = names.get(t, t)
                if t in partitions:
                    col, lo, hi, n = partitions[t]
                    return spark.read.jdbc(url, table, column=col, lowerBound=lo, upperBound=hi,
                                           numPartitions=n, properties=properties)
                return spark.read.jdbc(url, table, properties=properties)
            return read

        return cls(spark, {t: reader(t) for t in TABLES}, params)

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str, params: RunParams = DEFAULT) -> "RetailTables":
        read: dict[str, DataFrame] = {}

        def raw(name: str) -> DataFrame:
            if name not in read:
                read[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            return read[name]

        def products():
            return raw("part").select(
                F.col("p_partkey").alias("ProductID"),
                F.col("p_name").alias("Name"),
                F.col("p_type").alias("Category"),
                F.col("p_retailprice").cast("decimal(12,2)").alias("Price"),
                F.col("p_brand").alias("Description"))

        def suppliers():
            k = F.col("s_suppkey")
            return raw("supplier").select(
                k.alias("SupplierID"),
                F.col("s_name").alias("Name"),
                F.col("s_name").alias("ContactInfo"),
                F.when(k % 3 == 0, F.lit(None).cast("string"))
                 .otherwise(F.concat(F.lit("supplier"), k.cast("string"), F.lit("@example.com")))
                 .alias("Email"),
                F.when(k % 4 == 0, F.lit(""))
                 .otherwise(F.concat(F.lit("555-"), k.cast("string"))).alias("Phone"))

        def open_lines():
            return raw("lineitem").where(F.col("l_linestatus") == "O")

        def stock():
            return _line_id(open_lines()).select(
                F.col("line_id").alias("StockID"),
                F.col("l_partkey").alias("ProductID"),
                F.col("l_suppkey").alias("SupplierID"),
                # lots of every 40th product are all but empty, so that some products are low on stock
                F.when(F.col("l_partkey") % 40 == 0, F.col("l_quantity").cast("bigint") % 2)
                .otherwise(F.col("l_quantity").cast("bigint")).alias("QuantityAdded"),
                F.col("l_shipdate").alias("DateAdded"))

        def supplier_products():
            return open_lines().select(
                F.col("l_suppkey").alias("SupplierID"),
                F.col("l_partkey").alias("ProductID")).distinct()

        def sales():
            li = _line_id(raw("lineitem").where(F.col("l_linestatus") == "F"))
            orders = raw("orders").select("o_orderkey", "o_custkey")
            amount = (F.col("l_extendedprice").cast("decimal(14,2)")
                      * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(14,2)")
            return li.join(orders, li.l_orderkey == orders.o_orderkey).select(
                F.col("line_id").alias("SaleID"),
                F.col("l_partkey").alias("ProductID"),
                F.col("l_quantity").cast("bigint").alias("QuantitySold"),
                F.col("l_shipdate").alias("SaleDate"),
                amount.alias("TotalAmount"),
                F.col("o_custkey").alias("UserID"))

        def users():
            return raw("customer").select(
                F.col("c_custkey").alias("UserID"),
                F.col("c_name").alias("Username"),
                F.col("c_nationkey").cast("bigint").alias("RoleID"))

        def roles():
            k = F.col("n_nationkey")
            name = (F.when(k % 4 == 0, F.lit(" Admin "))
                    .when(k % 4 == 1, F.lit("Custo mer"))
                    .when(k % 4 == 2, F.lit("STAFF"))
                    .otherwise(F.col("n_name")))
            return raw("nation").where(k < 24).select(k.cast("bigint").alias("RoleID"), name.alias("RoleName"))

        def cart_events():
            return cart_events_of(raw("events"))

        def sale_requests():
            e = raw("events")
            k = F.get_json_object("props", "$.k").cast("bigint")
            eid = F.col("event_id")
            qty = (F.when(eid % 50 == 0, F.lit("abc"))
                   .when(eid % 51 == 0, F.lit("0"))
                   .when(eid % 53 == 0, F.lit("9000000000000000000"))
                   .when(eid % 54 == 0, F.lit("1e30"))
                   .when(eid % 55 == 0, F.lit("5.0"))
                   .when(eid % 57 == 0, F.lit(" 1e1"))
                   .when(eid % 59 == 0, F.lit("5.5"))
                   .otherwise((eid % 60 + 1).cast("string")))
            disc = (F.when(eid % 61 == 0, F.lit("1e20"))
                    .when(eid % 62 == 0, F.lit("0.00001"))
                    .when(eid % 63 == 0, F.lit("99999999"))
                    .when(eid % 4 == 0, F.lit("10"))
                    .when(eid % 4 == 1, F.lit(""))
                    .when(eid % 4 == 2, F.lit(None).cast("string"))
                    .otherwise(F.lit("x")))
            return e.select(
                eid.alias("request_id"), "ts",
                F.when(k == 99, F.lit(-1).cast("bigint")).otherwise(k).alias("ProductID"),
                qty.alias("Quantity"), disc.alias("Discount"),
                F.col("user_id").alias("UserID"))

        def product_requests():
            p = raw("part")
            k = F.col("p_partkey")
            name = F.when(k % 7 == 0, F.lit(" ")).otherwise(F.concat(F.col("p_name"), F.lit(" ")))
            cat = F.when(k % 11 == 0, F.lit("0")).otherwise(F.lower("p_type"))
            price = (F.when(k % 13 == 0, F.lit("-5"))
                     .when(k % 17 == 0, F.lit("abc"))
                     .when(k % 19 == 0, F.lit("99999999999"))
                     .when(k % 23 == 0, F.lit("1e30"))
                     .otherwise(F.concat(F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit("x"))))
            return p.select(k.alias("request_id"), name.alias("product_name"), cat.alias("category"),
                            price.alias("price"), F.col("p_brand").alias("description"))

        def receipt_requests():
            e = raw("events")
            eid = F.col("event_id")
            qty = (F.when(eid % 25 == 0, F.lit("0"))
                   .when(eid % 40 == 0, F.lit("many"))
                   .when(eid % 41 == 0, F.lit("5.0"))
                   .when(eid % 42 == 0, F.lit("5.5"))
                   .when(eid % 43 == 0, F.lit("1e30"))
                   .otherwise((eid % 30 + 1).cast("string")))
            return e.select(
                eid.alias("request_id"),
                F.get_json_object("props", "$.k").cast("bigint").alias("product_id"),
                F.col("user_id").alias("supplier_id"),
                qty.alias("quantity"),
                F.col("ts").alias("date_added"))

        def product_edits():
            # Two edits per target id (the later one wins); ids past the
            # table's end are edits of products that do not exist.
            return product_requests().select(
                (F.expr("request_id div 2") * 3).alias("ProductID"), "*")

        def supplier_requests():
            c = raw("customer")
            k = F.col("c_custkey")
            name = F.when(k % 9 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("c_name")))
            link = F.when(k % 2 == 0, k % 200).otherwise(F.lit(None).cast("bigint"))
            return c.select(k.alias("request_id"), name.alias("name"),
                            F.col("c_mktsegment").alias("contact_info"),
                            F.concat(F.lower(F.col("c_mktsegment")), F.lit("@mail.test")).alias("email"),
                            F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("+1-"), k.cast("string")))
                             .alias("phone"),
                            link.alias("link_product"))

        frames = dict(products=products, suppliers=suppliers, stock=stock,
                      supplier_products=supplier_products, sales=sales, users=users,
                      roles=roles, cart_events=cart_events, sale_requests=sale_requests,
                      product_requests=product_requests, receipt_requests=receipt_requests,
                      product_edits=product_edits, supplier_requests=supplier_requests)
        return cls(spark, frames, params, paths={"events": f"{sf_dir}/events.parquet"})


def write_tables(tables: RetailTables, path: str, sales_by_month: bool = True) -> None:
    """Write the application tables as parquet under ``path``.

    Sales are partitioned by sale month so date-range reports prune whole
    directories; every other table is written as is.
    """
    for name in TABLES + REQUEST_TABLES:
        df = getattr(tables, name)
        writer = df.write.mode("overwrite")
        if name == "sales" and sales_by_month:
            df = df.withColumn("SaleMonth", F.date_format("SaleDate", "yyyy-MM"))
            writer = df.write.mode("overwrite").partitionBy("SaleMonth")
        writer.parquet(f"{path}/{name}")


def write_bucketed(tables: RetailTables, database: str, buckets: int, location: str | None = None) -> None:
    """Save the tables in the catalog, the product-keyed ones bucketed and sorted by ProductID.

    Products, stock, sales and supplier links share the bucket count, so
    per-product aggregations and product joins between them need no shuffle.
    Needs a persistent catalog (metastore) to be reused across sessions.
    """
    spark = tables.spark
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{loc}")
    keyed = {"products", "stock", "sales", "supplier_products"}
    for name in TABLES + REQUEST_TABLES:
        w = getattr(tables, name).write.mode("overwrite").format("parquet")
        if name in keyed:
            w = w.bucketBy(buckets, "ProductID").sortBy("ProductID")
        w.saveAsTable(f"{database}.{name}")
