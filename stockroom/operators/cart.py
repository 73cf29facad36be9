"""The shopping cart as an ordered fold over cart events.

The application keeps, per login session, a map product -> quantity:

* ``add``: adds the quantity, 1 when none is given (creates the entry if
  absent).  The cart changes before any stock check, so an add always counts.
* ``remove``: drops the entry (and returns its quantity to stock); with no
  entry it is an error.
* ``buy``: with an entry and an existing product, records a sale of the
  entry's quantity and drops the entry.  With no entry: error "not in cart".
  With an entry but no such product: error, and the entry stays.

Batch form: per (user, product) the events are cut into *episodes* at each
reset (``remove``, or ``buy`` of an existing product).  The episode number is
a running count of earlier resets (``scan.running_sums``, which splits hot
keys), after which every output is a plain ``groupBy`` over episodes.  An
entry exists during an episode once it has had at least one add.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from .scan import running_sums

KEYS = ["user_id", "product_id"]
ORDER = ["ts", "event_id"]

NOT_IN_CART = "not in cart"
NO_SUCH_PRODUCT = "product does not exist"


class CartState(NamedTuple):
    events: DataFrame      # events with episode numbers and flags
    episodes: DataFrame    # one row per (user, product, episode)


def cart_episodes(events: DataFrame, products: DataFrame) -> CartState:
    # Only a buy depends on the product existing, so only buys meet the products table.
    known = products.select(F.col("ProductID").alias("product_id")).distinct().withColumn("_known", F.lit(True))
    ev = events.select("event_id", "ts", "user_id", "product_id", "action",
                       F.coalesce("quantity", F.lit(P.DEFAULT_ADD_QUANTITY).cast("long")).alias("quantity"))
    is_buy = F.coalesce(F.col("action") == "buy", F.lit(False))
    buys = (ev.where(is_buy).join(known, "product_id", "left")
            .withColumn("product_exists", F.coalesce("_known", F.lit(False))).drop("_known"))
    e = (ev.where(~is_buy).withColumn("product_exists", F.lit(True)).unionByName(buys)
         .withColumn("is_add", F.col("action") == "add")
         .withColumn("is_reset", (F.col("action") == "remove")
                     | ((F.col("action") == "buy") & F.col("product_exists"))))
    e = running_sums(e, KEYS, ORDER, {"episode": F.col("is_reset").cast("long"),
                                      "adds_before": F.col("is_add").cast("long")}, inclusive=False)
    closer = F.struct(F.col("ts"), F.col("event_id"), F.col("action"))
    episodes = e.groupBy(*KEYS, "episode").agg(
        F.count_if("is_add").alias("adds"),
        F.sum(F.when(F.col("is_add"), F.col("quantity"))).alias("quantity"),
        F.min("adds_before").alias("adds_before"),
        F.max(F.when(F.col("is_reset"), closer)).alias("closer"))
    return CartState(e, episodes)


def _closed(state: CartState, action: str) -> DataFrame:
    ep = state.episodes
    return ep.where((F.col("closer.action") == action) & (F.col("adds") > 0)).select(
        *KEYS, "episode", F.col("quantity").cast("bigint").alias("quantity"),
        F.col("closer.ts").alias("ts"), F.col("closer.event_id").alias("event_id"))


def cart_purchases(state: CartState) -> DataFrame:
    """Successful buys: (user, product, episode, quantity bought, ts, event_id)."""
    return _closed(state, "buy")


def cart_removals(state: CartState) -> DataFrame:
    """Successful removes: the quantity dropped from the cart (returned to stock)."""
    return _closed(state, "remove")


def cart_open(state: CartState) -> DataFrame:
    """Entries still in the cart after the last event: (user, product, quantity)."""
    return (state.episodes.where(F.col("closer").isNull() & (F.col("adds") > 0))
            .select(*KEYS, F.col("quantity").cast("bigint").alias("quantity")))


def cart_errors(state: CartState) -> DataFrame:
    """Removes and buys that failed, with the reason.

    An entry is in the cart at an event if its episode had an add before it:
    the running count of adds there is above the count at the episode's start.
    A reset closes its episode, so its figures are the episode's own.
    """
    closed = state.episodes.where(F.col("closer").isNotNull() & (F.col("adds") == 0)).select(
        F.col("closer.event_id").alias("event_id"), F.col("closer.ts").alias("ts"), *KEYS,
        F.col("closer.action").alias("action"), F.lit(NOT_IN_CART).alias("reason"))
    # What is left are buys of products that don't exist: the only failed events that reset nothing.
    failed = state.events.where((F.col("action") == "buy") & ~F.col("is_reset"))
    start = state.episodes.select(*KEYS, "episode", F.col("adds_before").alias("_start"))
    entry = F.col("adds_before") > F.col("_start")
    kept = failed.join(start, [*KEYS, "episode"]).select(
        "event_id", "ts", *KEYS, "action",
        F.when(entry, F.lit(NO_SUCH_PRODUCT)).otherwise(F.lit(NOT_IN_CART)).alias("reason"))
    return closed.unionByName(kept)


def order_lines(open_entries: DataFrame, products: DataFrame) -> DataFrame:
    """Cart lines with product name, price and line total (price x quantity)."""
    p = products.select(F.col("ProductID").alias("product_id"), F.col("Name").alias("ProductName"),
                        "Price", "Category")
    return (open_entries.join(p, "product_id")
            .select("user_id", "product_id", "ProductName", "Category", "quantity", "Price",
                    (F.col("Price") * F.col("quantity")).cast("decimal(18,2)").alias("Total")))


def checkout_sales(purchases: DataFrame, products: DataFrame) -> DataFrame:
    """Sales rows for cart purchases: price x quantity, no discount, no stock check.

    Purchases only exist for existing products (a buy of a missing product is
    an error in ``cart_errors``), so every purchase becomes a sale.
    """
    p = products.select(F.col("ProductID").alias("product_id"), "Price")
    return (purchases.join(p, "product_id")
            .select(F.col("event_id").alias("SaleRef"), F.col("product_id").alias("ProductID"),
                    F.col("quantity").alias("QuantitySold"), F.col("ts").alias("SaleDate"),
                    (F.col("Price") * F.col("quantity")).cast("decimal(14,2)").alias("TotalAmount"),
                    F.col("user_id").alias("UserID")))
