"""The streaming cart against the batch fold, over files in and out of event-time order."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from data_paths import SMALL
from stockroom.operators import cart as C
from stockroom.schema import SCHEMAS, from_rows
from stockroom.sources import RetailTables
from stockroom.sources.retail import cart_events_of
from stockroom.streaming.cart_stream import run_cart_stream


def files(src, frames):
    """Each frame as one file of the source folder, in arrival order."""
    os.makedirs(src, exist_ok=True)
    have = len(os.listdir(src))
    for i, df in enumerate(frames, have):
        part = tempfile.mkdtemp(prefix="stockroom-slice-")
        df.coalesce(1).write.mode("overwrite").parquet(part)
        name = [f for f in os.listdir(part) if f.endswith(".parquet")][0]
        os.link(os.path.join(part, name), os.path.join(src, f"{i:03d}.parquet"))


def outcome(df, kind, *columns):
    return sorted(tuple(r) for r in df.where(F.col("outcome") == kind).select(*columns).collect())


def test_out_of_order_files_equal_the_batch_fold(spark):
    t = RetailTables.from_testdata(spark, SMALL)
    root = tempfile.mkdtemp(prefix="stockroom-stream-")
    raw = spark.read.parquet(f"{SMALL}/events.parquet")
    # five files that each hold events of the whole time span
    files(root + "/events", [raw.where(F.col("event_id") % 5 == i) for i in (3, 0, 4, 1, 2)])
    span = raw.agg(F.max("ts") - F.min("ts")).first()[0]
    out = run_cart_stream(spark, root + "/events", t.products, root + "/run", files_per_trigger=1,
                          delay=span + dt.timedelta(days=1), event_transform=cart_events_of, finish=True).results()
    carts = C.cart_episodes(t.cart_events, t.products)
    keys = ["user_id", "product_id", "quantity", "ts", "event_id"]
    want = sorted(tuple(r) for r in C.cart_purchases(carts).select(keys).collect())
    assert outcome(out, "purchase", *keys) == want and want
    assert outcome(out, "removal", *keys) == sorted(tuple(r) for r in C.cart_removals(carts).select(keys).collect())
    keys = ["event_id", "ts", "user_id", "product_id", "action", "reason"]
    assert outcome(out, "error", *keys) == sorted(tuple(r) for r in C.cart_errors(carts).select(keys).collect())
    assert len(os.listdir(root + "/run/position/commits")) >= 5  # really several micro-batches


def test_default_arguments_lose_nothing_on_more_files_than_a_micro_batch(spark):
    t = RetailTables.from_testdata(spark, SMALL)
    root = tempfile.mkdtemp(prefix="stockroom-stream-")
    raw = spark.read.parquet(f"{SMALL}/events.parquet")
    # 70 files, each of the whole time span
    part = tempfile.mkdtemp(prefix="stockroom-slice-")
    (raw.withColumn("slice", F.col("event_id") * 37 % 70).repartition(1).write.mode("overwrite")
     .partitionBy("slice").parquet(part))
    os.makedirs(root + "/events")
    for i in range(70):
        name, = (f for f in os.listdir(f"{part}/slice={i}") if f.endswith(".parquet"))
        os.link(f"{part}/slice={i}/{name}", f"{root}/events/{i:03d}.parquet")
    out = run_cart_stream(spark, root + "/events", t.products, root + "/run", event_transform=cart_events_of,
                          finish=True).results()
    assert len([f for f in os.listdir(root + "/run/position/commits") if f.isdigit()]) == 2
    carts = C.cart_episodes(t.cart_events, t.products)
    keys = ["user_id", "product_id", "quantity", "ts", "event_id"]
    want = sorted(tuple(r) for r in C.cart_purchases(carts).select(keys).collect())
    assert outcome(out, "purchase", *keys) == want and want
    keys = ["event_id", "ts", "user_id", "product_id", "action", "reason"]
    want = sorted(tuple(r) for r in C.cart_errors(carts).select(keys).collect())
    assert outcome(out, "error", *keys) == want and want
    assert outcome(out, "late", "event_id") == []


def event(i, minute, user, product, action, quantity=None):
    return (i, dt.datetime(2000, 1, 1) + dt.timedelta(minutes=minute), user, product, action, quantity)


def test_state_falls_when_carts_close_and_late_events_are_reported(spark):
    t = from_rows(spark, {"products": []})
    products = spark.createDataFrame([(1,), (2,)], "ProductID long")
    make = lambda rows: spark.createDataFrame(rows, SCHEMAS["cart_events"])
    root = tempfile.mkdtemp(prefix="stockroom-stream-")
    go = lambda **kw: run_cart_stream(spark, root + "/events", products, root + "/run",
                                      delay=dt.timedelta(minutes=10), **kw)
    files(root + "/events", [make([event(1, 0, 1, 1, "add", 2), event(2, 1, 2, 2, "add"), event(3, 2, 3, 9, "add"),
                                   event(4, 30, 9, 9, "remove")])])
    fold = go()
    assert fold.open_carts(0).count() == 3
    files(root + "/events", [make([event(6, 35, 1, 1, "buy"), event(5, 33, 1, 1, "add", 3), event(7, 36, 2, 2, "remove"),
                                   event(8, 1, 2, 2, "add", 50), event(9, 37, 3, 9, "buy"), event(10, 60, 9, 9, "remove")])])
    fold = go()
    assert [tuple(r) for r in fold.open_carts(1).collect()] == [(3, 9, 1)]  # a missing product stays in its cart
    out = fold.results()
    assert outcome(out, "purchase", "event_id", "quantity") == [(6, 5)]
    assert outcome(out, "removal", "event_id", "quantity") == [(7, 1)]
    assert outcome(out, "late", "event_id", "quantity") == [(8, 50)]
    assert outcome(out, "error", "event_id") == [(4,), (9,)]  # event 10 still waits
    files(root + "/events", [make([event(11, 61, 1, 1, "remove")])])
    out = go(finish=True).results()
    assert outcome(out, "error", "event_id") == [(4,), (9,), (10,), (11,)]
    assert t is not None


def test_a_longer_delay_later_does_not_reopen_what_was_applied(spark):
    products = spark.createDataFrame([(1,)], "ProductID long")
    make = lambda rows: spark.createDataFrame(rows, SCHEMAS["cart_events"])
    root = tempfile.mkdtemp(prefix="stockroom-stream-")
    files(root + "/events", [make([event(1, 0, 1, 1, "add", 2), event(2, 10, 1, 1, "buy"), event(3, 200, 2, 1, "add")])])
    run_cart_stream(spark, root + "/events", products, root + "/run")
    files(root + "/events", [make([event(4, 5, 1, 1, "add", 9), event(5, 210, 2, 1, "add")])])
    files(root + "/events", [make([event(6, 142, 1, 1, "remove"), event(7, 143, 2, 1, "buy")])])
    files(root + "/events", [make([event(8, 205, 2, 1, "add", 5), event(9, 220, 2, 1, "buy")])])
    out = run_cart_stream(spark, root + "/events", products, root + "/run", files_per_trigger=1, finish=True).results()
    assert outcome(out, "late", "event_id") == [(4,)]
    assert outcome(out, "purchase", "event_id", "quantity") == [(2, 2), (9, 7)]
    assert outcome(out, "error", "event_id") == [(6,), (7,)]
    assert len(os.listdir(root + "/run/state")) <= 5
