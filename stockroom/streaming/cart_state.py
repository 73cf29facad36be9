"""The cart as keyed state with event-time timers.

Each (user, product) has a state of its own in the state store: the quantity in the cart, and the events that wait for
their time.  An event waits until the watermark (the latest event time seen, less ``delay``) has passed it;
a timer then applies what is due in (ts, event_id) order.  An event travels as one JSON cell, as Spark hands
rows to Python cell by cell, and a key's events of one micro-batch wait as one value and its timer is kept beside the cart, as each
question to the state store goes through a socket and asking for timers is a scan.  So outcomes leave as soon as their time is complete, whatever
order files came in, and a key whose cart is closed and that has nothing waiting keeps no state.

Events from before the watermark come too late; Spark drops and counts them (``numRowsDroppedByWatermark``).
A source that has ended is closed by a mark: an event of no user, later than all others by more than the delay, which lets all
timers go off.  Outcomes go to files below ``root``, each micro-batch's exactly once.

The rows are those of the batch fold (``operators.cart``): one for each remove and buy.
"""

from __future__ import annotations

import datetime as _dt
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import params as P
from ..operators.cart import NO_SUCH_PRODUCT, NOT_IN_CART
from ..session import ensure_checkpoint_dir
from .cart_stream import DELAY, EVENT_SCHEMA, FILES_PER_TRIGGER, _events, _span

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT_SCHEMA = "user_id long, product_id long, event_id long, us long, action string, outcome string, quantity long, reason string"
_WAITING = "events string"
_EVENT = ["event_id", "us", "action", "quantity", "known"]
MARK = "mark"


def apply_due(open_quantity: int | None, events: list[tuple]) -> tuple[int | None, list[tuple]]:
    """(quantity in the cart, None without an entry; outcomes) after events (us, event_id, action, quantity, known) in order."""
    out = []
    for us, event_id, action, quantity, known in sorted(events, key=lambda e: e[:2]):
        if action == "add":
            open_quantity = (open_quantity or 0) + quantity
        elif action in ("remove", "buy"):
            if open_quantity is None:
                out.append((event_id, us, action, "error", None, NOT_IN_CART))
            elif action == "buy" and not known:
                out.append((event_id, us, action, "error", None, NO_SUCH_PRODUCT))
                continue
            else:
                out.append((event_id, us, action, "removal" if action == "remove" else "purchase", open_quantity, None))
            open_quantity = None
    return open_quantity, out


class CartProcessor(StatefulProcessor):
    """State and timers of one (user, product)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cart = handle.getValueState("cart", "quantity long, timer long")
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came = json.loads(f"[{','.join(r.event for r in rows)}]")
        new = [tuple(e.get(c) for c in _EVENT) for e in came if e.get("action") != MARK]
        if new:
            self.waiting.appendValue((json.dumps(new),))
            self._wake(min(e[1] for e in new))
        return iter(())

    def _wake(self, us: int) -> None:
        """Have the key's one timer go off for an event of this time."""
        at = -(-us // 1000)
        quantity, timer = self.cart.get() or (None, None)
        if timer is None or at < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
            self.cart.update((quantity, at))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = [e for r in self.waiting.get() for e in json.loads(r[0])]
        due = [(us, i, action, q, known) for i, us, action, q, known in held if us <= now]
        rest = [e for e in held if e[1] > now]
        before = (self.cart.get() or (None,))[0]
        after, outcomes = apply_due(before, due)
        if rest:
            self.waiting.put([(json.dumps(rest),)])
            timer = -(-min(e[1] for e in rest) // 1000)
            self.handle.registerTimer(timer)
        else:
            self.waiting.clear()
            timer = None
        if after is None and timer is None:
            self.cart.clear()
        else:
            self.cart.update((after, timer))
        for event_id, us, action, outcome, quantity, reason in outcomes:
            yield Row(user_id=key[0], product_id=key[1], event_id=event_id, us=us, action=action, outcome=outcome,
                      quantity=quantity, reason=reason)

    def close(self) -> None:
        pass


def _run(spark: SparkSession, events: DataFrame, products: DataFrame, root: str, delay: _dt.timedelta):
    """One run of the stream until it has caught up; its progress reports."""
    known = products.select(F.col("ProductID").alias("product_id")).distinct().withColumn("known", F.lit(True))
    ready = (events.withColumn("at", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("at"))
             .withColumn("quantity", F.coalesce("quantity", F.lit(P.DEFAULT_ADD_QUANTITY).cast("long")))
             .join(known, "product_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
             .withWatermark("at", f"{int(delay.total_seconds() * 1000)} milliseconds")
             .select("user_id", "product_id", "at", F.to_json(F.struct(*_EVENT)).alias("event")))
    out = ready.groupBy("user_id", "product_id").transformWithState(
        CartProcessor(), OUT_SCHEMA, outputMode="Append", timeMode="EventTime")
    q = (out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/position")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q.recentProgress


def run_cart_state(spark: SparkSession, events_path: str, products: DataFrame, root: str | None = None,
                   files_per_trigger: int = FILES_PER_TRIGGER, delay: _dt.timedelta | None = None, event_transform=None,
                   finish: bool = False) -> tuple[DataFrame, list]:
    """(outcomes, progress reports) of the parquet files at ``events_path``, applied until caught up.

    Running again with the same ``root`` (on shared storage) and delay goes on with files that came since.  ``finish`` closes the
    source; without a ``delay`` of its own it then gets one longer than the time its events span, so that none is late.
    """
    root = (root or os.path.join(ensure_checkpoint_dir(spark), "cart-state")).rstrip("/")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    if delay is None:
        delay = _span(spark, events_path, event_transform) + _dt.timedelta(seconds=1) if finish else DELAY
    if os.path.isfile(events_path):  # the file source watches folders and globs
        events_path = f"{events_path[:-1]}[{events_path[-1]}]"
    plain = spark.read.parquet(events_path)

    def stream(path: str, schema) -> DataFrame:
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)

    raw = stream(events_path, plain.schema)
    marks = f"{root}/marks"
    spark.createDataFrame([], EVENT_SCHEMA).write.mode("ignore").parquet(marks)
    events = _events(event_transform(raw) if event_transform else raw).unionByName(stream(marks, spark.read.parquet(marks).schema))
    progress = _run(spark, events, products, root, delay)
    if finish:
        last = _events(event_transform(plain) if event_transform else plain).agg(F.max("ts")).first()[0]
        if last is not None:
            end = last + delay + _dt.timedelta(seconds=1)
            spark.createDataFrame([(None, end, None, None, MARK, None)], EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(marks)
            progress = progress + _run(spark, events, products, root, delay)
    out = spark.read.schema(OUT_SCHEMA).parquet(f"{root}/out")
    return out.withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz")).drop("us"), progress
