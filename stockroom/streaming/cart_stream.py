"""The cart fold as a Structured Streaming job.

Events arrive from a file source in any order.  Every micro-batch runs the batch fold
(``operators.cart``, so hot keys are split as there) over the events that are
complete by then:

* Event time decides the order.  An event waits until an event ``delay`` later
  was seen; then it is applied in (ts, event_id) order, whichever file it came in.
* What came too late for that is not applied out of order but reported with outcome ``late``.  A source that
  has ended (``finish``) is given a delay longer than the time its events span, so that none is late.
* Between micro-batches only open cart entries, one row each, and waiting events are
  kept; a cart that closes leaves nothing behind.

State and results are written to shared storage under the batch's number, the
state of a batch next to that of the one before, so a batch that Spark runs again after a failure
reads the same state and replaces its own results.

Outputs one row per remove/buy with its outcome (``purchase``, ``removal``,
``error``) -- the same rows the batch fold produces -- and the ``late`` rows.
"""

from __future__ import annotations

import datetime as _dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cart import cart_episodes, cart_errors, cart_open, cart_purchases, cart_removals
from ..session import cut_lineage, ensure_checkpoint_dir

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, product_id long, action string, quantity long"
OUT_SCHEMA = ("user_id long, product_id long, event_id long, ts timestamp_ntz, "
              "action string, outcome string, quantity long, reason string")
OPEN_SCHEMA = "user_id long, product_id long, quantity long"
# ``low``: no waiting event is older; ``since``: the batch whose part is the first of the waiting events.
CLOCK_SCHEMA = "high timestamp_ntz, cutoff timestamp_ntz, low timestamp_ntz, since long"
LATE = "late"
# Files of one micro-batch; bounds what a batch holds, however long the backlog is.
FILES_PER_TRIGGER = 64
DELAY = _dt.timedelta(hours=1)


def _events(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "product_id", "action",
                     F.col("quantity").cast("long").alias("quantity"))


def _outcomes(carts, late: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string").alias("reason")
    columns = ["user_id", "product_id", "event_id", "ts", "action", "outcome", "quantity", "reason"]

    def closed(df: DataFrame, action: str, outcome: str) -> DataFrame:
        return df.select("user_id", "product_id", "event_id", "ts", F.lit(action).alias("action"),
                         F.lit(outcome).alias("outcome"), "quantity", none)

    failed = cart_errors(carts).select("user_id", "product_id", "event_id", "ts", "action",
                                       F.lit("error").alias("outcome"),
                                       F.lit(None).cast("long").alias("quantity"), "reason")
    return (closed(cart_purchases(carts), "buy", "purchase")
            .unionByName(closed(cart_removals(carts), "remove", "removal")).unionByName(failed)
            .unionByName(late.withColumn("outcome", F.lit(LATE)).withColumn("reason", none).select(columns)))


class CartFold:
    """The fold's state below ``root``, stepped once for each micro-batch."""

    def __init__(self, spark: SparkSession, root: str, products: DataFrame, delay: _dt.timedelta = DELAY):
        self.spark, self.root, self.products, self.delay = spark, root.rstrip("/"), products, delay

    def _path(self, batch: int, part: str) -> str:
        return f"{self.root}/state/{batch:010d}/{part}"

    def state(self, batch: int, part: str, schema: str) -> DataFrame:
        """A part of the state that a batch left; empty before the first."""
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(batch, part))

    def open_carts(self, batch: int) -> DataFrame:
        return self.state(batch, "open", OPEN_SCHEMA)

    def _waiting(self, batch: int, since: int) -> DataFrame:
        """The events that wait after a batch: the parts of the batches from ``since`` on."""
        if batch < 0:
            return self.state(batch, "waiting", EVENT_SCHEMA)
        return self.spark.read.schema(EVENT_SCHEMA).parquet(
            *[self._path(b, "waiting") for b in range(since, batch + 1)])

    def _drop(self, batch: int, since: int) -> None:
        """Delete the state that no batch from ``batch`` on can ask for any more: waiting events from before ``since``
        and all else from before the batch's own beginning."""
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for part in ("open", "clock"):
            fs.delete(fs_path(self._path(batch - 2, part)), True)
        for held in fs.listStatus(fs_path(f"{self.root}/state")):
            if int(held.getPath().getName()) < since:
                fs.delete(held.getPath(), True)

    def step(self, new: DataFrame, batch: int, everything: bool = False) -> None:
        """Apply a micro-batch; ``everything`` also applies the events that still wait."""
        clock = self.state(batch - 1, "clock", CLOCK_SCHEMA).first()
        since = batch - 1 if not clock or clock["since"] is None else clock["since"]
        new = cut_lineage(_events(new))
        waiting = self._waiting(batch - 1, since)
        low, high = new.agg(F.min("ts"), F.max("ts")).first()
        low = min([t for t in (low, clock and clock["low"]) if t is not None], default=None)
        high = max([t for t in (high, clock and clock["high"]) if t is not None], default=None)
        before = clock and clock["cutoff"]
        cutoff = high if everything or high is None else high - min(self.delay, high - _dt.datetime.min)
        if before and cutoff < before:  # a longer delay than before: what was applied stays applied
            cutoff = before
        late = new.where(F.col("ts") <= F.lit(before).cast("timestamp_ntz")) if before else new.limit(0)
        timely = new.where(F.col("ts") > F.lit(before).cast("timestamp_ntz")) if before else new
        due = F.col("ts") <= F.lit(cutoff).cast("timestamp_ntz")
        # While no event is due, the waiting ones stay where they are and only the new ones are written.
        idle = (not clock or clock["since"] is not None) and (low is None or low > cutoff)
        ready = new.limit(0) if idle else timely.unionByName(waiting).where(due)
        rest = timely if idle else timely.unionByName(waiting).where(~due)
        # An open entry goes on as one add before all events.
        carried = self.open_carts(batch - 1).select(
            F.lit(-1).cast("long").alias("event_id"), F.lit(_dt.datetime(1, 1, 1)).cast("timestamp_ntz").alias("ts"),
            "user_id", "product_id", F.lit("add").alias("action"), "quantity")
        carts = cart_episodes(ready.unionByName(carried), self.products)
        _outcomes(carts, late).write.mode("overwrite").parquet(f"{self.root}/out/batch={batch}")
        cart_open(carts).write.mode("overwrite").parquet(self._path(batch, "open"))
        rest.write.mode("overwrite").parquet(self._path(batch, "waiting"))
        if not idle:
            low = self._waiting(batch, batch).agg(F.min("ts")).first()[0]
        keep = max(since, 0) if idle else batch
        self.spark.createDataFrame([(high, cutoff, low, keep)], CLOCK_SCHEMA).coalesce(1).write.mode(
            "overwrite").parquet(self._path(batch, "clock"))
        if batch >= 2:
            self._drop(batch, since)

    def results(self) -> DataFrame:
        return self.spark.read.schema(OUT_SCHEMA + ", batch long").parquet(f"{self.root}/out").drop("batch")


def _span(spark: SparkSession, events_path: str, event_transform) -> _dt.timedelta:
    """The time between the first and the last event of the files."""
    raw = spark.read.parquet(events_path)
    low, high = _events(event_transform(raw) if event_transform else raw).agg(F.min("ts"), F.max("ts")).first()
    return high - low if high else _dt.timedelta(0)


def run_cart_stream(spark: SparkSession, events_path: str, products: DataFrame, root: str | None = None,
                    files_per_trigger: int = FILES_PER_TRIGGER, delay: _dt.timedelta | None = None,
                    event_transform=None, finish: bool = False) -> CartFold:
    """Run the fold over the parquet files at ``events_path`` until caught up.

    ``event_transform`` maps the raw file rows to the cart-event schema.
    ``root`` (on shared storage) keeps the stream's position, state and results; running again with the
    same root goes on with files that came since.  ``finish`` also applies
    the events that still wait for later ones: for a source that has ended.
    ``delay`` is ``DELAY`` unless given; with ``finish`` it is more than the time between the source's first and
    last event, so that every event is applied, whichever file and micro-batch it comes in.
    """
    root = root or os.path.join(ensure_checkpoint_dir(spark), "cart-stream")
    if os.path.isfile(events_path):
        # The file source watches directories or globs; a single local file is
        # given as a one-file glob.
        events_path = f"{events_path[:-1]}[{events_path[-1]}]"
    raw = (spark.readStream.schema(spark.read.parquet(events_path).schema)
           .option("maxFilesPerTrigger", files_per_trigger).parquet(events_path))
    events = event_transform(raw) if event_transform else raw
    if delay is None:
        delay = _span(spark, events_path, event_transform) + _dt.timedelta(seconds=1) if finish else DELAY
    fold = CartFold(spark, root, products, delay)
    last = [-1]

    def step(df: DataFrame, batch: int) -> None:
        fold.step(df, batch)
        last[0] = batch

    q = (events.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/position")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if finish:
        fold.step(spark.createDataFrame([], EVENT_SCHEMA), last[0] + 1, everything=True)
    return fold
