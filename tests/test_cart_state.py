"""The cart in keyed state against the batch fold, on files in shuffled time order."""

import datetime as dt
import json
import tempfile

from pyspark.sql import Row
from pyspark.sql import functions as F

from data_paths import SMALL
from stockroom.operators import cart as C
from stockroom.schema import SCHEMAS
from stockroom.sources import RetailTables
from stockroom.sources.retail import cart_events_of
from stockroom.streaming.cart_state import _EVENT, CartProcessor, run_cart_state
from test_streaming import event, files, outcome


def test_shuffled_files_equal_the_batch_fold(spark):
    t = RetailTables.from_testdata(spark, SMALL)
    root = tempfile.mkdtemp(prefix="stockroom-state-")
    raw = spark.read.parquet(f"{SMALL}/events.parquet")
    files(root + "/events", [raw.where(F.col("event_id") % 3 == i) for i in (2, 0, 1)])
    out, progress = run_cart_state(spark, root + "/events", t.products, root + "/run", files_per_trigger=1,
                                   event_transform=cart_events_of, finish=True)
    carts = C.cart_episodes(t.cart_events, t.products)
    keys = ["user_id", "product_id", "quantity", "ts", "event_id"]
    want = sorted(tuple(r) for r in C.cart_purchases(carts).select(keys).collect())
    assert outcome(out, "purchase", *keys) == want and want
    assert outcome(out, "removal", *keys) == sorted(tuple(r) for r in C.cart_removals(carts).select(keys).collect())
    keys = ["event_id", "ts", "user_id", "product_id", "action", "reason"]
    assert outcome(out, "error", *keys) == sorted(tuple(r) for r in C.cart_errors(carts).select(keys).collect())


def test_outcomes_leave_early_and_state_falls_when_carts_close(spark):
    products = spark.createDataFrame([(1,), (2,)], "ProductID long")
    make = lambda rows: spark.createDataFrame(rows, SCHEMAS["cart_events"])
    root = tempfile.mkdtemp(prefix="stockroom-state-")
    go = lambda **kw: run_cart_state(spark, root + "/events", products, root + "/run",
                                     delay=dt.timedelta(minutes=10), **kw)
    files(root + "/events", [make([event(2, 1, 1, 1, "buy"), event(1, 0, 1, 1, "add", 2), event(3, 2, 3, 9, "add"),
                                   event(4, 30, 9, 2, "add", 7)])])
    out, progress = go()
    assert outcome(out, "purchase", "event_id", "quantity") == [(2, 2)]  # the source goes on, this is decided
    held = progress[-1]["stateOperators"][0]
    files(root + "/events", [make([event(6, 36, 9, 2, "remove"), event(5, 35, 3, 9, "buy"), event(7, 3, 1, 1, "add", 50),
                                   event(8, 90, 5, 5, "remove")])])
    out, progress = go()
    assert outcome(out, "removal", "event_id", "quantity") == [(6, 7)]
    assert outcome(out, "error", "event_id", "reason") == [(5, C.NO_SUCH_PRODUCT)]  # event 8 waits, event 7 was too late
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress) == 1
    out, progress = go(finish=True)
    assert outcome(out, "error", "event_id") == [(5,), (8,)]
    after = progress[-1]["stateOperators"][0]
    assert after["numRowsTotal"] < held["numRowsTotal"]  # the cart of a missing product is all that is left


def test_a_keys_events_of_a_batch_wait_as_one_value():
    class Held:
        def __init__(self):
            self.now = None

        def get(self):
            return self.now

        def update(self, value):
            self.now = value

        def clear(self):
            self.now = None

    class Waiting(Held):
        def get(self):
            return iter(self.now or [])

        def appendValue(self, value):  # noqa: N802
            self.now = [*(self.now or []), value]

        def put(self, values):
            self.now = values

    class Handle:  # has no listTimers: a key's timer is known from its state
        timers: set = set()
        getValueState, getListState = (lambda *a: Held()), (lambda *a: Waiting())  # noqa: N815, E731
        registerTimer, deleteTimer = timers.add, timers.discard  # noqa: N815

    class Times:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    cart = CartProcessor()
    cart.init(handle := Handle())
    rows = lambda *events: iter([Row(event=json.dumps(dict(zip(_EVENT, e)))) for e in events])
    cart.handleInputRows((1, 2), rows((5, 9000, "buy", 1, True), *[(i, 2000 + i, "add", 2, True) for i in range(4)]), Times(0))
    assert len(cart.waiting.now) == 1 and handle.timers == {2}
    cart.handleInputRows((1, 2), rows((7, 1000, "add", 1, True), (8, 99000, "remove", None, True)), Times(0))
    assert len(cart.waiting.now) == 2 and handle.timers == {1}
    handle.timers.clear()  # a timer that goes off is gone
    out = list(cart.handleExpiredTimer((1, 2), Times(50), None))
    assert [(r.event_id, r.outcome, r.quantity) for r in out] == [(5, "purchase", 9)]
    assert len(cart.waiting.now) == 1 and handle.timers == {99}
    assert [r.reason for r in cart.handleExpiredTimer((1, 2), Times(99), None)] == [C.NOT_IN_CART]
    assert cart.waiting.now is None and cart.cart.now is None
