"""Registered streaming form of the cart fold (checked against the batch oracle)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.retail import cart_events_of
from ..streaming.cart_state import run_cart_state
from ..streaming.cart_stream import run_cart_stream
from .q_cart import _CART
from .registry import query


def _outcomes(t):
    spark = t.spark
    root = os.path.join(ensure_checkpoint_dir(spark), f"cart-stream-{uuid.uuid4().hex}")
    return run_cart_stream(spark, t.paths["events"], t.products, root, event_transform=cart_events_of,
                           finish=True).results()


_PURCHASES = """
SELECT user_id, product_id, quantity, closer_ts AS ts, closer_id AS event_id
FROM eps WHERE closer_action = 'buy' AND adds > 0
"""
_ERRORS = """
SELECT event_id, ts, user_id, product_id, action,
       CASE WHEN is_reset THEN 'not in cart'
            WHEN adds_so_far = 0 THEN 'not in cart' ELSE 'product does not exist' END AS reason
FROM (SELECT ev4.*, eps.adds FROM ev4 JOIN eps USING (user_id, product_id, episode)) x
WHERE action IN ('remove', 'buy') AND (NOT is_reset OR adds = 0)
"""


@query("cart_stream_purchases", _PURCHASES, extra_ctes=_CART)
def q_cart_stream_purchases(t):
    """Cart purchases from the streaming fold (open carts kept between micro-batches)."""
    return (_outcomes(t).where(F.col("outcome") == "purchase")
            .select("user_id", "product_id", "quantity", "ts", "event_id"))


@query("cart_stream_errors", _ERRORS, extra_ctes=_CART)
def q_cart_stream_errors(t):
    """Failed removes and buys from the streaming fold."""
    return (_outcomes(t).where(F.col("outcome") == "error")
            .select("event_id", "ts", "user_id", "product_id", "action", "reason"))


def _timed(t):
    spark = t.spark
    root = os.path.join(ensure_checkpoint_dir(spark), f"cart-state-{uuid.uuid4().hex}")
    return run_cart_state(spark, t.paths["events"], t.products, root, event_transform=cart_events_of, finish=True)[0]


@query("cart_state_purchases", _PURCHASES, extra_ctes=_CART)
def q_cart_state_purchases(t):
    """Cart purchases from keyed state with event-time timers."""
    return _timed(t).where(F.col("outcome") == "purchase").select("user_id", "product_id", "quantity", "ts", "event_id")


@query("cart_state_errors", _ERRORS, extra_ctes=_CART)
def q_cart_state_errors(t):
    """Failed removes and buys from keyed state with event-time timers."""
    return _timed(t).where(F.col("outcome") == "error").select("event_id", "ts", "user_id", "product_id", "action", "reason")
