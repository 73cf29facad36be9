"""Registered cart queries (episode fold over cart events)."""

from __future__ import annotations

from ..operators import cart as C
from .registry import query

_CART = """
ev AS (
  SELECT e.event_id, e.ts, e.user_id, e.product_id, e.action, e.quantity,
         p.ProductID IS NOT NULL AS product_exists
  FROM cart_events e LEFT JOIN (SELECT DISTINCT ProductID FROM products) p ON e.product_id = p.ProductID),
ev2 AS (
  SELECT *, action = 'add' AS is_add,
         (action = 'remove' OR (action = 'buy' AND product_exists)) AS is_reset FROM ev),
ev3 AS (
  SELECT *, COALESCE(SUM(CAST(is_reset AS BIGINT)) OVER (
              PARTITION BY user_id, product_id ORDER BY ts, event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS episode
  FROM ev2),
ev4 AS (
  SELECT *, SUM(CAST(is_add AS BIGINT)) OVER (
              PARTITION BY user_id, product_id, episode ORDER BY ts, event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS adds_so_far
  FROM ev3),
eps AS (
  SELECT user_id, product_id, episode,
         COUNT(*) FILTER (WHERE is_add) AS adds,
         CAST(SUM(quantity) FILTER (WHERE is_add) AS BIGINT) AS quantity,
         MAX(action) FILTER (WHERE is_reset) AS closer_action,
         MAX(ts) FILTER (WHERE is_reset) AS closer_ts,
         MAX(event_id) FILTER (WHERE is_reset) AS closer_id
  FROM ev4 GROUP BY user_id, product_id, episode)
"""


def _closed_sql(action: str) -> str:
    return (f"SELECT user_id, product_id, CAST(episode AS BIGINT) AS episode, quantity, closer_ts AS ts, "
            f"closer_id AS event_id FROM eps WHERE closer_action = '{action}' AND adds > 0")


@query("cart_purchases", _closed_sql("buy"), extra_ctes=_CART)
def q_cart_purchases(t):
    """Successful cart buys (quantity is the entry's accumulated adds)."""
    return C.cart_purchases(C.cart_episodes(t.cart_events, t.products))


@query("cart_removals", _closed_sql("remove"), extra_ctes=_CART)
def q_cart_removals(t):
    """Successful cart removes (quantity returned)."""
    return C.cart_removals(C.cart_episodes(t.cart_events, t.products))


@query("cart_open", "SELECT user_id, product_id, quantity FROM eps WHERE closer_action IS NULL AND adds > 0",
       extra_ctes=_CART)
def q_cart_open(t):
    """Cart entries still open after the last event."""
    return C.cart_open(C.cart_episodes(t.cart_events, t.products))


@query("cart_errors", """
SELECT event_id, ts, user_id, product_id, action,
       CASE WHEN is_reset THEN 'not in cart'
            WHEN adds_so_far = 0 THEN 'not in cart' ELSE 'product does not exist' END AS reason
FROM (SELECT ev4.*, eps.adds FROM ev4 JOIN eps USING (user_id, product_id, episode)) x
WHERE action IN ('remove', 'buy') AND (NOT is_reset OR adds = 0)
""", extra_ctes=_CART)
def q_cart_errors(t):
    """Removes and buys that failed, with the reason."""
    return C.cart_errors(C.cart_episodes(t.cart_events, t.products))


@query("order_lines", """
SELECT o.user_id, o.product_id, p.Name AS ProductName, p.Category, o.quantity, p.Price,
       CAST(p.Price * o.quantity AS DECIMAL(18,2)) AS Total
FROM (SELECT user_id, product_id, quantity FROM eps WHERE closer_action IS NULL AND adds > 0) o
JOIN products p ON o.product_id = p.ProductID
""", extra_ctes=_CART)
def q_order_lines(t):
    """Open cart entries priced: product name, unit price, line total."""
    return C.order_lines(C.cart_open(C.cart_episodes(t.cart_events, t.products)), t.products)


@query("checkout_sales", """
SELECT e.closer_id AS SaleRef, e.product_id AS ProductID, e.quantity AS QuantitySold, e.closer_ts AS SaleDate,
       CAST(p.Price * e.quantity AS DECIMAL(14,2)) AS TotalAmount, e.user_id AS UserID
FROM eps e JOIN products p ON e.product_id = p.ProductID
WHERE e.closer_action = 'buy' AND e.adds > 0
""", extra_ctes=_CART)
def q_checkout_sales(t):
    """Sales rows created by cart purchases (price x quantity, no discount)."""
    return C.checkout_sales(C.cart_purchases(C.cart_episodes(t.cart_events, t.products)), t.products)
