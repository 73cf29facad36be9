"""Benchmark: headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is run to completion through the ``noop`` sink (every row is
computed, nothing is collected to the driver); the time covers building the
plan (including the eager steps of iterative jobs) and running it.  All
headline queries are first run once, untimed, on the smallest tables to warm
the JVM; then the timed pass is repeated ``$BENCH_REPEAT`` times (default 2)
and each query's fastest run is reported, to damp machine noise.  Prints one
JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stockroom.plans import REGISTRY  # noqa: E402
from stockroom.session import ensure_checkpoint_dir, get_spark, ship_package  # noqa: E402
from stockroom.sources import RetailTables  # noqa: E402

HEADLINE = [
    "current_stock", "sellable_products", "shop_catalog", "low_stock_products", "stock_by_supplier",
    "recent_receipts", "largest_lot", "sales_kpis", "recent_activity", "sales_history", "price_quote",
    "report_totals", "top_products_by_quantity", "top_products_by_revenue", "top_suppliers",
    "top_suppliers_long_range", "category_breakdown", "daily_sales", "daily_sales_dense_7d",
    "sales_trend_binned", "product_suppliers", "available_suppliers", "user_roles", "stock_search",
    "cart_purchases", "cart_errors", "order_lines", "product_intake", "product_upsert", "receive_stock",
    "release_stock", "delete_products_sales", "record_sales", "reserve_stock", "current_stock_csv",
    "sales_history_after", "cart_stream_purchases",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", int(cpus) * 2,
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    # Warm-up, not timed: every headline query once on the smallest tables so
    # the timed runs measure a warm JVM (JIT, codegen cache), not start-up.
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for name in HEADLINE:
            REGISTRY[name].build(RetailTables.from_testdata(spark, warm)).write.format("noop") \
                .mode("overwrite").save()
    repeat = max(int(os.environ.get("BENCH_REPEAT", "2")), 1)
    times = {}
    for _ in range(repeat):
        for name in HEADLINE:
            t0 = time.perf_counter()
            df = REGISTRY[name].build(RetailTables.from_testdata(spark, sf_dir))
            df.write.format("noop").mode("overwrite").save()
            took = round(time.perf_counter() - t0, 3)
            times[name] = min(times.get(name, took), took)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": total, "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": int(cpus),
                      "repeat": repeat, "stat": "min over repeats, build + full execution"}))


if __name__ == "__main__":
    main()
