"""Time the headline queries and print one JSON line.

Every query runs twice, all once and then all again: ``queries`` has the second
runs, when code is compiled, and ``first_run`` the first.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores)
and BENCH_QUERIES (comma-separated names, default the headline set).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

HEADLINE = [
    "slice_sma_hourly_rank",
    "lake_upsert_last_wins",
    "frames_trades",
    "frames_depth_levels",
    "asof_backward_mark",
    "asof_nearest_snap",
    "asof_forward_open",
    "reference_price",
    "bars_hourly",
    "bars_tick_n",
    "sma",
    "ema",
    "rsi",
    "macd",
    "vector_equity",
    "sweep_ranked",
    "fifo_trades",
    "trade_stats",
    "avg_cost_positions",
    "account_equity",
    "equity_from_fills",
    "perf_metrics",
    "parity_metrics",
    "walk_forward",
    "participation_fills",
    "limit_fills",
    "trailing_fills",
    "order_state",
    "pretrade_screen",
    "account_breaches",
    "chain_greeks",
    "implied_vol_reprice",
    "book_at_end",
    "book_top_series",
    "book_gaps",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from tidebook.plans import catalog, market
    from tidebook.session import local_session

    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    spark = local_session(cpus, shuffle_partitions=8)

    def run(name: str) -> float:
        market._CUTS.clear()  # measuring them is part of a query
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run(names[0])  # JVM and Python workers warm up outside the timing
    cold = {n: round(run(n), 3) for n in names}
    seconds = {n: round(run(n), 3) for n in names}
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "first_run": cold,
                "sf": float(found.group(1).rstrip(".")) if found else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
