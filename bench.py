"""Headline queries, timed end to end; prints one JSON line.

Every query starts from the files, with nothing kept from the ones before it, and is written to Spark's no-op sink, so
the whole result is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import time

from tickloom.plans import registry
from tickloom.plans.common import forget_shared
from tickloom.session import local_session

HEADLINE = (
    "bars_overview", "bars_minute", "gaps", "asof_rates", "asof_ticks", "ema_family", "feature_table", "labels_long", "trades_chain",
    "trade_equity", "equity_summary", "panel_wide", "momentum", "rank_curve_long_short", "screen", "orders", "settlement",
    "portfolio_curve", "calibration", "permutation_null", "stream_bars",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus))
    chosen = registry.queries()
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # session start-up is not part of any query
    seconds = {}
    for name in HEADLINE:
        forget_shared()
        start = time.perf_counter()
        chosen[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
