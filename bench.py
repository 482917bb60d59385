"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from barloom.session import local_session

HEADLINE = (
    "market_breadth_by_date", "price_trend_features", "benchmark_relative_features", "recursive_indicators",
    "same_date_percentiles", "strength_snapshot", "sector_rotation_history", "point_in_time_join",
    "rank_information_coefficient", "threshold_grid", "backtest_periods", "streamed_tick_bars",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "barloom-bench")
    from barloom.plans.catalog import REGISTRY

    spark.range(1_000_000).selectExpr("sum(id)").collect()  # start the executors
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
