"""Headline timings: one JSON line with seconds per query.

``BENCH_SF_DIR`` names the tables (default sf0.1) and ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession, functions as F

from chunkcast.config import ForecastConfig, SearchOptions
from chunkcast.operators import combine as cb
from chunkcast.operators import prepare as pr
from chunkcast.operators.expand import expand_models
from chunkcast.operators.local_ar import fit_local_ar
from chunkcast.plans import catalogue as cat
from chunkcast.plans import runs
from chunkcast.sources import series as src

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
LONG_ROWS = 1_000_000


def ar_combined(k: int):
    """Chunk, fit and combine the daily shipments on k chunks."""
    return lambda spark: cb.combine(fit_local_ar(pr.assign_chunks(cat.shipments_indexed(spark, SF_DIR), k), 2))


def long_series(spark):
    """Shipments repeated to a million points in a row: indexing, chunking, fitting and combining."""
    daily = src.daily_shipments(spark, SF_DIR).repartition(4 * int(CPUS))
    copies = LONG_ROWS // 2500
    longer = daily.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select(
        "series_id", (F.col("ts") + F.make_dt_interval(F.col("_copy") * 2600)).alias("ts"), (F.col("y") / 1e6).alias("y")
    )
    indexed = pr.index_series(pr.clean(longer), cat.DAY)
    return cb.combine(fit_local_ar(pr.assign_chunks(indexed, 64), 2))


def expansion(tol: int):
    return lambda spark: expand_models(cat.moment_models(spark, SF_DIR), tol)


def search(approximation: bool):
    options = SearchOptions(max_p=2, max_q=2, max_P=1, max_Q=1, approximation=approximation)
    config = ForecastConfig(period=24, search=options)
    return lambda spark: runs.fit_sarima(cat.events_for_fit(spark, SF_DIR), config)


def full_run(spark):
    config = ForecastConfig(
        period=24, tol=500, chunks=4, h=48, order=(2, 0, 1), seasonal=(1, 0, 0), search=SearchOptions(allow_drift=False)
    )
    return runs.run_forecast(src.hourly_events(spark, SF_DIR), config).scores


def named(query: str):
    return lambda spark: cat.QUERIES[query](spark, SF_DIR)


BENCH = {
    **{q: named(q) for q in ("row_index", "ar2_local", "dlsa_weighted", "dlsa_full_p2", "fitted_residuals",
                             "forecast_ar2", "score_steps", "flagship")},
    **{f"ar_combine_k{k}": ar_combined(k) for k in (4, 16, 64)},
    "long_series_1e6": long_series,
    **{f"expand_tol{t}": expansion(t) for t in (100, 500, 2000)},
    "order_search": search(False),
    "order_search_approximate": search(True),
    "seasonal_run": full_run,
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("chunkcast-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    named("ar1_local")(spark).collect()  # start workers and warm the compiler once
    seconds = {}
    for name, build in BENCH.items():
        start = time.perf_counter()
        build(spark).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
