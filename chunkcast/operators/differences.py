"""Numbers of seasonal and plain differences, chosen for chunks of any length by sums over blocks.

Seasonal strength is taken from sums by phase of the detrended values. The level-stationarity test needs
the running sums C_t of the centred values only: blocks are summed, a window over the blocks gives each
its carry, and the Bartlett-weighted variance of L lags is the mean square of C_t - C_{t-L-1}
over all t, where C is zero outside of the chunk.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from chunkcast.functions.css import KPSS_5PCT, SEASONAL_STRENGTH
from chunkcast.operators.history import BLOCK_ROWS, with_halo
from chunkcast.operators.local_ar import CHUNK
from chunkcast.session import staged

KEYS = ", ".join(CHUNK)
BLOCK = f"PARTITION BY {KEYS}, _block"


def difference_rows(rows: DataFrame, sd: int, d: int, m: int, block_rows: int) -> DataFrame:
    """Values left after the differences, with positions ``t`` from 1 and their number ``n``."""
    poly = np.ones(1)
    for stride, times in ((1, d), (m, sd)):
        for _ in range(times):
            poly = np.convolve(poly, np.r_[1.0, np.zeros(stride - 1), -1.0])
    lost = len(poly) - 1
    if not lost:
        return rows
    terms = [f"{c}D * lag(y, {i}) OVER ({BLOCK} ORDER BY t)" for i, c in enumerate(poly) if c and i]
    value = " + ".join(["y", *terms])
    view = with_halo(rows, lost, "t", block_rows).selectExpr(*CHUNK, "t", "n", "_halo", f"{value} AS y")
    return view.where(f"NOT _halo AND t > {lost}").selectExpr(*CHUNK, f"t - {lost} AS t", f"n - {lost} AS n", "y")


def seasonal_strengths(rows: DataFrame, m: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(series_id, chunk, strength)`` of chunks ``t, n, y`` of more than two periods: the share of the
    variation around a centred moving average that a fixed seasonal pattern explains."""
    frame = m + 1 - m % 2
    window = f"OVER ({BLOCK} ORDER BY t)"
    view = with_halo(rows.where(f"n > {2 * m}"), frame - 1, "t", block_rows)
    runs = view.selectExpr("*", f"sum(y) OVER ({BLOCK} ORDER BY t ROWS UNBOUNDED PRECEDING) AS run")
    ends = "" if m % 2 else f" - 0.5D * (y + lag(y, {m}) {window})"
    trend = f"(run - coalesce(lag(run, {frame}) {window}, 0D){ends}) / {m}"
    loose = runs.selectExpr(*CHUNK, "t", "_halo", f"lag(y, {frame // 2}) {window} - {trend} AS x").where(f"NOT _halo AND t >= {frame}")
    phases = loose.groupBy(*CHUNK, F.expr(f"(t - {frame}) % {m}").alias("phase")).agg(
        F.count("x").alias("c"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")
    )
    sums = phases.groupBy(*CHUNK).agg(
        F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("c")).alias("own")
    )
    total = F.col("q") - F.col("s") * F.col("s") / F.col("c")
    strength = F.when(total > 0, F.greatest(F.lit(0.0), 1 - (F.col("q") - F.col("own")) / total)).otherwise(0.0)
    return sums.select(*CHUNK, strength.alias("strength"))


def level_statistics(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(series_id, chunk, level)`` of chunks ``t, n, y``: the level-stationarity statistic with a Bartlett window
    of floor(3 sqrt(n) / 13) lags; chunks of at most ten values or without variation have none."""
    spread = rows.groupBy(*CHUNK).agg(F.avg("y").alias("centre"), F.min("y").alias("low"), F.max("y").alias("high"), F.max("n").alias("n"))
    spread = spread.where("n > 10 AND high > low").selectExpr(*CHUNK, "centre", "CAST(floor(3 * sqrt(n) / 13) AS BIGINT) + 1 AS reach")
    reach = spread.agg(F.max("reach")).first()[0]
    if reach is None:
        return spread.selectExpr(*CHUNK, "CAST(NULL AS DOUBLE) AS level")
    size = max(block_rows, 4 * reach)
    centred = rows.join(spread, CHUNK).selectExpr(*CHUNK, "t", "n", "reach", "y - centre AS e", f"(t - 1) DIV {size} AS _block")
    totals = centred.groupBy(*CHUNK, "_block").agg(F.sum("e").alias("e"))
    before = f"sum(e) OVER (PARTITION BY {KEYS} ORDER BY _block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    carry = totals.selectExpr(*CHUNK, "_block", f"coalesce({before}, 0D) AS carry")
    own = f"sum(e) OVER ({BLOCK} ORDER BY t ROWS UNBOUNDED PRECEDING)"
    sums = centred.join(carry, [*CHUNK, "_block"]).selectExpr(*CHUNK, "t", "n", "reach", f"carry + {own} AS c")
    # C_{t - reach}: in units of reach, the place one below, wherever the chunk's reach lies
    near = 0.25 / reach
    view = with_halo(sums, reach, "t", size).selectExpr("*", f"(t - _block * {size}) / CAST(reach AS DOUBLE) AS place")
    back = f"first(c) OVER ({BLOCK} ORDER BY place RANGE BETWEEN {1 + near}D PRECEDING AND {1 - near}D PRECEDING)"
    lagged = view.selectExpr("*", f"c - coalesce({back}, 0D) AS w").where("NOT _halo")
    tail = F.when(F.col("t") > F.col("n") - F.col("reach"), F.col("c") * F.col("c")).otherwise(0.0)
    parts = lagged.groupBy(*CHUNK).agg(
        F.sum(F.col("c") * F.col("c")).alias("squares"), (F.sum(F.col("w") * F.col("w")) + F.sum(tail)).alias("long"),
        F.max("n").alias("n"), F.max("reach").alias("reach"),
    )
    return parts.selectExpr(*CHUNK, "CASE WHEN long > 0 THEN squares * reach / (n * long) ELSE 0D END AS level")


def choose_differences(
    chunked: DataFrame, m: int, max_d: int = 2, max_sd: int = 1, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``(series_id, chunk, n_k, d, sd)`` of every chunk of ``series_id, chunk, pos, y``.

    A seasonal difference is taken while the seasonal strength is above its threshold, then plain ones
    while the test rejects a stationary level. Every round reads the rows of the chunks that are still open.
    """
    rows = chunked.selectExpr(*CHUNK, "pos AS t", "y")
    counts = rows.groupBy(*CHUNK).agg(F.max("t").alias("n"))
    rows = staged(rows.join(counts, CHUNK), "chunk-values")
    state = staged(counts.selectExpr(*CHUNK, "n AS n_k", "0 AS d", "0 AS sd"), "differences")

    def open_rows(sd: int, d: int) -> DataFrame:
        some = state.where((F.col("sd") == sd) & (F.col("d") == d)).select(*CHUNK)
        return difference_rows(rows.join(some, CHUNK, "left_semi").select(*CHUNK, "t", "n", "y"), sd, d, m, block_rows)

    def raised(found: DataFrame, counter: str, value: int, above) -> DataFrame:
        more = (F.col(counter) == value) & F.coalesce(above, F.lit(False))
        joined = state.join(found, CHUNK, "left").withColumn(counter, F.when(more, value + 1).otherwise(F.col(counter)))
        return staged(joined.select(*CHUNK, "n_k", "d", "sd"), "differences")

    for k in range(max_sd if m > 1 else 0):
        state = raised(seasonal_strengths(open_rows(k, 0), m, block_rows), "sd", k, F.col("strength") > SEASONAL_STRENGTH)
    for k in range(max_d):
        kinds = [r.sd for r in state.where(F.col("d") == k).select("sd").distinct().collect()]
        if not kinds:
            break
        found = None
        for sd in sorted(kinds):
            part = level_statistics(open_rows(sd, k), block_rows)
            found = part if found is None else found.unionByName(part)
        state = raised(found, "d", k, F.col("level") > KPSS_5PCT)
    return state
