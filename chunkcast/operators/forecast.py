"""Fitted values, recursive forecasts, standard errors and prediction intervals."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from chunkcast.functions.arrays import add_series_ratio, append_array, dot, let, list_rows
from chunkcast.functions.boxcox import inv_box_cox
from chunkcast.functions.timeaxis import shift_seconds
from chunkcast.operators.history import BLOCK_ROWS, block_window, with_halo

# Multiply-adds per series up to which the recursion stays a higher-order function.
HOF_WORK = 20_000
# Longest autoregression whose fitted values use lag columns; longer ones are convolved per block.
LAG_COLUMNS = 24


# ---- fitted values -------------------------------------------------------------------------


def lag_design(train: DataFrame, p: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Design rows ``(series_id, idx, y, lags)`` with ``lags`` = y one to p steps earlier; null for
    the first p rows of a series."""
    return _lagged_blocks(train, p, block_rows).drop("_block", "n")


def _lagged_blocks(train: DataFrame, p: int, block_rows: int) -> DataFrame:
    window = block_window(["series_id"], "idx")
    lags = F.array(*[F.lag("y", i).over(window) for i in range(1, p + 1)])
    return (
        with_halo(train.select("series_id", "idx", "n", "y"), p, "idx", block_rows)
        .withColumn("lags", F.when(F.col("idx") > p, lags))
        .filter(~F.col("_halo"))
        .drop("_halo")
    )


def _models_by_block(train: DataFrame, model: DataFrame, p: int, block_rows: int) -> DataFrame:
    """One copy of the model per block, so that it meets the rows under the keys they are already
    partitioned by and no series has to come together in one task."""
    size = max(block_rows, 4 * p)
    sizes = train.groupBy("series_id").agg(F.max("n").alias("n"))
    return (
        model.join(sizes, "series_id")
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / size))))
        .select("series_id", "_block", "coef")
    )


def fitted_values(train: DataFrame, model: DataFrame, p: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``fitted(series_id, idx, y, fitted, residual)``; the first p rows have no fitted value."""
    models = _models_by_block(train, model, p, block_rows)
    if p <= LAG_COLUMNS:
        pis = F.slice("coef", 3, p)
        fit = F.get("coef", F.lit(0)) + F.get("coef", F.lit(1)) * F.col("idx") + dot(pis, F.col("lags"))
        rows = _lagged_blocks(train, p, block_rows).join(models, ["series_id", "_block"], "left")
        out = rows.select("series_id", "idx", "y", fit.alias("fitted"))
    else:
        halo = with_halo(train.select("series_id", "idx", "y"), p, "idx", block_rows)
        # new column identities, as the model may come from the same rows
        models = models.select(*[F.col(c).alias(c) for c in models.columns])
        halo = halo.select(*[F.col(c).alias(c) for c in halo.columns])
        out = (
            halo.groupBy("series_id", "_block")
            .cogroup(models.groupBy("series_id", "_block"))
            .applyInPandas(_convolve_block, "series_id string, idx bigint, y double, fitted double")
        )
    return out.withColumn("residual", F.col("y") - F.col("fitted"))


def _convolve_block(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("idx")
    y = rows["y"].to_numpy()
    fit = np.full(len(y), np.nan)
    coef = model["coef"].iloc[0] if len(model) else None
    if coef is not None and len(y):
        c0, c1, *pi = coef
        p = len(pi)
        if len(y) > p:
            fit[p:] = np.convolve(y, pi, mode="valid")[:-1] + c0 + c1 * rows["idx"].to_numpy()[p:]
    out = rows[["series_id", "idx", "y"]].assign(fitted=fit)
    out = out[~rows["_halo"]]
    return out.astype({"fitted": object}).where(out.notna(), None)


# ---- point forecasts ------------------------------------------------------------------------


def recent_values(train: DataFrame, p: int) -> DataFrame:
    """``(series_id, n, last_ts, recent)``: the last p training values, newest first."""
    return (
        train.filter(F.col("idx") > F.col("n") - p)
        .groupBy("series_id")
        .agg(
            F.max("n").alias("n"),
            F.max("ts").alias("last_ts"),
            F.collect_list(F.struct((-F.col("idx")).alias("k"), "y")).alias("_rows"),
        )
        .withColumn("recent", F.transform(F.array_sort("_rows"), lambda r: r["y"]))
        .drop("_rows")
    )


def forecast_path(tails: DataFrame, h: int, p: int) -> DataFrame:
    """Add ``path`` = the h recursive forecasts of rows with ``coef``, ``n`` and ``recent``; null if
    the model is missing, fewer values than it has lags precede the forecast, or one of those is
    missing. ``p`` decides only where the recursion runs, not its result."""
    if h < 1:
        raise ValueError("h must be at least 1")
    if h * p <= HOF_WORK:
        path = let(lambda *v: _walk(*v, h), *[F.col(c) for c in ("coef", "n", "recent")])
        used = F.slice("recent", 1, F.size("coef") - 2)
        known = ~F.exists(used, lambda y: y.isNull() | F.isnan(y))
        return tails.withColumn("path", F.when((F.size("recent") >= F.size("coef") - 2) & known, path))
    return append_array(tails, "path", lambda batch: _walk_batch(batch, h))


def _walk(coef: Column, n: Column, recent: Column, h: int) -> Column:
    pis = F.slice(coef, 3, F.size(coef) - 2)

    def extend(acc: Column, i: Column) -> Column:
        level = F.get(coef, F.lit(0)) + F.get(coef, F.lit(1)) * (n + i)
        return F.concat(F.array(level + dot(pis, acc)), acc)

    return F.reverse(F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(h)), recent, extend), 1, h))


def _walk_batch(batch: pa.RecordBatch, h: int) -> list:
    out = []
    columns = (list_rows(batch.column("coef")), batch.column("n").to_pylist(), list_rows(batch.column("recent")))
    for coef, n, recent in zip(*columns):
        if coef is None or recent is None or len(recent) < len(coef) - 2 or np.isnan(recent[: len(coef) - 2]).any():
            out.append(None)
            continue
        pi = coef[2:][::-1]
        p = len(pi)
        y = np.concatenate([recent[:p][::-1], np.empty(h)])
        trend = coef[0] + coef[1] * (n + np.arange(1, h + 1))
        for i in range(h):
            y[p + i] = trend[i] + pi @ y[i : p + i]
        out.append(y[p:])
    return out


# ---- standard errors and intervals ----------------------------------------------------------


def psi_weights(model: DataFrame, h: int) -> DataFrame:
    """Add ``psi`` = psi_0..psi_{h-1} of the moving-average form, psi_0 = 1."""
    one = F.array(F.lit(1.0))
    if h == 1:
        return model.withColumn("psi", F.when(F.col("coef").isNotNull(), one))
    pis = F.transform(F.slice("coef", 3, F.size("coef") - 2), lambda x: -x)
    poly = model.withColumns({"_one": one, "_den": F.concat(one, pis)})
    return add_series_ratio(poly, "_one", "_den", h - 1, "psi").drop("_one", "_den")


def forecast_steps(train: DataFrame, model: DataFrame, h: int, p: int, interval_seconds: int) -> DataFrame:
    """``(series_id, step, ts, pred, se)``: h rows per series, with null values where no forecast
    is possible."""
    tails = psi_weights(recent_values(train, p).join(model, "series_id", "left"), h)
    missing = F.array_repeat(F.lit(None).cast("double"), h)
    zipped = F.zip_with(
        F.coalesce("path", missing),
        F.coalesce("psi", missing),
        lambda pred, psi: F.struct(pred.alias("pred"), psi.alias("psi")),
    )
    # the generator carries scalars only, never the arrays themselves
    rows = forecast_path(tails, h, p).select("series_id", "last_ts", "sigma2", F.posexplode_outer(zipped).alias("at", "v"))
    running = Window.partitionBy("series_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    step = F.col("at") + 1
    return rows.select(
        "series_id",
        step.alias("step"),
        shift_seconds(F.col("last_ts"), step * F.lit(interval_seconds)).alias("ts"),
        F.col("v.pred").alias("pred"),
        F.sqrt(F.col("sigma2") * F.sum(F.col("v.psi") * F.col("v.psi")).over(running)).alias("se"),
    )


def check_levels(levels: float | Sequence[float] = (80, 95), fan: bool = False) -> list[float]:
    """Confidence levels in percent: all in (0, 1) are scaled, ``fan`` asks for 51, 54, .., 99."""
    if fan:
        return [float(x) for x in range(51, 100, 3)]
    levels = [float(levels)] if isinstance(levels, (int, float)) else [float(x) for x in levels]
    if not levels:
        raise ValueError("at least one level is needed")
    scale = 100 if all(0 < x < 1 for x in levels) else 1
    scaled = [scale * x for x in levels]
    for given, percent in zip(levels, scaled):
        if not 0 <= percent <= 99.99 and scale == 1:
            raise ValueError(f"confidence level {given:g} lies outside 0 to 99.99 percent")
    return scaled


def quantile_of(level: float) -> float:
    """Two-sided normal quantile of a confidence level in percent."""
    return NormalDist().inv_cdf(0.5 * (1 + level / 100))


def add_intervals(steps: DataFrame, levels: Sequence[float]) -> DataFrame:
    """One row per level with ``lower`` and ``upper`` = pred -+ z * se."""
    pairs = F.array(*[F.struct(F.lit(x).alias("level"), F.lit(quantile_of(x)).alias("z")) for x in levels])
    return (
        steps.withColumn("_q", F.explode(pairs))
        .withColumn("level", F.col("_q.level"))
        .withColumn("lower", F.col("pred") - F.col("_q.z") * F.col("se"))
        .withColumn("upper", F.col("pred") + F.col("_q.z") * F.col("se"))
        .drop("_q")
    )


def forecast(
    train: DataFrame,
    model: DataFrame,
    h: int,
    p: int,
    interval_seconds: int,
    levels: float | Sequence[float] = (80, 95),
    fan: bool = False,
    lam: float | None = None,
    bias_adjust: bool = False,
) -> DataFrame:
    """``forecast(series_id, step, ts, pred, se, level, lower, upper)``.

    With ``lam`` the series is taken to be on the Box-Cox scale and point forecasts and bounds are
    returned on the original one.
    """
    checked = check_levels(levels, fan)
    out = add_intervals(forecast_steps(train, model, h, p, interval_seconds), checked)
    if lam is not None:
        variance = F.col("se") * F.col("se") if bias_adjust else None
        out = out.withColumns(
            {
                "pred": inv_box_cox(F.col("pred"), lam, variance),
                "lower": inv_box_cox(F.col("lower"), lam),
                "upper": inv_box_cox(F.col("upper"), lam),
            }
        )
    return out


def missing_forecasts(rows: DataFrame) -> DataFrame:
    """Rows without a forecast or bounds, per series."""
    missing = F.col("pred").isNull() | F.col("lower").isNull() | F.col("upper").isNull()
    return rows.groupBy("series_id").agg(F.count_if(missing).alias("missing"))
