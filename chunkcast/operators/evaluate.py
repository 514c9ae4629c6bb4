"""Forecast accuracy: MASE, sMAPE and MSIS per step, and their means."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chunkcast.operators.history import BLOCK_ROWS, add_lags


def seasonal_scale(train: DataFrame, period: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean absolute seasonal-naive error of the training rows, per series."""
    rows = add_lags(train.select("series_id", "idx", "y"), [period], ["series_id"], "idx", prefix="_l", block_rows=block_rows)
    error = F.abs(F.col("y") - F.col(f"_l{period}"))
    return rows.groupBy("series_id").agg(F.avg(error).alias("scale"))


def score_steps(forecast: DataFrame, test: DataFrame, scale: DataFrame) -> DataFrame:
    """``scores(series_id, step, level, y, mase, smape, msis)``: forecasts matched with the hold-out
    by series and step. A zero scale or a zero denominator gives null."""
    y, lower, upper = F.col("y"), F.col("lower"), F.col("upper")
    alpha = (100 - F.col("level")) / 100
    zero = F.lit(0.0)
    below = F.when(lower > y, lower - y).otherwise(zero)
    above = F.when(upper < y, y - upper).otherwise(zero)
    width = F.when(y.isNotNull(), upper - lower + 2 / alpha * below + 2 / alpha * above)
    error = F.abs(y - F.col("pred"))
    return (
        forecast.drop("ts")
        .join(test.select("series_id", "step", "ts", "y"), ["series_id", "step"])
        .join(scale, "series_id", "left")
        .select(
            "series_id", "step", "ts", "level", "y", "pred", "lower", "upper",
            F.try_divide(error, "scale").alias("mase"),
            F.try_divide(error * 200, F.abs(y) + F.abs(F.col("pred"))).alias("smape"),
            F.try_divide(width, "scale").alias("msis"),
        )
    )


def unmatched_steps(forecast: DataFrame, test: DataFrame) -> DataFrame:
    """Steps that only the forecast or only the hold-out has, counted per series."""
    keys = ["series_id", "step"]
    f = forecast.select(*keys).distinct().withColumn("_f", F.lit(1))
    t = test.select(*keys).withColumn("_t", F.lit(1))
    return (
        f.join(t, keys, "full")
        .groupBy("series_id")
        .agg(
            F.count_if(F.col("_t").isNull()).alias("forecast_only"),
            F.count_if(F.col("_f").isNull()).alias("holdout_only"),
        )
    )


def mean_scores(scores: DataFrame) -> DataFrame:
    """Mean of each score over the horizon; missing steps are left out and counted."""
    missing = F.col("mase").isNull() | F.col("smape").isNull() | F.col("msis").isNull()
    return scores.groupBy("series_id", "level").agg(
        F.avg("mase").alias("mase"),
        F.avg("smape").alias("smape"),
        F.avg("msis").alias("msis"),
        F.count_if(missing).alias("missing"),
    )
