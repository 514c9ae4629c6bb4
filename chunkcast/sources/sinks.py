"""Writers for series and run results. Every writer writes in parallel, one file per task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Rows of one series per written file.
FILE_ROWS = 5_000_000


def write_series_csv(split: DataFrame, folder: str) -> None:
    """Train and hold-out values per series as ``series_id=../split=../*.csv`` with ``demand,time``.

    Rows are brought together by series and stretch of positions, so a short series is one file and
    a long one is many files written by many tasks.
    """
    rows = split.repartition("series_id", "split", F.expr(f"idx DIV {FILE_ROWS}")).select(
        "series_id", "split", F.col("y").alias("demand"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"),
    )
    rows.write.mode("overwrite").partitionBy("series_id", "split").option("header", True).csv(folder)


def write_coefficients_csv(model: DataFrame, folder: str) -> None:
    """Combined coefficients in long form: ``series_id,pos,theta,sigma2``."""
    rows = model.select("series_id", "sigma2", F.posexplode("coef").alias("pos", "theta"))
    rows.select("series_id", "pos", "theta", "sigma2").write.mode("overwrite").option("header", True).csv(folder)


def write_forecast_csv(forecast: DataFrame, folder: str) -> None:
    """Point forecasts and bounds with their step, time and level."""
    rows = forecast.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    rows.write.mode("overwrite").option("header", True).csv(folder)


def write_bundle(run, folder: str) -> None:
    """Coefficients, forecast, scores, summary, status and fitted values of a run as Parquet tables under one folder."""
    for name in ("coefficients", "forecast", "scores", "summary", "status", "fitted"):
        getattr(run, name).write.mode("overwrite").parquet(f"{folder}/{name}")
