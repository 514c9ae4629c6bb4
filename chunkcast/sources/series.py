"""Sources of ``series(series_id string, ts timestamp_ntz, y double)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chunkcast.functions.timeaxis import epoch_seconds, from_epoch_seconds

# Decimals of the given tables' money columns.
MONEY_DIGITS = 2
# Fixed file layout: header row, columns bound by position.
CSV_SCHEMA = "demand double, time string"
CSV_NAME_PATTERN = r"^(.*)_(train|test)\.csv$"


def read_series_csv(spark: SparkSession, path: str | list[str], series_id: str) -> DataFrame:
    """One series from ``demand,time`` CSV files; an unreadable time is an error, never a lost row."""
    raw = spark.read.schema(CSV_SCHEMA).option("header", True).option("enforceSchema", True).csv(path)
    return raw.select(
        F.lit(series_id).alias("series_id"),
        F.col("time").cast("timestamp_ntz").alias("ts"),
        F.col("demand").alias("y"),
    )


def read_zone_csvs(spark: SparkSession, folder: str) -> DataFrame:
    """All ``<zone>_train.csv`` / ``<zone>_test.csv`` files of a folder in one scan, with ``split``."""
    raw = (
        spark.read.schema(CSV_SCHEMA)
        .option("header", True)
        .option("pathGlobFilter", "*_t*.csv")
        .csv(folder)
        .withColumn("_file", F.col("_metadata.file_name"))
        .filter(F.col("_file").rlike(CSV_NAME_PATTERN))
    )
    return raw.select(
        F.regexp_extract("_file", CSV_NAME_PATTERN, 1).alias("series_id"),
        F.regexp_extract("_file", CSV_NAME_PATTERN, 2).alias("split"),
        F.col("time").cast("timestamp_ntz").alias("ts"),
        F.col("demand").alias("y"),
    )


def read_series_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A stored series table, pruned to the columns of the data model."""
    return spark.read.parquet(path).select(
        F.col("series_id").cast("string"), F.col("ts").cast("timestamp_ntz"), F.col("y").cast("double")
    )


def series_from_rows(
    rows: DataFrame,
    ts: str,
    value: str,
    interval_seconds: int,
    series_id: str | Column | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Sum ``value`` per series and interval of ``interval_seconds``.

    With ``digits``, values are rounded to so many decimals and summed as whole numbers, so the result
    does not depend on the order of rows; without it they are summed as they are. The sum is partial before the shuffle: a series or an interval that holds
    most of the rows reaches the shuffle as one row per task.
    """
    if series_id is None:
        series_id = F.lit("all")
    elif isinstance(series_id, str):
        series_id = F.col(series_id)
    if digits is None:
        total = F.sum(F.col(value).cast("double"))
    else:
        total = F.sum(F.rint(F.col(value) * 10**digits).cast("bigint")) / 10**digits
    seconds = epoch_seconds(ts)
    slot = seconds - F.pmod(seconds, F.lit(interval_seconds).cast("bigint"))
    return (
        rows.filter(F.col(ts).isNotNull() & F.col(value).isNotNull())
        .groupBy(series_id.cast("string").alias("series_id"), slot.alias("_slot"))
        .agg(total.alias("y"))
        .select("series_id", from_epoch_seconds(F.col("_slot")).alias("ts"), "y")
    )


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly_events(spark: SparkSession, sf_dir: str, by_type: bool = True) -> DataFrame:
    """Hourly sum of event values, one series per event type or one over all types."""
    events = _table(spark, sf_dir, "events")
    return series_from_rows(events, "ts", "value", 3600, "event_type" if by_type else None, MONEY_DIGITS)


def daily_orders(spark: SparkSession, sf_dir: str, by_priority: bool = False) -> DataFrame:
    """Daily order totals."""
    orders = _table(spark, sf_dir, "orders")
    return series_from_rows(
        orders, "o_orderdate", "o_totalprice", 86400, "o_orderpriority" if by_priority else None, MONEY_DIGITS
    )


def daily_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily extended price of shipped lines."""
    return series_from_rows(_table(spark, sf_dir, "lineitem"), "l_shipdate", "l_extendedprice", 86400, digits=MONEY_DIGITS)
