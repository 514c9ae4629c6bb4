"""Cleaning, contiguous indexing, chunking and hold-out separation.

Nothing here puts a whole series into one task. Rows are ranked inside time cells of bounded
length, and only one count per cell takes part in the running sum that turns the ranks into
positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from chunkcast.functions.timeaxis import epoch_seconds, from_epoch_seconds
from chunkcast.session import staged

# Intervals per time cell: the most rows of one series that one window group can hold.
CELL_ROWS = 50_000


def clean(series: DataFrame) -> DataFrame:
    """Drop rows without a time or a usable value."""
    return series.na.drop(subset=["ts", "y"]).filter(~F.isnan("y"))


def fill_gaps(series: DataFrame, interval_seconds: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Add the missing intervals between the first and the last time of each series, with null y.

    The grid is generated cell by cell, and the cells are dealt to tasks before they are filled, so
    neither an array nor a task spans a long series.
    """
    step = F.lit(interval_seconds).cast("bigint")
    width = F.lit(interval_seconds * cell_rows).cast("bigint")
    span = series.groupBy("series_id").agg(
        F.min(epoch_seconds("ts")).alias("_lo"), F.max(epoch_seconds("ts")).alias("_hi")
    )
    grid = (
        span.withColumn("_from", F.explode(F.sequence("_lo", "_hi", width)))
        .withColumn("_to", F.least(F.col("_from") + width - step, F.col("_hi")))
        .repartition("series_id", "_from")
        .select("series_id", F.explode(F.sequence("_from", "_to", step)).alias("_slot"))
        .select("series_id", from_epoch_seconds(F.col("_slot")).alias("ts"))
    )
    return grid.join(series, ["series_id", "ts"], "full")


def series_sizes(series: DataFrame) -> DataFrame:
    """Sample size per series."""
    return series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


def index_series(series: DataFrame, interval_seconds: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Add ``idx`` = 1..n in time order and the series size ``n``.

    A series with at most one row per interval has at most ``cell_rows`` rows per time cell, however
    long it is; each cell is ranked on its own and shifted by the number of earlier rows. For feeds
    with many rows per interval use :func:`index_series_by_range`. Rows with equal time are ordered
    by value; rows without a value, such as filled intervals, have a position too. The counts read the same aggregated input as the rows, so Spark computes that once;
    the cell is kept free of nulls, as a null check on one side only would make the inputs differ.
    """
    width = F.lit(interval_seconds * cell_rows).cast("bigint")
    in_cells = series.withColumn("_cell", F.coalesce(F.floor(epoch_seconds("ts") / width), F.lit(0)))
    before = Window.partitionBy("series_id").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("series_id")
    offsets = (
        in_cells.groupBy("series_id", "_cell")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            "series_id",
            "_cell",
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
            F.sum("_rows").over(whole).alias("n"),
        )
    )
    in_order = Window.partitionBy("series_id", "_cell").orderBy("ts", "y")
    return (
        in_cells.withColumn("_rank", F.row_number().over(in_order))
        .join(offsets, ["series_id", "_cell"])
        .withColumn("idx", F.col("_before") + F.col("_rank"))
        .drop("_cell", "_rank", "_before")
    )


def index_series_by_range(series: DataFrame, partitions: int | None = None) -> DataFrame:
    """Same result columns as :func:`index_series` for feeds with bursts or many equal times.

    Rows are range-partitioned by series and time, with the read position as the last sort key so
    that copies spread over tasks too, and written once to the shared folder. Positions come from
    the written table, so a repeated task cannot see other partition borders.
    """
    spark = series.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["series_id", "ts", "_read"]
    ranged = (
        series.withColumn("_read", F.monotonically_increasing_id())
        .repartitionByRange(partitions, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_loc", F.monotonically_increasing_id())
    )
    table = staged(ranged.drop("_read"), "ranged")
    before = Window.partitionBy("series_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        table.groupBy("series_id", "_part")
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_loc").alias("_first"))
        .select(
            "series_id",
            "_part",
            (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
            F.sum("_rows").over(Window.partitionBy("series_id")).alias("n"),
        )
    )
    return (
        table.join(offsets, ["series_id", "_part"])
        .withColumn("idx", F.col("_loc") + F.col("_shift"))
        .drop("_part", "_loc", "_shift")
    )


def split_holdout(indexed: DataFrame, h: int) -> DataFrame:
    """Mark the last ``h`` rows of each series as ``test`` with ``step`` 1..h; ``n`` becomes the
    training size."""
    if h < 1:
        raise ValueError("h must be at least 1")
    train = F.greatest(F.col("n") - h, F.lit(0))
    return indexed.select(
        *[c for c in indexed.columns if c != "n"],
        train.alias("n"),
        F.when(F.col("idx") > train, "test").otherwise("train").alias("split"),
        F.when(F.col("idx") > train, F.col("idx") - train).alias("step"),
    )


def train_rows(split: DataFrame) -> DataFrame:
    return split.filter(F.col("split") == "train").drop("split", "step")


def test_rows(split: DataFrame) -> DataFrame:
    return split.filter(F.col("split") == "test").select("series_id", "step", "ts", "y")


def index_holdout(holdout: DataFrame, interval_seconds: int) -> DataFrame:
    """``(series_id, step, ts, y)`` of separate hold-out rows in time order; null values keep their
    step, so that later steps still meet the right forecast. Rows without a time take no step; count
    them with :func:`untimed_rows`."""
    return index_series(holdout.filter(F.col("ts").isNotNull()), interval_seconds).select(
        "series_id", F.col("idx").alias("step"), "ts", "y"
    )


def untimed_rows(rows: DataFrame) -> DataFrame:
    """Rows without a time, per series."""
    return rows.groupBy("series_id").agg(F.count_if(F.col("ts").isNull()).alias("untimed"))


def assign_chunks(indexed: DataFrame, chunks: int, max_chunk_rows: int | None = None) -> DataFrame:
    """Add ``chunk`` 1..K of floor(n/K) rows each, the last one taking the remainder.

    Also adds ``chunk_size`` and ``pos``, the position inside the chunk. ``max_chunk_rows`` raises K
    for a series too long for ``chunks`` chunks of that size.
    """
    if chunks < 1:
        raise ValueError("chunks must be at least 1")
    k = F.lit(chunks).cast("bigint")
    if max_chunk_rows is not None:
        k = F.greatest(k, F.ceil(F.col("n") / max_chunk_rows))
    return (
        indexed.withColumn("_k", k)
        .withColumn("chunk_size", F.greatest(F.floor(F.col("n") / F.col("_k")), F.lit(1).cast("bigint")))
        .withColumn("chunk", F.least(F.ceil(F.col("idx") / F.col("chunk_size")), F.col("_k")).cast("int"))
        .withColumn("pos", F.col("idx") - (F.col("chunk") - 1) * F.col("chunk_size"))
        .drop("_k")
    )


def chunk_counts(chunked: DataFrame) -> DataFrame:
    """Rows per chunk."""
    return chunked.groupBy("series_id", "chunk").agg(F.count(F.lit(1)).alias("n_k"))
