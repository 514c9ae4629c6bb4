"""Lagged values inside long series: blocks with a halo of earlier rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

BLOCK_ROWS = 50_000


def with_halo(df: DataFrame, p: int, pos: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Cut the position axis into blocks of ``block_rows`` and give each block the ``p`` rows before
    it, marked ``_halo``.

    Only rows near the end of a block are copied. A block holds at most ``block_rows + p`` rows, so
    the windows over it stay bounded for a scope of any length.
    """
    size = max(block_rows, 4 * p)
    return (
        df.selectExpr("*", f"({pos} - 1) DIV {size} AS _own")
        .selectExpr("*", f"explode(sequence(_own, ({pos} - 1 + {p}) DIV {size})) AS _block")
        .selectExpr("* EXCEPT (_own)", "_block > _own AS _halo")
    )


def block_window(scope: list[str], pos: str) -> WindowSpec:
    return Window.partitionBy(*scope, "_block").orderBy(pos)


def add_lags(
    df: DataFrame,
    lags: list[int],
    scope: list[str],
    pos: str,
    value: str = "y",
    prefix: str = "l",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``<prefix><i>`` = the value ``i`` positions earlier in the scope; null before its start."""
    window = block_window(scope, pos)
    with_lags = with_halo(df, max(lags), pos, block_rows).select(
        "*", *[F.lag(value, i).over(window).alias(f"{prefix}{i}") for i in lags]
    )
    return with_lags.filter(~F.col("_halo")).drop("_block", "_halo")
