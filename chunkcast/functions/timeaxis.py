"""Time arithmetic on timestamps without a zone, so results do not depend on the session zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def epoch_seconds(ts: str | Column) -> Column:
    """Whole seconds since 1970-01-01 of a zone-less timestamp."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def shift_seconds(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def from_epoch_seconds(seconds: Column) -> Column:
    return shift_seconds(F.expr(_EPOCH), seconds)
