"""Run settings, with the full-size preset as the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SearchOptions:
    """Order limits and switches of the per-chunk model fit."""

    max_p: int = 5
    max_q: int = 5
    max_P: int = 2
    max_Q: int = 2
    max_order: int = 5
    max_d: int = 2
    max_D: int = 1
    allow_mean: bool = True
    allow_drift: bool = True
    approximation: bool = False

    def __post_init__(self):
        limits = (self.max_p, self.max_q, self.max_P, self.max_Q, self.max_order, self.max_d, self.max_D)
        if min(limits) < 0:
            raise ValueError("order limits must be non-negative")


@dataclass(frozen=True)
class ForecastConfig:
    """Everything one forecasting run needs besides the series itself.

    ``order=None`` asks for automatic orders; ``(p, d, q)`` and ``(P, D, Q)`` fix them.
    ``max_chunk_rows``, if given, raises the number of chunks of a series that is longer than
    ``chunks * max_chunk_rows``, so that one fitting task never holds more rows than that.
    ``keep_unconverged`` uses the estimates of fits that stopped at their iteration limit or lie near
    the unit circle, with their status; False leaves those chunks out.
    """

    period: int = 24
    tol: int = 2000
    chunks: int = 150
    h: int = 2879
    levels: tuple[float, ...] = (95.0,)
    order: tuple[int, int, int] | None = None
    seasonal: tuple[int, int, int] = (0, 0, 0)
    interval_seconds: int = 3600
    max_chunk_rows: int | None = None
    rebase_trend: bool = True
    keep_unconverged: bool = True
    search: SearchOptions = field(default_factory=SearchOptions)

    def __post_init__(self):
        if self.h < 1:
            raise ValueError("h must be at least 1")
        if min(self.period, self.tol, self.chunks, self.interval_seconds) < 1:
            raise ValueError("period, tol, chunks and interval_seconds must be at least 1")
