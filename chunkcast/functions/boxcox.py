"""Inverse Box-Cox transformation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def inv_box_cox(x: Column, lam: float, variance: Column | None = None) -> Column:
    """Back-transform ``x``; with the forecast ``variance`` the result is a mean, else a median."""
    if lam == 0:
        out = F.exp(x)
        return out if variance is None else out * (1 + variance / 2)
    base = x * lam + 1
    out = F.signum(base) * F.pow(F.abs(base), F.lit(1.0 / lam))
    if lam < 0:
        # beyond the pole the transformation has no inverse
        out = F.when(x <= -1.0 / lam, out)
    if variance is not None:
        out = out * (1 + 0.5 * variance * (1 - lam) / F.pow(out, F.lit(2.0 * lam)))
    return out
