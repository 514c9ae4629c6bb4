"""Per-chunk autoregressions by least squares, from covariance sums alone.

Conditional least squares of a pure autoregression is a linear regression on its own lags, so the
only thing a chunk has to deliver is the covariance matrix of (1..p lags, value). Spark builds that
with partial aggregation; a chunk of any length reaches the shuffle as one row per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from chunkcast.operators.history import BLOCK_ROWS, add_lags

MAX_LAGS = 12
CHUNK = ["series_id", "chunk"]
# A pivot below this share of its variance counts as collinear.
COLLINEAR = 1e-12


def covariance_sums(
    rows: DataFrame, keys: list[str], target: str, predictors: list[str], carry: list[str] = ()
) -> DataFrame:
    """``n_eff``, ``means`` (predictors then target) and the flattened covariance ``cov`` per key,
    over the rows where target and predictors are all present; ``carry`` adds further aggregates."""
    names = [*predictors, target]
    complete = " AND ".join(f"{c} IS NOT NULL" for c in names)
    used = {c: f"CASE WHEN {complete} THEN CAST({c} AS DOUBLE) END" for c in names}
    masked = rows.selectExpr("*", f"{complete} AS _complete", *[f"{e} AS _u_{c}" for c, e in used.items()])

    def cell(a: str, b: str) -> str:
        a, b = sorted((a, b), key=names.index)
        return f"var_pop(_u_{a})" if a == b else f"covar_pop(_u_{a}, _u_{b})"

    aggregates = [
        "count(1) AS n_k",
        "count_if(_complete) AS n_eff",
        f"array({', '.join(f'avg(_u_{c})' for c in names)}) AS means",
        f"array({', '.join(cell(a, b) for a in names for b in names)}) AS cov",
        *carry,
    ]
    return masked.groupBy(*keys).agg(*[F.expr(a) for a in aggregates])


def _closed_form(k: int) -> str:
    """Slopes for one or two predictors, null if they are collinear."""
    if k == 1:
        return "CASE WHEN cov[0] > 0 THEN array(cov[1] / cov[0]) END"
    det = "(cov[0] * cov[4] - cov[1] * cov[1])"
    first = f"(cov[2] * cov[4] - cov[5] * cov[1]) / {det}"
    second = f"(cov[5] * cov[0] - cov[2] * cov[1]) / {det}"
    return f"CASE WHEN {det} > {COLLINEAR!r}D * cov[0] * cov[4] THEN array({first}, {second}) END"


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve_small(covs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Slopes for any number of predictors; one small dense solve per key."""
    for cov in covs:
        out = []
        for flat in cov:
            side = int(round(len(flat) ** 0.5))
            m = np.array([np.nan if x is None else x for x in flat], dtype=float).reshape(side, side)
            xx, xy = m[:-1, :-1], m[:-1, -1]
            scale = np.sqrt(np.diag(xx))
            slopes = None
            if np.all(np.isfinite(m)) and np.all(scale > 0):
                unit = xx / np.outer(scale, scale)
                if np.linalg.eigvalsh(unit)[0] > COLLINEAR:
                    slopes = np.linalg.solve(unit, xy / scale) / scale
            out.append(slopes)
        yield pd.Series(out, dtype=object)


def solve_least_squares(sums: DataFrame, k: int) -> DataFrame:
    """Add ``slopes``, ``intercept`` and ``sse`` to the output of :func:`covariance_sums`."""
    slopes = F.expr(_closed_form(k)) if k <= 2 else _solve_small.asNondeterministic()("cov")

    def inner(first: int) -> str:
        return " + ".join(f"slopes[{i}] * {'means' if first < 0 else 'cov'}[{i + max(first, 0)}]" for i in range(k))

    # the covariances of the target with the predictors are the first k cells of the last row
    last = k * (k + 1)
    return sums.withColumn("slopes", slopes).selectExpr(
        "*",
        f"means[{k}] - ({inner(-1)}) AS intercept",
        f"n_eff * (cov[{last + k}] - ({inner(last)})) AS sse",
    )


def fit_status(free: int) -> str:
    """Why a chunk has no usable model, or ``ok``."""
    return f"""CASE WHEN n_eff <= {free} THEN 'too_short' WHEN slopes IS NULL THEN 'singular'
        WHEN NOT coalesce(sse > 0, false) THEN 'degenerate' ELSE 'ok' END"""


def fit_local_ar(
    chunked: DataFrame, p: int, trend: bool = False, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """AR(p) with constant, optionally with linear trend, per chunk.

    Returns ``local_ar(series_id, chunk, start, n_k, n_eff, sigma2, coef, status)`` with
    ``coef = [c0, c1, pi_1..pi_p]`` and the trend counted from the first row of the chunk.
    ``sigma2`` is the squared-error sum over (rows in the chunk - free coefficients). ``coef`` and
    ``sigma2`` are null unless ``status`` is ``ok``.
    """
    if not 1 <= p <= MAX_LAGS:
        raise ValueError(f"p must be between 1 and {MAX_LAGS}; use the seasonal fit for longer models")
    lags = [f"l{i}" for i in range(1, p + 1)]
    predictors = (["pos"] if trend else []) + lags
    k = len(predictors)
    rows = add_lags(
        chunked.select(*CHUNK, "chunk_size", "pos", "y"), list(range(1, p + 1)), CHUNK, "pos",
        block_rows=block_rows,
    )
    sums = covariance_sums(rows, CHUNK, "y", predictors, ["max(chunk_size) AS chunk_size"])
    c1, pis = ("slopes[0]", f"slice(slopes, 2, {p})") if trend else ("0D", "slopes")
    return (
        solve_least_squares(sums, k)
        .selectExpr("*", f"{fit_status(k + 1)} AS status")
        .selectExpr(
            *CHUNK, "(chunk - 1) * chunk_size + 1 AS start", "n_k", "n_eff",
            f"CASE WHEN status = 'ok' THEN sse / (n_k - {k + 1}) END AS sigma2",
            f"CASE WHEN status = 'ok' THEN concat(array(intercept, {c1}), {pis}) END AS coef",
            "status", "means", "cov",
        )
    )


def rebase_trend(local: DataFrame) -> DataFrame:
    """Move the trend origin of each chunk to the start of the series: c0 - c1 * (start - 1)."""
    c0, c1 = F.get("coef", F.lit(0)), F.get("coef", F.lit(1))
    moved = F.array(c0 - c1 * (F.col("start") - 1))
    return local.withColumn(
        "coef", F.when(F.col("coef").isNotNull(), F.concat(moved, F.slice("coef", 2, F.size("coef") - 1)))
    )
