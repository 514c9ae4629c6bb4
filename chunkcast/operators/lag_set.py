"""Autoregressions on a chosen set of lags, such as 1, 24 and 25, of any number, with missing values left out.

A chunk is taken block by block. A block's rows become one array, numpy multiplies the lagged values of the block, and
only the product sums leave the task, as one array for each chunk and batch. A chunk of any length is spread
over tasks, and the number of sums is that of pairs of lags, whatever the longest lag.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from chunkcast.operators.history import BLOCK_ROWS, with_halo
from chunkcast.operators.local_ar import CHUNK, COLLINEAR

SUMS = "series_id string, chunk int, cells array<double>"
MODEL = (
    "series_id string, chunk int, start bigint, n_k bigint, n_eff bigint, sigma2 double, coef array<double>, status string"
)
MODEL_COLUMNS = [c.split()[0] for c in MODEL.split(", ")]


def lag_products(chunked: DataFrame, lags: list[int], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(series_id, chunk, total)``: the upper triangle of the product sums of (1, lagged values, value), centred
    by the chunk's mean, over the rows that have all of them. A chunk without such rows has zeros."""
    reach = max(lags)
    view = with_halo(chunked.selectExpr(*CHUNK, "CAST(pos AS BIGINT) AS pos", "CAST(y AS DOUBLE) AS y"), reach, "pos", block_rows)
    rows = F.sort_array(F.collect_list(F.struct("pos", F.coalesce("y", F.lit(float("nan"))).alias("y"))))
    blocks = view.groupBy(*CHUNK, "_block").agg(rows.alias("rows"), F.count_if("_halo").alias("before"))
    blocks = blocks.select(*CHUNK, "before", F.col("rows")["pos"].alias("pos"), F.col("rows")["y"].alias("y"))
    centres = chunked.groupBy(*CHUNK).agg(F.avg(F.nanvl(F.col("y").cast("double"), F.lit(None))).alias("centre"))
    upper = np.triu_indices(len(lags) + 2)

    def products(batches):
        for pdf in batches:
            sums: dict[tuple, np.ndarray] = {}
            for r in pdf.itertuples():
                pos = np.asarray(r.pos, dtype=np.int64)
                value = np.full(int(pos[-1] - pos[0]) + 1, np.nan)  # rows that a chunk lacks have no value
                value[pos - pos[0]] = np.asarray(r.y, dtype=float) - (0.0 if pd.isna(r.centre) else r.centre)
                own = np.zeros(len(value), bool)
                own[pos[int(r.before) :] - pos[0]] = True
                shifted = [np.r_[np.full(min(k, len(value)), np.nan), value[: max(len(value) - k, 0)]] for k in lags]
                table = np.array([np.ones(len(value)), *shifted, value])
                table = table[:, own & np.isfinite(table).all(axis=0)]
                key = (r.series_id, r.chunk)
                sums[key] = sums.get(key, 0.0) + (table @ table.T)[upper]
            yield pd.DataFrame([(*key, cells) for key, cells in sums.items()], columns=[*CHUNK, "cells"])

    made = blocks.join(centres, CHUNK).mapInPandas(products, SUMS)
    cells = made.select(*CHUNK, F.posexplode("cells")).groupBy(*CHUNK, "pos").agg(F.sum("col").alias("col"))
    return cells.groupBy(*CHUNK).agg(F.array_sort(F.collect_list(F.struct("pos", "col")))["col"].alias("total"))


def fit_lag_set(chunked: DataFrame, lags: list[int], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Least squares of ``y`` on a constant and the given lags, per chunk of ``series_id, chunk, chunk_size, pos, y``.

    Returns the columns of ``fit_local_ar`` up to ``status``: ``coef = [c0, 0, pi_1..pi_max(lags)]`` has zeros at the
    other lags, so the models combine and forecast like any autoregression. Null and NaN values are missing: ``n_k``
    counts the values there are, ``n_eff`` the rows whose value and lags are all there, and ``sigma2`` is the
    squared-error sum over ``n_k`` less the free coefficients. Series of different lags do not mix; an empty table has
    no models.
    """
    lags = sorted(set(lags))
    if not lags or lags[0] < 1:
        raise ValueError("lags must be positive")
    k = len(lags)
    upper = np.triu_indices(k + 2)

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                table = np.zeros((k + 2, k + 2))
                table[upper] = np.asarray(r.total, dtype=float)
                n, means = table[0, 0], table[0, 1:] / max(table[0, 0], 1.0)
                cov = np.triu(table[1:, 1:])
                cov = cov + np.triu(cov, 1).T - n * np.outer(means, means)
                xx, xy = cov[:-1, :-1], cov[:-1, -1]
                scale = np.sqrt(np.maximum(np.diag(xx), 0))
                coef = sigma2 = None
                if n <= k + 1 or r.n_k <= k + 1:
                    status = "too_short"
                elif not (scale > 0).all() or np.linalg.eigvalsh(xx / np.outer(scale, scale))[0] <= COLLINEAR:
                    status = "singular"
                else:
                    slopes = np.linalg.solve(xx / np.outer(scale, scale), xy / scale) / scale
                    sse = cov[-1, -1] - slopes @ xy
                    status = "ok" if sse > 0 else "degenerate"
                    if sse > 0:
                        weights = np.zeros(lags[-1])
                        weights[np.array(lags) - 1] = slopes
                        intercept = means[-1] - slopes @ means[:-1] + r.centre * (1 - slopes.sum())
                        coef, sigma2 = [intercept, 0.0, *weights], sse / (r.n_k - k - 1)
                out.append((r.series_id, r.chunk, r.start, r.n_k, int(n), sigma2, coef, status))
            frame = pd.DataFrame(out, columns=MODEL_COLUMNS)
            frame["sigma2"] = frame["sigma2"].astype("Float64")
            yield frame

    value = F.nanvl(F.col("y").cast("double"), F.lit(None))
    facts = chunked.groupBy(*CHUNK).agg(
        (F.max((F.col("chunk") - 1) * F.col("chunk_size")) + 1).alias("start"),
        F.count(value).alias("n_k"), F.avg(value).alias("centre"),
    )
    return lag_products(chunked, lags, block_rows).join(facts, CHUNK).mapInPandas(solve, MODEL)
