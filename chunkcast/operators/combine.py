"""Combining chunk estimates by inverse-variance weighting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

# The full-covariance form moves p*p cells per chunk, so it is for short forms only.
MAX_FULL = 64


def add_weights(local: DataFrame) -> DataFrame:
    """Add ``w`` = n_k / sigma2 and ``wcoef`` = w * coef."""
    return local.withColumn("w", F.col("n_k") / F.col("sigma2")).withColumn(
        "wcoef", F.transform("coef", lambda c: c * F.col("w"))
    )


def combine_terms(local: DataFrame) -> DataFrame:
    """Combined coefficients in long form: ``(series_id, pos, theta, sigma2)``, pos from 0.

    A chunk without coefficients counts in neither sum. Partial aggregation leaves one row per
    coefficient and task for the shuffle, so a series with very many chunks is no hot spot.
    """
    usable = local.filter(F.col("coef").isNotNull() & (F.col("sigma2") > 0))
    # the outer form, as the plain one has the optimizer compute the array once more in a filter
    terms = usable.select(
        "series_id", "n_k", (F.col("n_k") / F.col("sigma2")).alias("w"), F.posexplode_outer("coef").alias("pos", "c")
    )
    return terms.groupBy("series_id", "pos").agg(
        (F.sum(F.col("w") * F.col("c")) / F.sum("w")).alias("theta"),
        (F.sum("n_k") / F.sum("w")).alias("sigma2"),
        F.sum("n_k").alias("n_used"),
    )


def combine(local: DataFrame) -> DataFrame:
    """``global_model(series_id, n_used, sigma2, coef)``: one row per series."""
    return (
        combine_terms(local)
        .groupBy("series_id")
        .agg(
            F.max("n_used").alias("n_used"),
            F.max("sigma2").alias("sigma2"),
            F.transform(
                F.array_sort(F.collect_list(F.struct("pos", "theta"))), lambda t: t["theta"]
            ).alias("coef"),
        )
    )


def full_covariance_terms(local: DataFrame) -> DataFrame:
    """Sigma_k^-1 = X'X / sigma2_k of each chunk as rows ``(series_id, chunk, i, j, v, vb)``.

    Index 0 is the constant, index i the i-th lag; of a fit with trend index 1 is the position in the
    series and index i + 1 the i-th lag. ``vb`` = v * coefficient j, so the right-hand side of the
    combined system is a sum over the same rows. A fit with trend is given as it comes from the chunk,
    with its own origin; the origin is moved to the start of the series here.
    """
    side = F.size("means")  # predictors + target, the same as constant + predictors
    trend = side == F.size("coef")
    first = F.col("start") if "start" in local.columns else F.lit(1)
    shift = F.when(trend, first - 1).otherwise(F.lit(0))
    mean = lambda i: F.get("means", i - 1) + F.when(trend & (i == 1), shift).otherwise(F.lit(0))
    augmented = lambda i: F.when(i == 0, F.lit(1.0)).otherwise(mean(i))
    centred = lambda i, j: F.when((i == 0) | (j == 0), F.lit(0.0)).otherwise(
        F.get("cov", (i - 1) * side + j - 1)
    )
    constant = F.get("coef", F.lit(0)) - F.get("coef", F.lit(1)) * shift
    at = F.col("j") + F.when(trend, F.lit(0)).otherwise(F.lit(1))
    theta = F.when(F.col("j") == 0, constant).otherwise(F.get("coef", at))
    cells = (
        local.filter(F.col("status") == "ok")
        .withColumn("i", F.explode(F.sequence(F.lit(0), side - 1)))
        .withColumn("j", F.explode(F.sequence(F.lit(0), side - 1)))
    )
    i, j = F.col("i"), F.col("j")
    v = F.col("n_eff") * (centred(i, j) + augmented(i) * augmented(j)) / F.col("sigma2")
    return cells.select("series_id", "chunk", "n_k", "i", "j", v.alias("v"), (v * theta).alias("vb"))


def combine_full(local: DataFrame) -> DataFrame:
    """Full-covariance combination: ``(series_id, i, theta, sigma_row)`` with
    theta = (sum S_k)^-1 sum S_k theta_k and sigma_row the i-th row of (sum S_k)^-1 * N."""
    # one row per cell of one small matrix per series; every usable chunk counts once in each cell
    summed = full_covariance_terms(local).groupBy("series_id", "i", "j").agg(
        F.sum("v").alias("v"), F.sum("vb").alias("vb"), F.sum("n_k").alias("n_used")
    )
    systems = (
        summed.groupBy("series_id")
        .agg(
            F.max("n_used").alias("n_used"),
            F.array_sort(F.collect_list(F.struct("i", "j", "v", "vb"))).alias("cells"),
        )
        .withColumn("_p", F.sqrt(F.size("cells")).cast("int"))
        .withColumn(
            "cells",
            F.when(F.col("_p") <= MAX_FULL, F.col("cells")).otherwise(
                F.raise_error(F.lit(f"full-covariance combination takes at most {MAX_FULL} coefficients"))
            ),
        )
    )
    v, vb = (F.transform("cells", _field(name)) for name in ("v", "vb"))
    solved = systems.select("series_id", "n_used", _solve_system.asNondeterministic()(v, vb).alias("s"))
    return solved.select(
        "series_id", "n_used", F.posexplode("s").alias("i", "row")
    ).select(
        "series_id", "i", F.get("row", F.lit(0)).alias("theta"),
        F.transform(F.slice("row", 2, F.size("row") - 1), lambda x: x * F.col("n_used")).alias("sigma_row"),
    )


def _field(name: str):
    return lambda c: c[name]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _solve_system(v: pd.Series, vb: pd.Series) -> pd.Series:
    """Per series: rows [theta_i, inverse_i1, .., inverse_ip] of a p-by-p system."""
    out = []
    for cells, parts in zip(v, vb):
        p = int(round(len(cells) ** 0.5))
        b = np.asarray(parts).reshape(p, p).sum(axis=1)
        inverse = np.linalg.inv(np.asarray(cells).reshape(p, p))
        out.append([[float(t), *map(float, row)] for t, row in zip(inverse @ b, inverse)])
    return pd.Series(out)


def full_sigma2(full: DataFrame) -> DataFrame:
    """Mean of the diagonal of the combined covariance, per series."""
    return full.groupBy("series_id").agg(F.avg(F.get("sigma_row", F.col("i"))).alias("sigma2"))


def model_status(series_ids: DataFrame, local: DataFrame) -> DataFrame:
    """One row per series: chunks, failed chunks and whether a combined model exists.

    A series without a usable chunk, or without any row left after cleaning, is reported as
    ``no_model`` instead of vanishing.
    """
    chunks = local.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(F.col("coef").isNull()).alias("failed"),
    )
    return (
        series_ids.select("series_id")
        .distinct()
        .join(chunks, "series_id", "left")
        .select(
            "series_id",
            F.coalesce("chunks", F.lit(0)).alias("chunks"),
            F.coalesce("failed", F.lit(0)).alias("failed"),
            F.when(F.col("chunks") > F.col("failed"), "ok").otherwise("no_model").alias("status"),
        )
    )
