"""Rewriting seasonal ARIMA models as long autoregressions.

Input is a table of models ``(..., ar, ma, sar, sma array<double>, d, sd, m int, mean, drift)``;
every step is a projection over that table, one row per model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chunkcast.functions.arrays import add_series_ratio, difference_poly, dot, lag_poly, poly_product


def split_roles(models: DataFrame) -> DataFrame:
    """Missing mean and drift count as 0, missing coefficient lists as empty."""
    empty = F.array().cast("array<double>")
    return models.withColumns(
        {c: F.coalesce(c, F.lit(0.0)) for c in ("mean", "drift")}
        | {c: F.coalesce(c, empty) for c in ("ar", "ma", "sar", "sma")}
    )


def _seasonal(poly: Column) -> Column:
    return F.when(F.col("m") > 1, poly).otherwise(F.array(F.lit(1.0)))


def lag_polynomials(models: DataFrame) -> DataFrame:
    """Add ``ar_poly`` = AR * seasonal AR * differences and ``ma_poly`` = MA * seasonal MA."""
    one = F.lit(1)
    parts = {
        "_ar": lag_poly(F.col("ar"), one, -1.0),
        "_dif": difference_poly(one, F.col("d")),
        "_sar": _seasonal(lag_poly(F.col("sar"), F.col("m"), -1.0)),
        "_sdif": _seasonal(difference_poly(F.col("m"), F.col("sd"))),
        "_ma": lag_poly(F.col("ma"), one, 1.0),
        "_sma": _seasonal(lag_poly(F.col("sma"), F.col("m"), 1.0)),
    }
    return (
        split_roles(models)
        .withColumns(parts)
        .withColumns({"_a": poly_product(F.col("_ar"), F.col("_dif")), "_s": poly_product(F.col("_sar"), F.col("_sdif"))})
        .withColumns(
            {
                "ar_poly": poly_product(F.col("_a"), F.col("_s")),
                "ma_poly": poly_product(F.col("_ma"), F.col("_sma")),
            }
        )
        .drop(*parts, "_a", "_s")
    )


def pi_weights(models: DataFrame, tol: int) -> DataFrame:
    """Add ``pi`` = pi_1..pi_tol of y_t = c0 + c1 t + sum pi_i y_{t-i} + e_t."""
    return (
        add_series_ratio(lag_polynomials(models), "ar_poly", "ma_poly", tol, "_ratio")
        .withColumn("pi", F.transform(F.slice("_ratio", 2, tol), lambda r: F.lit(0.0) - r))
        .drop("_ratio")
    )


def intercept_and_trend(expanded: DataFrame) -> DataFrame:
    """Add ``c0`` = mean (1 - S) + drift * sum i pi_i and ``c1`` = drift (1 - S), S = sum pi_i."""
    total = F.aggregate("pi", F.lit(0.0), lambda s, x: s + x)
    weighted = dot(F.col("pi"), F.transform("pi", lambda _, i: (i + 1).cast("double")))
    return (
        expanded.withColumns({"_s": total, "_t": weighted})
        .withColumn("c0", F.col("mean") * (1 - F.col("_s")) + F.col("drift") * F.col("_t"))
        .withColumn("c1", F.col("drift") * (1 - F.col("_s")))
        .drop("_s", "_t")
    )


#: States of a fit that has estimates, though its status says that they need a look.
ESTIMATED = ("ok", "no_convergence", "near_unit_root")


def expand_models(models: DataFrame, tol: int, keep_unconverged: bool = True) -> DataFrame:
    """Models with ``coef = [c0, c1, pi_1..pi_tol]`` in place of their parts.

    A model has coefficients if its fit gave estimates; those that did not converge keep theirs, and
    their status, unless ``keep_unconverged`` is false.
    """
    expanded = intercept_and_trend(pi_weights(models, tol))
    usable = F.col("status").isin(*(ESTIMATED if keep_unconverged else ("ok",)))
    return expanded.withColumn("coef", F.when(usable, F.concat(F.array("c0", "c1"), "pi"))).drop(
        "ar_poly", "ma_poly", "pi", "c0", "c1"
    )
