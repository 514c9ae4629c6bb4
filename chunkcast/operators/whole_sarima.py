"""Seasonal ARIMA fit of whole series, however long: Gauss-Newton steps over distributed sums.

The residuals are the differenced series filtered by the long autoregressive form of the model,
e_t = sum_{j<=tol} r_j v_{t-j}, so a block of rows needs only the ``tol`` rows before it. Each pass
over the data turns every block into the few sums of a linear least-squares step; Spark adds them up
per series, and the step is taken on that one small row per series. All series advance together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from chunkcast.functions.css import CssProblem, Order, fit_css
from chunkcast.operators.history import BLOCK_ROWS, with_halo
from chunkcast.session import staged

SUMS = "series_id string, sse double, n_used bigint, jtj array<double>, jte array<double>"
STATE = "series_id string, theta array<double>, base array<double>, size double, sse double, step array<double>, done boolean"


def differenced(train: DataFrame, order: Order, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(series_id, idx, n, w)`` with ``w`` the differenced value; null for the first d + m*sd rows."""
    poly = np.ones(1)
    for stride, times in ((1, order.d), (order.m, order.sd)):
        for _ in range(times):
            poly = np.convolve(poly, np.r_[1.0, np.zeros(stride - 1), -1.0])
    lost = len(poly) - 1
    if lost == 0:
        return train.select("series_id", "idx", "n", F.col("y").alias("w"))
    terms = [f"{c}D * lag(y, {i}) OVER s" for i, c in enumerate(poly) if c and i]
    view = with_halo(train.select("series_id", "idx", "n", "y"), lost, "idx", block_rows)
    window = "(PARTITION BY series_id, _block ORDER BY idx)"
    value = " + ".join(["y", *terms]).replace("OVER s", f"OVER {window}")
    return view.selectExpr("*", f"{value} AS w").filter("NOT _halo").select("series_id", "idx", "n", "w")


def _block_sums(order: Order):
    lost = order.d + order.m * order.sd
    # rows before the first residual: differences, then the autoregressive conditioning
    first = lost + order.p + order.m * order.sp + 1

    def sums(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if not len(state) or not len(rows) or bool(state["done"].iloc[0]):
            return pd.DataFrame(columns=["series_id", "sse", "n_used", "jtj", "jte"])
        rows = rows[rows["idx"] > lost].sort_values("idx")
        theta = np.asarray(state["theta"].iloc[0], dtype=float)
        problem = CssProblem.of_differenced(rows["w"].to_numpy(dtype=float), order)
        e, jac = problem.evaluate(theta)
        idx = rows["idx"].to_numpy()[problem.start :]
        own = ~rows["_halo"].to_numpy()[problem.start :] & (idx >= first)
        e, jac = e[own], jac[:, own]
        return pd.DataFrame({
            "series_id": [state["series_id"].iloc[0]],
            "sse": [float(e @ e)], "n_used": [int(own.sum())],
            "jtj": [(jac @ jac.T).ravel()], "jte": [jac @ e],
        })

    return sums


def _add_up(size: int) -> list:
    cells = lambda c, n: F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(n)]).alias(c)
    return [F.sum("sse").alias("new_sse"), F.sum("n_used").alias("n_used"), cells("jtj", size * size), cells("jte", size)]


def _advance(order: Order, tolerance: float):
    """One row per series: accept or halve the last step, then propose the next."""

    def advance(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                base, size, sse, step, done = r.base, r.size, r.sse, r.step, bool(r.done)
                theta = None if r.theta is None else np.asarray(r.theta, dtype=float)
                if not done and (r.new_sse is None or np.isnan(r.new_sse)):
                    done = True
                elif not done:
                    if step is None or r.new_sse < sse:
                        done = step is not None and sse - r.new_sse <= tolerance * sse
                        jtj = np.asarray(r.jtj, dtype=float).reshape(len(theta), -1)
                        unit = np.sqrt(np.maximum(np.diag(jtj), 1e-300))
                        scaled = jtj / np.outer(unit, unit)
                        slope = np.asarray(r.jte, dtype=float)
                        step = -np.linalg.lstsq(scaled, slope / unit, rcond=1e-12)[0] / unit
                        base, sse, size = theta, r.new_sse, 1.0
                        # nothing left that another step could gain
                        done = done or -step @ slope <= tolerance * sse
                    else:
                        size /= 2
                        done = size < 1e-4 or r.new_sse - sse <= tolerance * sse
                    step, base = np.asarray(step, dtype=float), np.asarray(base, dtype=float)
                    probe = CssProblem.of_differenced(np.zeros(1), order)
                    while not done and not probe.stable(base + size * step) and size > 1e-6:
                        size /= 2
                    theta = base if done else base + size * step
                out.append((r.series_id, theta, base, size, sse, step, done))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in STATE.split(", ")])

    return advance


def _lag_products(long: int):
    """The number of own rows and the products with each of the ``long`` rows before, of a block's centred values."""

    def products(rows: np.ndarray, own: np.ndarray, row, order: Order) -> np.ndarray:
        return np.array([own.sum(), *(rows[i:] * own[i:] @ rows[: len(rows) - i] for i in range(long + 1) if i < len(rows))])

    return products


def _two_stage(long: int):
    """Normal equations of the regression on own lags and on lags of a long autoregression's residuals."""

    def products(v: np.ndarray, own: np.ndarray, row, order: Order) -> np.ndarray:
        e = np.convolve(v, np.r_[1.0, -np.asarray(row["long"], dtype=float)])[: len(v)]
        e[:long] = 0
        lags = [(v, i) for i in range(1, order.p + 1)] + [(v, j * order.m) for j in range(1, order.sp + 1)]
        lags += [(e, i) for i in range(1, order.q + 1)] + [(e, j * order.m) for j in range(1, order.sq + 1)]
        cols = np.array([np.r_[np.zeros(min(i, len(x))), x[: max(len(x) - i, 0)]] for x, i in lags] + [v])[:, own]
        return (cols @ cols.T).ravel()

    return products


def _block_totals(blocks: DataFrame, asked: DataFrame, order: Order, size: int, products) -> DataFrame:
    """``series_id, total``: the sums over all blocks of what ``products`` gives for one."""
    lost = order.d + order.m * order.sd

    def sums(rows: pd.DataFrame, series: pd.DataFrame) -> pd.DataFrame:
        if not len(series) or not len(rows):
            return pd.DataFrame(columns=["series_id", "cells"])
        rows = rows[rows["idx"] > lost].sort_values("idx")
        v = rows["w"].to_numpy(dtype=float) - series["centre"].iloc[0]
        cells = products(v, ~rows["_halo"].to_numpy(dtype=bool), series.iloc[0], order)
        return pd.DataFrame({"series_id": [series["series_id"].iloc[0]], "cells": [cells]})

    placed = asked.selectExpr("*", f"explode(sequence(0, (n - 1) DIV {size})) AS _block")
    made = blocks.groupBy("series_id", "_block").cogroup(placed.groupBy("series_id", "_block"))
    cells = made.applyInPandas(sums, "series_id string, cells array<double>").select("series_id", F.posexplode("cells"))
    added = cells.groupBy("series_id", "pos").agg(F.sum("col").alias("col")).groupBy("series_id")
    return added.agg(F.array_sort(F.collect_list(F.struct("pos", "col")))["col"].alias("total"))


def _seeds(blocks: DataFrame, w: DataFrame, lacking: DataFrame, order: Order, size: int, reach: int) -> DataFrame:
    """``series_id, theta`` from all rows: Yule-Walker for a long autoregression, then the two-stage regression."""
    far = max(order.q, order.m * order.sq)
    long = max(1, min(max(10, order.p + order.q + 2, order.m + 2 if order.sp + order.sq else 0), reach - far))
    held = F.avg("w") if order.constants() else F.lit(0.0)
    range_of = w.where("w IS NOT NULL").groupBy("series_id").agg(held.alias("centre"), (F.max("w") > F.min("w")).alias("lively"))
    asked = lacking.join(range_of.where("lively"), "series_id").select("series_id", "n", "centre")

    def yule_walker(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                gamma = np.zeros(long + 1)
                gamma[: len(r.total) - 1] = r.total[1:]
                table = gamma[np.abs(np.subtract.outer(np.arange(long), np.arange(long)))]
                out.append((r.series_id, r.n, r.centre, np.linalg.lstsq(table, gamma[1:], rcond=1e-10)[0]))
            yield pd.DataFrame(out, columns=["series_id", "n", "centre", "long"])

    first = asked.join(_block_totals(blocks, asked, order, size, _lag_products(long)), "series_id")
    asked = staged(first.mapInPandas(yule_walker, "series_id string, n bigint, centre double, long array<double>"), "long-lags")

    def regress(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                k = order.p + order.sp + order.q + order.sq
                table = np.asarray(r.total, dtype=float).reshape(k + 1, k + 1)
                theta = np.r_[np.linalg.lstsq(table[:k, :k], table[:k, k], rcond=1e-10)[0], [r.centre / (order.m if order.sd else 1)] * order.constants()]
                probe = CssProblem.of_differenced(np.zeros(1), order)
                while not probe.stable(theta, 0.98):
                    theta[:k] *= 0.9
                out.append((r.series_id, theta))
            yield pd.DataFrame(out, columns=["series_id", "theta"])

    second = asked.join(_block_totals(blocks, asked, order, size, _two_stage(long)), "series_id")
    return second.mapInPandas(regress, "series_id string, theta array<double>")


def fit_whole_sarima(
    train: DataFrame, order: Order, tol: int = 500, start_rows: int = 2_000, passes: int = 12,
    block_rows: int = BLOCK_ROWS, tolerance: float = 1e-8,
) -> DataFrame:
    """``models`` with one row per series: a fixed order fitted to all of its rows.

    Starts from the fit of the first ``start_rows`` rows, or where they give none, from a two-stage
    regression over all rows, and makes at most ``passes`` passes over the
    data, fewer if every series has converged. ``tol`` is the length after which the weights of the
    autoregressive form count as zero. The state between passes is a written table.
    """
    if order.drift and order.d + order.sd == 0:
        raise ValueError("a trend without differencing needs the positions; difference once instead")
    free = order.p + order.sp + order.q + order.sq + order.constants()
    reach = tol + order.p + order.m * order.sp
    w = staged(differenced(train, order, block_rows), "differenced")
    blocks = with_halo(w, reach, "idx", block_rows)
    keys = w.groupBy("series_id").agg(F.max("n").alias("n"))

    def first_fit(pdf: pd.DataFrame) -> pd.DataFrame:
        fit = fit_css(pdf.sort_values("idx")["y"].to_numpy(dtype=float), order)
        theta = None
        if "ar" in fit:
            constant = [x for x in (fit["mean"], fit["drift"]) if x is not None]
            theta = [*fit["ar"], *fit["sar"], *fit["ma"], *fit["sma"], *constant]
        return pd.DataFrame([(pdf["series_id"].iloc[0], theta, theta, 1.0, None, None, theta is None)],
                            columns=[c.split()[0] for c in STATE.split(", ")])

    head = train.filter(F.col("idx") <= start_rows).select("series_id", "idx", "y")
    state = staged(head.groupBy("series_id").applyInPandas(first_fit, STATE), "state")
    size = max(block_rows, 4 * reach)
    lacking = state.where("theta IS NULL").join(keys.where(F.col("n") > start_rows), "series_id").select("series_id", "n")
    if not lacking.isEmpty():
        seeds = _seeds(blocks, w, lacking, order, size, reach).withColumnRenamed("theta", "seed")
        both = state.join(seeds, "series_id", "left")
        state = staged(
            both.selectExpr(
                "series_id", "coalesce(theta, seed) AS theta", "coalesce(base, seed) AS base", "size", "sse", "step", "done AND seed IS NULL AS done"
            ),
            "state",
        )
    for _ in range(passes):
        placed = state.join(keys, "series_id").selectExpr(
            "series_id", "theta", "done", f"explode(sequence(0, (n - 1) DIV {size})) AS _block"
        )
        sums = (
            blocks.groupBy("series_id", "_block")
            .cogroup(placed.groupBy("series_id", "_block"))
            .applyInPandas(_block_sums(order), SUMS)
            .groupBy("series_id")
            .agg(*_add_up(free))
        )
        joined = state.join(sums, "series_id", "left")
        state = staged(joined.mapInPandas(_advance(order, tolerance), STATE), "state")
        if state.filter("NOT done").isEmpty():
            break
    return _as_models(state.join(keys, "series_id"), order, free)


def _as_models(state: DataFrame, order: Order, free: int) -> DataFrame:
    lost = order.d + order.m * order.sd
    at, parts = 1, {}
    for name, count in (("ar", order.p), ("sar", order.sp), ("ma", order.q), ("sma", order.sq)):
        parts[name] = f"slice(base, {at}, {count})" if count else "CAST(array() AS array<double>)"
        at += count
    constant = f"base[{at - 1}]" if free >= at else "CAST(NULL AS DOUBLE)"
    has_mean = order.d + order.sd == 0
    return state.selectExpr(
        "series_id", "1 AS chunk", "1L AS start", "n AS n_k",
        *[f"{getattr(order, c)} AS {c}" for c in ("p", "d", "q", "sp", "sd", "sq", "m")],
        *[f"{e} AS {c}" for c, e in parts.items()],
        f"{constant if has_mean else 'CAST(NULL AS DOUBLE)'} AS mean",
        f"{'CAST(NULL AS DOUBLE)' if has_mean else constant} AS drift",
        f"sse / (n - {lost + free}) AS sigma2",
        "CASE WHEN sse IS NULL THEN 'too_short' WHEN done THEN 'ok' ELSE 'no_convergence' END AS status",
    )
