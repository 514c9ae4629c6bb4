"""Automatic orders for chunks of any length, a whole series too, over one written table of blocks.

The differenced values are written once as one row a block, with the rows before it that a filter of ``tol``
weights needs. Two passes over the blocks add up the products of lagged values and of the residuals of a long
autoregression; from these sums the two-stage regressions of all candidates are solved, which ranks them.
The few best of each chunk are then fitted by Gauss-Newton steps. The state table has a row for each
chunk and candidate; a pass over the blocks advances all of them, and only the sums of a block leave a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from chunkcast.config import ForecastConfig
from chunkcast.functions.css import MIN_ROOT, CssProblem, Order
from chunkcast.operators.differences import choose_differences, difference_rows
from chunkcast.operators.history import BLOCK_ROWS, with_halo
from chunkcast.operators.local_ar import CHUNK
from chunkcast.operators.local_sarima import MODEL_COLUMNS, MODEL_SCHEMA, ORDER_COLUMNS, candidate_orders, choose_models, with_constant
from chunkcast.session import staged

GROUP = [*CHUNK, "slot"]
STATE = (
    "series_id string, chunk int, slot int, n bigint, n_k bigint, start bigint, p int, d int, q int, sp int, sd int, sq int, "
    "constant boolean, theta array<double>, base array<double>, size double, sse double, step array<double>, done boolean"
)
STATE_COLUMNS = [c.split()[0] for c in STATE.split(", ")]


def block_table(chunked: DataFrame, chosen: DataFrame, m: int, halo: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row a block of the differenced values: ``n`` of the chunk, ``first`` position of ``w``, its first ``before``
    values being those of the block before, and ``centre``, the chunk's mean."""
    rows = chunked.selectExpr(*CHUNK, "pos AS t", "y").join(chosen.selectExpr(*CHUNK, "n_k AS n", "d", "sd"), CHUNK)
    parts = None
    for kind in chosen.select("sd", "d").distinct().collect():
        own = rows.where((F.col("sd") == kind.sd) & (F.col("d") == kind.d)).select(*CHUNK, "t", "n", "y")
        part = difference_rows(own, kind.sd, kind.d, m, block_rows).select(*CHUNK, "t", "n", "y")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = rows.select(*CHUNK, "t", "n", "y")
    view = with_halo(parts, halo, "t", block_rows)
    one = F.sort_array(F.collect_list(F.struct("t", "y")))
    blocks = view.groupBy(*CHUNK, "_block").agg(
        F.max("n").alias("n"), F.min("t").alias("first"), F.count_if("_halo").alias("before"), one["y"].alias("w")
    )
    blocks = staged(blocks.where("size(w) > before"), "blocks")
    total = F.aggregate(F.expr("slice(w, CAST(before AS INT) + 1, size(w))"), F.lit(0.0), lambda a, x: a + x)
    means = blocks.groupBy(*CHUNK).agg((F.sum(total) / F.max("n")).alias("centre"))
    return blocks.join(means, CHUNK)


def _totals(made: DataFrame, keys: list[str]) -> DataFrame:
    """The sums by place of the array ``cells`` of each group."""
    cells = made.select(*keys, F.posexplode("cells")).groupBy(*keys, "pos").agg(F.sum("col").alias("col"))
    return cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "col")))["col"].alias("total"))


def _lagged(x: np.ndarray, k: int) -> np.ndarray:
    return np.r_[np.zeros(min(k, len(x))), x[: max(len(x) - k, 0)]]


def _lags(config: ForecastConfig) -> tuple[list[int], list[int]]:
    options, m = config.search, config.period
    seasonal = m > 1
    own = [*range(1, options.max_p + 1), *(j * m for j in range(1, options.max_P + 1) if seasonal)]
    errors = [*range(1, options.max_q + 1), *(j * m for j in range(1, options.max_Q + 1) if seasonal)]
    return own, errors


def _long(config: ForecastConfig) -> int:
    options, m = config.search, config.period
    seasonal = m + 2 if m > 1 and options.max_P + options.max_Q else 0
    return max(10, options.max_p + options.max_q + 2, seasonal)


def long_regressions(blocks: DataFrame, config: ForecastConfig) -> DataFrame:
    """``(series_id, chunk, long)``: Yule-Walker weights of a long autoregression of the centred values."""
    long = _long(config)

    def products(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                v, own = np.asarray(r.w) - r.centre, slice(int(r.before), None)
                out.append((r.series_id, r.chunk, [float(v[own] @ _lagged(v, k)[own]) for k in range(long + 1)]))
            yield pd.DataFrame(out, columns=[*CHUNK, "cells"])

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                k = max(1, min(long, int(r.n) // 3))
                gamma = np.asarray(r.total, dtype=float)
                table = gamma[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))]
                out.append((r.series_id, r.chunk, np.linalg.lstsq(table, gamma[1 : k + 1], rcond=1e-10)[0]))
            yield pd.DataFrame(out, columns=[*CHUNK, "long"])

    made = blocks.select(*CHUNK, "before", "w", "centre").mapInPandas(products, "series_id string, chunk int, cells array<double>")
    sums = _totals(made, CHUNK).join(blocks.select(*CHUNK, "n").distinct(), CHUNK)
    return staged(sums.mapInPandas(solve, "series_id string, chunk int, long array<double>"), "long-lags")


def rank_orders(blocks: DataFrame, chosen: DataFrame, config: ForecastConfig, best: int) -> DataFrame:
    """The state rows of the ``best`` candidates of every chunk, by the criterion of their two-stage regressions.

    All regressions of a chunk use the same rows and come from one table of products.
    """
    options, m = config.search, config.period
    own_lags, error_lags = _lags(config)
    most = max([*own_lags, *(k for k in error_lags), 0])
    candidates = candidate_orders(options, m)
    long = _long(config)

    def products(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                v = np.asarray(r.w) - r.centre
                weights = np.asarray(r.long, dtype=float)
                e = np.convolve(v, np.r_[1.0, -weights])[: len(v)]
                e[: len(weights)] = 0
                cols = [np.ones(len(v)), *(_lagged(v, k) for k in own_lags), *(_lagged(e, k) for k in error_lags), v]
                position = np.arange(len(v)) + int(r.first)
                # rows whose lags, and the long lags before them, lie inside the chunk
                used = (np.arange(len(v)) >= int(r.before)) & (position > min(most + long, int(r.n) // 2))
                x = np.array(cols)[:, used]
                out.append((r.series_id, r.chunk, (x @ x.T).ravel()))
            yield pd.DataFrame(out, columns=[*CHUNK, "cells"])

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                k = 2 + len(own_lags) + len(error_lags)
                centred = np.asarray(r.total, dtype=float).reshape(k, k)
                turn = np.eye(k)  # back from centred values to the values themselves
                turn[0, 1 : 1 + len(own_lags)] = turn[0, -1] = r.centre
                plain = turn.T @ centred @ turn
                ranked, varies = [], centred[-1, -1] > 1e-20 * max(plain[-1, -1], 1e-300)
                for p, q, sp, sq, wanted in candidates:
                    constant = with_constant(options, r.d, r.sd, wanted)
                    n, free = centred[0, 0], p + q + sp + sq + wanted
                    if constant is None or n <= free + 2 or not varies:
                        continue
                    table = centred if wanted else plain
                    at = [1 + own_lags.index(i) for i in range(1, p + 1)] + [1 + own_lags.index(j * m) for j in range(1, sp + 1)]
                    at += [1 + len(own_lags) + error_lags.index(i) for i in range(1, q + 1)]
                    at += [1 + len(own_lags) + error_lags.index(j * m) for j in range(1, sq + 1)]
                    at += [0] if wanted else []
                    guess = np.linalg.lstsq(table[np.ix_(at, at)], table[at, -1], rcond=1e-10)[0] if at else np.zeros(0)
                    sse = table[-1, -1] - guess @ table[at, -1]
                    if sse <= 1e-12 * max(table[-1, -1], 1e-300):
                        continue
                    parts = free + 1
                    aicc = n * np.log(sse / n) + 2 * parts + 2 * parts * (parts + 1) / (n - parts - 1)
                    theta = np.r_[guess[: free - wanted], [r.centre / (m if r.sd else 1)] * wanted]
                    ranked.append((aicc, free, (p, q, sp, sq, wanted), theta))
                ranked.sort(key=lambda c: c[:3])
                for slot, (_, _, (p, q, sp, sq, wanted), theta) in enumerate(ranked[:best]):
                    order = _order(p, r.d, q, sp, r.sd, sq, m, wanted)
                    theta = _shrunk(order, theta)
                    out.append((r.series_id, r.chunk, slot, r.n, r.n_k, r.start, p, r.d, q, sp, r.sd, sq, wanted, theta, theta, 1.0, None, None, False))
            yield pd.DataFrame(out, columns=STATE_COLUMNS)

    placed = blocks.select(*CHUNK, "first", "before", "n", "w", "centre").join(long_regressions(blocks, config), CHUNK)
    made = placed.mapInPandas(products, "series_id string, chunk int, cells array<double>")
    per_chunk = blocks.groupBy(*CHUNK).agg(F.max("n").alias("n"), F.max("centre").alias("centre"))
    sums = _totals(made, CHUNK).join(per_chunk, CHUNK).join(chosen, CHUNK)
    return staged(sums.mapInPandas(solve, STATE), "ranked")


def _order(p, d, q, sp, sd, sq, m, constant) -> Order:
    return Order(int(p), int(d), int(q), int(sp), int(sd), int(sq), m, bool(constant) and d + sd == 0, bool(constant) and d + sd == 1)


def _row_order(r, m: int) -> Order:
    return _order(r.p, r.d, r.q, r.sp, r.sd, r.sq, m, r.constant)


def _shrunk(order: Order, theta: np.ndarray) -> np.ndarray:
    probe = CssProblem.of_differenced(np.zeros(1), order)
    terms = order.p + order.sp + order.q + order.sq
    while not probe.stable(theta, 0.98):
        theta = np.r_[theta[:terms] * 0.9, theta[terms:]]
    return theta


def _pass(m: int):
    """Error sum and the sums of a least-squares step of every candidate, from one block."""

    def sums(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                order = _row_order(r, m)
                problem = CssProblem.of_differenced(np.asarray(r.w, dtype=float), order)
                e, jac = problem.evaluate(np.asarray(r.theta, dtype=float))
                skipped = max(int(r.before) - problem.start, 0)
                e, jac = e[skipped:], jac[:, skipped:]
                out.append((r.series_id, r.chunk, r.slot, np.r_[e @ e, (jac @ jac.T).ravel(), jac @ e]))
            yield pd.DataFrame(out, columns=[*GROUP, "cells"])

    return sums


def _advance(m: int, tolerance: float):
    """Accept or halve the last step of every candidate, then propose the next."""

    def advance(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                base, size, sse, step, done = r.base, r.size, r.sse, r.step, bool(r.done)
                theta = np.asarray(r.theta, dtype=float)
                if not done and r.total is None:
                    done = True
                elif not done:
                    k, total = len(theta), np.asarray(r.total, dtype=float)
                    new = total[0]
                    if step is None or new < sse:
                        done = step is not None and sse - new <= tolerance * sse
                        base, sse, size = theta, new, 1.0
                        jtj, slope = total[1 : 1 + k * k].reshape(k, k), total[1 + k * k :]
                        unit = np.sqrt(np.maximum(np.diag(jtj), 1e-300))
                        step = -np.linalg.lstsq(jtj / np.outer(unit, unit), slope / unit, rcond=1e-12)[0] / unit if k else np.zeros(0)
                        done = done or not k or -step @ slope <= tolerance * sse
                    else:
                        size /= 2
                        done = size < 1e-4 or new - sse <= tolerance * sse
                    base, step = np.asarray(base, dtype=float), np.asarray(step, dtype=float)
                    probe = CssProblem.of_differenced(np.zeros(1), _row_order(r, m))
                    while not done and not probe.stable(base + size * step) and size > 1e-6:
                        size /= 2
                    theta = base if done else base + size * step
                same = [getattr(r, c) for c in STATE_COLUMNS[:13]]
                out.append((*same, theta, base, size, sse, step, done))
            yield pd.DataFrame(out, columns=STATE_COLUMNS)

    return advance


def _models(state: DataFrame, m: int) -> DataFrame:
    """``models`` rows of all fitted candidates, with their criterion."""

    def describe(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                order = _row_order(r, m)
                probe = CssProblem.of_differenced(np.zeros(1), order)
                probe.n_star = int(r.n)
                row = dict.fromkeys(MODEL_COLUMNS) | {c: getattr(r, c) for c in (*CHUNK, "start", "n_k", *ORDER_COLUMNS)} | {"m": m}
                base = np.asarray(r.base, dtype=float)
                ar, sar, ma, sma, beta = probe.split(base)
                row |= {"ar": ar.tolist(), "ma": ma.tolist(), "sar": sar.tolist(), "sma": sma.tolist()}
                if len(beta):
                    row["mean" if order.d + order.sd == 0 else "drift"] = float(beta[0])
                fitted = r.sse is not None and not np.isnan(r.sse) and r.sse > 0 and r.n > probe.free
                row["status"] = "too_short" if not fitted else "ok" if r.done else "no_convergence"
                if fitted:
                    row["sigma2"] = r.sse / (r.n - probe.free)
                    row["aicc"] = float(probe.aicc(r.sse)) if probe.stable(base, 1 / MIN_ROOT) else np.inf
                out.append(row)
            frame = pd.DataFrame(out, columns=MODEL_COLUMNS)
            for c in ("mean", "drift", "sigma2", "aicc"):
                frame[c] = frame[c].astype("Float64")
            yield frame

    return state.mapInPandas(describe, MODEL_SCHEMA)


def fit_automatic(
    chunked: DataFrame, config: ForecastConfig, tol: int | None = None, best: int = 8, passes: int = 15,
    block_rows: int = BLOCK_ROWS, tolerance: float = 1e-8,
) -> DataFrame:
    """``models`` with the best order of every chunk, however long; use one chunk for a whole series.

    ``best`` candidates, by two-stage regression, are fitted to the end and compared by their criterion; a
    number no smaller than that of the candidates fits them all. ``tol`` (at most 500 unless given) is the
    length after which the weights of the autoregressive form count as zero. Fits that still move after
    ``passes`` passes are flagged. A chunk too short or without variation keeps a row with a status.
    """
    options, m = config.search, config.period
    tol = min(config.tol, 500) if tol is None else tol
    reach = tol + options.max_p + m * options.max_P
    chosen = choose_differences(chunked, m, options.max_d, options.max_D, block_rows)
    places = chunked.groupBy(*CHUNK).agg(F.min("idx").alias("start"))
    chosen = staged(chosen.join(places, CHUNK), "chosen")
    blocks = staged(block_table(chunked, chosen, m, reach, block_rows), "block-table")
    state = rank_orders(blocks, chosen, config, best)
    for _ in range(passes):
        moving = state.where("NOT done").select(*GROUP, "p", "d", "q", "sp", "sd", "sq", "constant", "theta")
        placed = blocks.select(*CHUNK, "first", "before", "w").join(moving, CHUNK)
        total = _totals(placed.mapInPandas(_pass(m), "series_id string, chunk int, slot int, cells array<double>"), GROUP)
        state = staged(state.join(total, GROUP, "left").mapInPandas(_advance(m, tolerance), STATE), "state")
        if state.where("NOT done").isEmpty():
            break
    models = choose_models(_models(state, m))
    kept = models.select(*CHUNK)
    none = [F.lit(None).cast(models.schema[c].dataType).alias(c) for c in MODEL_COLUMNS if c not in (*CHUNK, "start", "n_k", "d", "sd", "m", "status")]
    lacking = chosen.join(kept, CHUNK, "left_anti").select(*CHUNK, "start", "n_k", "d", "sd", F.lit(m).alias("m"), F.lit("no_candidate").alias("status"), *none)
    return models.unionByName(lacking.select(models.columns))
