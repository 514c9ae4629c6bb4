"""Per-chunk seasonal ARIMA models: fixed orders, exhaustive or approximate order search."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from chunkcast.config import ForecastConfig, SearchOptions
from chunkcast.functions.css import Order, approximate_aicc, difference_orders, fit_css
from chunkcast.operators.differences import choose_differences
from chunkcast.operators.local_ar import CHUNK, fit_local_ar

MODEL_SCHEMA = (
    "series_id string, chunk int, start bigint, n_k bigint, p int, d int, q int, sp int, sd int, sq int, m int, "
    "ar array<double>, ma array<double>, sar array<double>, sma array<double>, mean double, drift double, "
    "sigma2 double, aicc double, status string"
)
MODEL_COLUMNS = [part.split()[0] for part in MODEL_SCHEMA.split(", ")]
ORDER_COLUMNS = ["p", "d", "q", "sp", "sd", "sq"]


def candidate_orders(options: SearchOptions, period: int) -> list[tuple[int, int, int, int, bool]]:
    """All (p, q, sp, sq, constant) within the limits; seasonal parts only for a period above 1."""
    ps, qs = range(options.max_p + 1), range(options.max_q + 1)
    sps = range(options.max_P + 1) if period > 1 else [0]
    sqs = range(options.max_Q + 1) if period > 1 else [0]
    constants = [False, True] if options.allow_mean or options.allow_drift else [False]
    return [
        (p, q, sp, sq, c)
        for p, q, sp, sq in product(ps, qs, sps, sqs)
        if p + q + sp + sq <= options.max_order
        for c in constants
    ]


def with_constant(options: SearchOptions, d: int, sd: int, wanted: bool) -> tuple[bool, bool] | None:
    """(mean, drift) of a candidate, or None if differencing leaves no such constant."""
    if not wanted:
        return False, False
    if d + sd == 0 and options.allow_mean:
        return True, False
    if d + sd == 1 and options.allow_drift:
        return False, True
    return None


def _row(pdf: pd.DataFrame, order: Order | None, fit: dict) -> dict:
    first = pdf.iloc[0]
    row = dict.fromkeys(MODEL_COLUMNS)
    row |= {"series_id": first["series_id"], "chunk": first["chunk"], "n_k": len(pdf)}
    row["start"] = (int(first["chunk"]) - 1) * int(first["chunk_size"]) + 1
    if order is not None:
        row |= {c: getattr(order, c) for c in [*ORDER_COLUMNS, "m"]}
    return row | {k: v for k, v in fit.items() if k in row}


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=MODEL_COLUMNS)
    for c in ("mean", "drift", "sigma2", "aicc"):
        out[c] = out[c].astype("Float64")
    for c in (*ORDER_COLUMNS, "m"):
        out[c] = out[c].astype("Int32")
    return out


def _values(pdf: pd.DataFrame) -> np.ndarray:
    return pdf.sort_values("idx")["y"].to_numpy(dtype=float)


def _spread(chunked: DataFrame, *keys: str) -> DataFrame:
    """The rows a fit needs, hash-partitioned by chunk into a fixed number of tasks.

    A fit is bound by processor time, not bytes. An explicit number keeps adaptive execution from
    merging many small chunks into one task, and the grouping that follows needs no further shuffle.
    """
    context = chunked.sparkSession.sparkContext
    tasks = max(4 * context.defaultParallelism, int(chunked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return chunked.select(*CHUNK, "chunk_size", "idx", "y", *keys).repartition(tasks, *CHUNK, *keys)


def fit_fixed(chunked: DataFrame, config: ForecastConfig) -> DataFrame:
    """One model of the configured order per chunk; a chunk that cannot be fitted keeps a row with
    its status."""
    (p, d, q), (sp, sd, sq) = config.order, config.seasonal
    order = Order(p, d, q, sp, sd, sq, config.period, config.search.allow_mean, config.search.allow_drift)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return _frame([_row(pdf, order, fit_css(_values(pdf), order))])

    return _spread(chunked).groupBy(*CHUNK).applyInPandas(fit, MODEL_SCHEMA)


def fit_candidates(chunked: DataFrame, config: ForecastConfig, slots: int = 1) -> DataFrame:
    """All candidate models of each chunk.

    ``slots`` deals the candidates of one chunk to that many tasks, each with a copy of the chunk;
    use it when there are fewer chunks than cores. It has no influence on the result: an approximate
    search, which ranks all candidates of a chunk before it fits the best, takes one task per chunk.
    """
    options, m = config.search, config.period
    candidates = candidate_orders(options, m)
    slots = 1 if options.approximation else slots

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = _values(pdf)
        d, sd = difference_orders(y, m, options.max_d, options.max_D)
        mine = candidates[int(pdf["slot"].iloc[0]) :: slots]
        orders = []
        for p, q, sp, sq, wanted in mine:
            constant = with_constant(options, d, sd, wanted)
            if constant is not None:
                orders.append(Order(p, d, q, sp, sd, sq, m, *constant))
        if options.approximation and orders:
            orders = [min(orders, key=lambda o: approximate_aicc(y, o))]
        return _frame([_row(pdf, o, fit_css(y, o)) for o in orders])

    dealt = chunked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    return _spread(dealt, "slot").groupBy(*CHUNK, "slot").applyInPandas(fit, MODEL_SCHEMA)


def choose_models(candidates: DataFrame) -> DataFrame:
    """The candidate with the lowest criterion per chunk; ties go to the smaller order.

    A chunk without a usable candidate keeps one row with a status that says so.
    """
    infinite = F.lit(math.inf)
    usable = (F.col("status") == "ok") & (F.col("aicc") < infinite)
    rank = F.struct(
        (~usable).alias("unusable"),
        F.coalesce("aicc", infinite).alias("aicc"),
        (F.col("p") + F.col("q") + F.col("sp") + F.col("sq")).alias("terms"),
        *[F.col(c) for c in ORDER_COLUMNS],
        F.col("mean").isNotNull().alias("has_mean"),
        F.col("drift").isNotNull().alias("has_drift"),
    )
    model = F.struct(*[F.col(c) for c in MODEL_COLUMNS])
    best = candidates.groupBy(*CHUNK).agg(F.min_by(model, rank).alias("model")).select("model.*")
    accepted = (F.col("status") != "ok") | (F.col("aicc") < infinite)
    return best.withColumn("status", F.when(accepted, F.col("status")).otherwise("near_unit_root"))


def fit_sarima(chunked: DataFrame, config: ForecastConfig, slots: int = 1) -> DataFrame:
    """``models``: fixed order if the configuration names one, else the best candidate per chunk."""
    if config.order is not None:
        return fit_fixed(chunked, config)
    return choose_models(fit_candidates(chunked, config, slots))


def diff_orders(chunked: DataFrame, config: ForecastConfig) -> DataFrame:
    """``(series_id, chunk, d, sd)``: differences that the automatic choice takes per chunk, from block sums."""
    options = config.search
    return choose_differences(chunked, config.period, options.max_d, options.max_D).select(*CHUNK, "d", "sd")


def search_ar(chunked: DataFrame, max_p: int) -> DataFrame:
    """Best pure autoregression of order 1..max_p per chunk, from covariance sums alone."""
    fits = None
    for p in range(1, max_p + 1):
        local = fit_local_ar(chunked, p).filter(F.col("status") == "ok")
        free = p + 2
        sse = F.col("sigma2") * (F.col("n_k") - (p + 1))
        aic = F.col("n_k") * F.log(sse / F.col("n_eff")) + 2 * free
        rows = local.select(
            *CHUNK, "start", "n_k", "n_eff", "sigma2", "coef", "status", F.lit(p).alias("p"),
            (aic + 2 * free * (free + 1) / (F.col("n_k") - free - 1)).alias("aicc"),
        ).filter(F.col("n_k") > free + 1)
        fits = rows if fits is None else fits.unionByName(rows)
    columns = [c for c in fits.columns if c not in CHUNK]
    best = F.min_by(F.struct(*columns), F.struct("aicc", "p")).alias("model")
    return fits.groupBy(*CHUNK).agg(best).select(*CHUNK, "model.*")
