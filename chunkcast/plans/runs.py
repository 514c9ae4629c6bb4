"""Complete forecasting runs: prepare, fit, combine, forecast, score."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from chunkcast.config import ForecastConfig
from chunkcast.functions.css import Order
from chunkcast.operators import combine as cb
from chunkcast.operators import evaluate as ev
from chunkcast.operators import forecast as fc
from chunkcast.operators import prepare as pr
from chunkcast.operators.expand import expand_models
from chunkcast.operators.local_ar import rebase_trend
from chunkcast.operators.local_sarima import fit_sarima
from chunkcast.operators.whole_sarima import fit_whole_sarima
from chunkcast.operators.whole_search import fit_automatic
from chunkcast.session import staged
from chunkcast.sources.sinks import write_bundle


def fit_chunks(train: DataFrame, config: ForecastConfig, slots: int = 1) -> DataFrame:
    """``local_ar`` of every chunk: seasonal models rewritten as autoregressions of length ``tol``."""
    chunked = pr.assign_chunks(train, config.chunks, config.max_chunk_rows)
    local = expand_models(fit_sarima(chunked, config, slots), config.tol, config.keep_unconverged)
    return rebase_trend(local) if config.rebase_trend else local


def forecast_whole_series(
    train: DataFrame, config: ForecastConfig, slots: int = 1, distributed: bool = False
) -> DataFrame:
    """Comparison run: one model per series.

    By default the same steps with one chunk per series, the candidates of a series dealt to
    ``slots`` tasks that hold the whole series; ``max_chunk_rows`` is left out of account, as cutting
    the series would be another model. ``distributed`` fits a fixed order, or the best one of the search, to all
    rows of a series of any length, block by block.
    """
    if distributed and config.order is None:
        models = fit_automatic(pr.assign_chunks(train, 1), config)
        local = expand_models(models, config.tol, config.keep_unconverged)
    elif distributed:
        (p, d, q), (sp, sd, sq) = config.order, config.seasonal
        drift = config.search.allow_drift and d + sd == 1
        order = Order(p, d, q, sp, sd, sq, config.period, config.search.allow_mean, drift)
        local = expand_models(fit_whole_sarima(train, order, config.tol), config.tol, config.keep_unconverged)
    else:
        single = ForecastConfig(**{**config.__dict__, "chunks": 1, "max_chunk_rows": None})
        local = fit_chunks(train, single, slots)
    model = staged(cb.combine(staged(local, "local")), "model")
    return fc.forecast(train, model, config.h, config.tol, config.interval_seconds, list(config.levels))


@dataclass
class Run:
    """Tables of one run, and the seconds each stage took."""

    local: DataFrame
    model: DataFrame
    coefficients: DataFrame
    forecast: DataFrame
    scores: DataFrame
    summary: DataFrame
    status: DataFrame
    fitted: DataFrame
    seconds: dict[str, float] = field(default_factory=dict)

    def write(self, folder: str) -> None:
        write_bundle(self, folder)


def run_summary(train: DataFrame, local: DataFrame, config: ForecastConfig, seconds: dict[str, float]) -> DataFrame:
    """Sizes and timings, one row per series."""
    chunked = pr.assign_chunks(train, config.chunks, config.max_chunk_rows)
    sizes = chunked.groupBy("series_id").agg(
        F.max("n").alias("sample_size"),
        F.max("chunk_size").alias("sample_size_per_chunk"),
        F.max("chunk").alias("chunks"),
    )
    failed = local.groupBy("series_id").agg(F.count_if(F.col("status") != "ok").alias("failed_chunks"))
    timed = [F.lit(float(v)).alias(f"seconds_{k}") for k, v in seconds.items()]
    return sizes.join(failed, "series_id", "left").select(
        "*", F.lit(config.tol + 2).alias("n_par"), *timed
    )


def run_status(
    series: DataFrame, train: DataFrame, local: DataFrame, forecast: DataFrame, test: DataFrame
) -> DataFrame:
    """One row for each series of the input, whatever became of it.

    ``rows`` of the input, ``dropped`` of them without a time or value, ``trained`` rows, ``chunks``
    with ``failed`` (no coefficients) and ``flagged`` ones (estimates whose status is not ok), forecast
    rows that are ``missing`` a value, and steps that only the forecast or only the hold-out has.
    ``status``: ``empty`` after cleaning, ``short`` if nothing is left to train on, ``no_model``,
    ``no_forecast``, else ``ok``.
    """
    usable = F.col("ts").isNotNull() & F.col("y").isNotNull() & ~F.isnan(F.coalesce("y", F.lit(0.0)))
    out = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~usable).alias("dropped"))
    flagged = F.count_if(F.col("coef").isNotNull() & (F.col("status") != "ok"))
    parts = [
        train.groupBy("series_id").agg(F.count(F.lit(1)).alias("trained")),
        local.groupBy("series_id").agg(
            F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("coef").isNull()).alias("failed"), flagged.alias("flagged")
        ),
        fc.missing_forecasts(forecast),
        ev.unmatched_steps(forecast, test),
    ]
    for part in parts:
        out = out.join(part, "series_id", "left")
    counts = [c for c in out.columns if c != "series_id"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    status = (
        F.when(F.col("rows") == F.col("dropped"), "empty")
        .when(F.col("trained") == 0, "short")
        .when(F.col("chunks") == F.col("failed"), "no_model")
        .when(F.col("missing") > 0, "no_forecast")
        .otherwise("ok")
    )
    return out.withColumn("status", status)


def run_forecast(
    series: DataFrame, config: ForecastConfig, holdout: DataFrame | None = None, slots: int = 1
) -> Run:
    """Forecast every series and score the forecast.

    Without ``holdout`` the last ``h`` rows of each series are held out. The indexed training rows,
    the chunk models and the forecast are written once to the shared folder: each is read by
    several later steps, and a lost executor then costs a re-read instead of a re-fit.
    """
    seconds, clock = {}, time.perf_counter()

    def lap(stage: str) -> None:
        nonlocal clock
        now = time.perf_counter()
        seconds[stage], clock = now - clock, now

    indexed = pr.index_series(pr.clean(series), config.interval_seconds)
    if holdout is None:
        split = staged(pr.split_holdout(indexed, config.h), "split")
        train, test = pr.train_rows(split), pr.test_rows(split)
    else:
        train = staged(indexed, "train")
        test = pr.index_holdout(holdout, config.interval_seconds)
    lap("prepare")
    local = staged(fit_chunks(train, config, slots), "local")
    model = staged(cb.combine(local), "model")
    lap("fit")
    forecast = staged(
        fc.forecast(train, model, config.h, config.tol, config.interval_seconds, list(config.levels)), "forecast"
    )
    lap("forecast")
    scores = staged(ev.score_steps(forecast, test, ev.seasonal_scale(train, config.period)), "scores")
    status = staged(run_status(series, train, local, forecast, test), "status")
    fitted = fc.fitted_values(train, model, config.tol)
    lap("evaluate")
    coefficients = model.select("series_id", "sigma2", F.posexplode("coef").alias("pos", "theta"))
    summary = run_summary(train, local, config, seconds)
    return Run(local, model, coefficients, forecast, scores, summary, status, fitted, seconds)
