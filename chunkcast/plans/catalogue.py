"""Named queries over the given tables; each takes ``(spark, sf_dir)`` and returns a DataFrame.

Series: hourly event values per type (period 24), daily order totals, also per priority (period 7),
daily shipments (period 7) and daily orders per customer. Computed doubles are rounded so that two
engines can be compared by value.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from chunkcast.config import ForecastConfig, SearchOptions
from chunkcast.functions.boxcox import inv_box_cox
from chunkcast.functions.css import CssProblem, Order
from chunkcast.operators import combine as cb
from chunkcast.operators import evaluate as ev
from chunkcast.operators import expand as ex
from chunkcast.operators import forecast as fc
from chunkcast.operators import prepare as pr
from chunkcast.operators.history import add_lags
from chunkcast.operators.lag_set import fit_lag_set
from chunkcast.operators.local_ar import fit_local_ar, rebase_trend
from chunkcast.operators.local_sarima import diff_orders as choose_differences
from chunkcast.operators.local_sarima import fit_sarima, search_ar
from chunkcast.operators.whole_sarima import fit_whole_sarima
from chunkcast.operators.whole_search import fit_automatic
from chunkcast.plans import runs
from chunkcast.session import shared_dir, staged
from chunkcast.sources import series as src, sinks

HOUR, DAY = 3600, 86400
CHUNKS = 4
HORIZON = 24
# Lengths beyond the limits at which the expressions give way to Arrow functions.
TOL_LONG, STEPS_LONG, LAGS_LONG = 250, 10_001, 26
# Steps held out of customers' series, which are mostly short.
STATUS_STEPS = 3
# Lags of the seasonal autoregression (1 - a B)(1 - s B^24), freely estimated.
SEASON_LAGS = (1, 24, 25)
# AR, MA and seasonal MA parameters at which the loss is compared.
CSS_POINT = (0.3, 0.4, 0.25)


# ---- shared pieces --------------------------------------------------------------------------


def text_ts(df: DataFrame, column: str = "ts") -> DataFrame:
    return df.withColumn(column, F.date_format(column, "yyyy-MM-dd HH:mm:ss"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def millions(series: DataFrame) -> DataFrame:
    return series.withColumn("y", F.col("y") / 1e6)


def events_indexed(spark: SparkSession, d: str, by_type: bool = True) -> DataFrame:
    return pr.index_series(pr.clean(src.hourly_events(spark, d, by_type)), HOUR)


def events_split(spark: SparkSession, d: str, by_type: bool = True) -> DataFrame:
    return pr.split_holdout(events_indexed(spark, d, by_type), HORIZON)


def events_staged(spark: SparkSession, d: str, by_type: bool = True) -> DataFrame:
    """The split series as a written table, for queries that read it in several places."""
    return staged(events_split(spark, d, by_type), "events")


def events_chunked(
    spark: SparkSession, d: str, chunks: int = CHUNKS, max_chunk_rows: int | None = None
) -> DataFrame:
    return pr.assign_chunks(events_indexed(spark, d), chunks, max_chunk_rows)


def events_for_fit(spark: SparkSession, d: str) -> DataFrame:
    """Chunks for the fits that hold a chunk in one task, with its length bounded."""
    return events_chunked(spark, d, max_chunk_rows=ForecastConfig.max_chunk_rows)


def orders_indexed(spark: SparkSession, d: str, by_priority: bool = False) -> DataFrame:
    return pr.index_series(pr.clean(millions(src.daily_orders(spark, d, by_priority))), DAY)


def shipments_indexed(spark: SparkSession, d: str) -> DataFrame:
    return pr.index_series(pr.clean(millions(src.daily_shipments(spark, d))), DAY)


def customers_indexed(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    daily = src.series_from_rows(orders, "o_orderdate", "o_totalprice", DAY, "o_custkey", src.MONEY_DIGITS)
    return pr.index_series(pr.clean(millions(daily)), DAY)


def trained_model(train: DataFrame, p: int = 2) -> DataFrame:
    return cb.combine(fit_local_ar(pr.assign_chunks(train, CHUNKS), p))


# ---- sources and preparation ----------------------------------------------------------------


def hourly_series(spark, d):
    return text_ts(pr.clean(src.hourly_events(spark, d)))


def hourly_total(spark, d):
    return text_ts(pr.clean(src.hourly_events(spark, d, by_type=False)))


def daily_orders_series(spark, d):
    return text_ts(src.daily_orders(spark, d, by_priority=True))


def daily_shipments_series(spark, d):
    return text_ts(src.daily_shipments(spark, d))


def series_sizes(spark, d):
    return pr.series_sizes(src.daily_orders(spark, d, by_priority=True))


def row_index(spark, d):
    return text_ts(shipments_indexed(spark, d).select("series_id", "ts", "idx", "n"))


def row_index_ranged(spark, d):
    ranged = pr.index_series_by_range(pr.clean(src.daily_orders(spark, d, by_priority=True)))
    return text_ts(ranged.select("series_id", "ts", "idx", "n"))


def gap_fill(spark, d):
    filled = pr.fill_gaps(src.hourly_events(spark, d), HOUR)
    return text_ts(filled.select("series_id", "ts", "y"))


def chunk_assign(spark, d):
    return events_chunked(spark, d, 7).select("series_id", "idx", "chunk", "chunk_size", "pos")


def chunk_counts(spark, d):
    return pr.chunk_counts(pr.assign_chunks(orders_indexed(spark, d), 16))


def chunk_counts_short(spark, d):
    """Series shorter than the number of chunks, and a chunk-length limit."""
    return pr.chunk_counts(pr.assign_chunks(customers_indexed(spark, d), 12, max_chunk_rows=1))


def split_holdout(spark, d):
    return text_ts(events_split(spark, d).select("series_id", "idx", "ts", "y", "split", "step", "n"))


def gap_fill_index(spark, d):
    """Positions of a series with its missing hours filled in, ranked in cells of 50 hours."""
    filled = pr.fill_gaps(src.hourly_events(spark, d), HOUR, cell_rows=50)
    return text_ts(pr.index_series(filled, HOUR, cell_rows=50).select("series_id", "ts", "y", "idx", "n"))


def dirty_orders(spark: SparkSession, d: str) -> DataFrame:
    """Single orders per customer: urgent ones without a number, those of high priority without a time,
    those of medium priority without a value."""
    orders, kind = spark.read.parquet(f"{d}/orders.parquet"), F.col("o_orderpriority")
    value = F.when(kind == "1-URGENT", F.lit(float("nan"))).when(kind == "3-MEDIUM", F.lit(None).cast("double"))
    return orders.select(
        F.col("o_custkey").cast("string").alias("series_id"),
        F.when(kind != "2-HIGH", F.col("o_orderdate").cast("timestamp_ntz")).alias("ts"),
        value.otherwise(F.col("o_totalprice")).alias("y"),
    )


def csv_round_trip(spark, d):
    """Dirty rows written as ``demand,time``, read back and cleaned."""
    rows = dirty_orders(spark, d)
    path = f"{shared_dir(spark)}/chunkcast/csv-{uuid.uuid4().hex}"
    time = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time")
    rows.select(F.col("y").alias("demand"), time).write.option("header", True).csv(path)
    return text_ts(pr.clean(src.read_series_csv(spark, path, "orders")))


def zone_export(spark, d):
    """Training and hold-out files per series, read back by folder."""
    path = f"{shared_dir(spark)}/chunkcast/zones-{uuid.uuid4().hex}"
    sinks.write_series_csv(events_split(spark, d), path)
    schema = f"{src.CSV_SCHEMA}, series_id string, split string"
    back = spark.read.schema(schema).option("header", True).csv(path)
    return back.select("series_id", "split", F.col("time").alias("ts"), F.col("demand").alias("y"))


def coefficients_csv(spark, d):
    path = f"{shared_dir(spark)}/chunkcast/coefficients-{uuid.uuid4().hex}"
    sinks.write_coefficients_csv(trained_model(events_indexed(spark, d)), path)
    back = spark.read.schema("series_id string, pos int, theta double, sigma2 double").option("header", True).csv(path)
    return rounded(back, "theta", "sigma2")


def forecast_csv(spark, d):
    path = f"{shared_dir(spark)}/chunkcast/forecast-{uuid.uuid4().hex}"
    out = fc.add_intervals(_event_steps(spark, d), [95.0])
    sinks.write_forecast_csv(out.select("series_id", "step", "ts", "pred", "lower", "upper"), path)
    schema = "series_id string, step int, ts string, pred double, lower double, upper double"
    back = spark.read.schema(schema).option("header", True).csv(path)
    return rounded(back, "pred", "lower", "upper")


# ---- local models ---------------------------------------------------------------------------


def _coefs(local: DataFrame, p: int) -> DataFrame:
    out = local.select(
        "series_id", "chunk", "n_k", "sigma2",
        F.get("coef", F.lit(0)).alias("c0"),
        *[F.get("coef", F.lit(i + 1)).alias(f"pi{i}") for i in range(1, p + 1)],
    )
    return rounded(out, "sigma2", "c0", *[f"pi{i}" for i in range(1, p + 1)])


def ar1_local(spark, d):
    return _coefs(fit_local_ar(events_chunked(spark, d), 1), 1)


def ar2_local(spark, d):
    return _coefs(fit_local_ar(pr.assign_chunks(orders_indexed(spark, d), CHUNKS), 2), 2)


def ar3_local(spark, d):
    return _coefs(fit_local_ar(pr.assign_chunks(shipments_indexed(spark, d), CHUNKS), 3), 3)


def _lag_set_coefs(local: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    pis = [F.get("coef", F.lit(i + 1)).alias(f"pi{i}") for i in lags]
    out = local.select("series_id", "chunk", "n_k", "n_eff", "status", "sigma2", F.get("coef", F.lit(0)).alias("c0"), *pis)
    return rounded(out, "sigma2", "c0", *[f"pi{i}" for i in lags])


def ar_season24_local(spark, d):
    """Seasonal autoregressions on lags 1, 24 and 25 per chunk."""
    return _lag_set_coefs(fit_lag_set(events_chunked(spark, d), list(SEASON_LAGS)), SEASON_LAGS)


def ar1_local_gaps(spark, d):
    """AR(1) per chunk where hours without an event keep their place and have no value."""
    filled = pr.index_series(pr.fill_gaps(src.hourly_events(spark, d), HOUR), HOUR)
    return _lag_set_coefs(fit_lag_set(pr.assign_chunks(filled, CHUNKS), [1]), (1,))


def css_loss(spark, d):
    """Conditional sum of squares of a seasonal ARMA at fixed parameters, per chunk of the daily orders."""
    order = Order(1, 0, 1, 0, 0, 1, SEASON, True, False)

    def loss(pdf):
        y = pdf.sort_values("idx")["y"].to_numpy()
        e, _ = CssProblem(y, order).evaluate(np.array([*CSS_POINT, y.mean()]), jacobian=False)
        return pdf[["series_id", "chunk"]].head(1).assign(n_errors=len(e), sse=float(e @ e))

    chunked = pr.assign_chunks(orders_indexed(spark, d), CHUNKS)
    rows = chunked.select("series_id", "chunk", "idx", "y").groupBy("series_id", "chunk")
    return rounded(rows.applyInPandas(loss, "series_id string, chunk int, n_errors bigint, sse double"), "sse", digits=4)


def ar1_trend_local(spark, d):
    """AR(1) with trend, the trend origin moved to the start of the series."""
    local = rebase_trend(fit_local_ar(pr.assign_chunks(shipments_indexed(spark, d), CHUNKS), 1, trend=True))
    out = local.select(
        "series_id", "chunk", "start",
        F.get("coef", F.lit(0)).alias("c0"), F.get("coef", F.lit(1)).alias("c1"), F.get("coef", F.lit(2)).alias("pi1"),
    )
    return rounded(out, "c0", "c1", "pi1")


def local_weights(spark, d):
    out = cb.add_weights(fit_local_ar(events_chunked(spark, d), 1)).select(
        "series_id", "chunk", "w", F.get("wcoef", F.lit(0)).alias("wc0"), F.get("wcoef", F.lit(2)).alias("wpi1")
    )
    return rounded(out, "w", "wc0", "wpi1")


def model_rows(spark, d):
    """Every chunk of every customer series with its status; unusable chunks keep their row."""
    local = fit_local_ar(pr.assign_chunks(customers_indexed(spark, d), 2), 1)
    return local.select("series_id", "chunk", "n_k", "n_eff", "status")


def model_status(spark, d):
    series = staged(customers_indexed(spark, d), "customers")
    return cb.model_status(series, fit_local_ar(pr.assign_chunks(series, 2), 1))


MODEL_VIEW = ["series_id", "chunk", "p", "d", "q", "sp", "sd", "sq", "status"]


def order_search_ar(spark, d):
    """Order 1 or 2 per chunk by the corrected information criterion."""
    best = search_ar(events_chunked(spark, d), 2)
    return rounded(best.select("series_id", "chunk", "p", "aicc"), "aicc")


def order_search(spark, d):
    """Best seasonal model per chunk out of all orders up to 1, candidates dealt to two tasks."""
    config = ForecastConfig(period=24, search=SearchOptions(max_p=1, max_q=1, max_P=1, max_Q=1, max_order=3))
    models = fit_sarima(events_for_fit(spark, d), config, slots=2)
    return rounded(models.select(*MODEL_VIEW, "sigma2", "aicc"), "sigma2", "aicc", digits=3)


def order_search_approximate(spark, d):
    """The full grid ranked by two-stage regressions, only the winner fitted."""
    config = ForecastConfig(period=24, search=SearchOptions(approximation=True))
    models = fit_sarima(events_for_fit(spark, d), config)
    return rounded(models.select(*MODEL_VIEW, "sigma2"), "sigma2", digits=3)


def sarima_css(spark, d):
    """Seasonal models of a fixed order with moving-average terms."""
    config = ForecastConfig(period=24, order=(1, 0, 1), seasonal=(1, 0, 0), search=SearchOptions(allow_drift=False))
    models = fit_sarima(events_for_fit(spark, d), config)
    parts = {f"{c}1": F.get(c, F.lit(0)) for c in ("ar", "ma", "sar")}
    out = models.withColumns(parts).select(*MODEL_VIEW, *parts, "mean", "sigma2")
    return rounded(out, *parts, "mean", "sigma2", digits=3)


def sarima_css_ar(spark, d):
    """The seasonal fitter on a pure autoregression, which must agree with plain least squares."""
    config = ForecastConfig(period=1, order=(2, 0, 0), search=SearchOptions(allow_drift=False))
    models = fit_sarima(events_for_fit(spark, d), config)
    out = models.select(
        "series_id", "chunk", "n_k", "sigma2", "mean", *[F.get("ar", F.lit(i - 1)).alias(f"pi{i}") for i in (1, 2)]
    )
    return rounded(out, "sigma2", "mean", "pi1", "pi2", digits=4)


def sarima_whole(spark, d):
    """A moving-average model of each whole series, fitted by passes over blocks of its rows."""
    models = fit_whole_sarima(staged(events_indexed(spark, d), "events"), Order(0, 0, 1, 1, 0, 0, 24), tol=200)
    parts = {f"{c}1": F.get(c, F.lit(0)) for c in ("ma", "sar")}
    return rounded(models.withColumns(parts).select(*MODEL_VIEW, *parts, "mean", "sigma2"), *parts, "mean", "sigma2", digits=2)


def sarima_whole_ar(spark, d):
    """The same fitter on a pure autoregression, which must agree with plain least squares."""
    models = fit_whole_sarima(staged(events_indexed(spark, d), "events"), Order(2, 0, 0), tol=50)
    out = models.select(
        "series_id", "n_k", "sigma2", "mean", *[F.get("ar", F.lit(i - 1)).alias(f"pi{i}") for i in (1, 2)]
    )
    return rounded(out, "sigma2", "mean", "pi1", "pi2", digits=4)


def whole_order_ar(spark, d):
    """The automatic order of whole series among autoregressions, which plain least squares must confirm."""
    search = SearchOptions(max_p=2, max_q=0, max_P=0, max_Q=0)
    chunked = pr.assign_chunks(staged(events_indexed(spark, d), "events"), 1)
    models = fit_automatic(chunked, ForecastConfig(period=24, search=search), tol=50, best=99, tolerance=1e-12)
    parts = {f"pi{i}": F.get("ar", F.lit(i - 1)) for i in (1, 2)}
    out = models.withColumns(parts).withColumn("level", F.coalesce("mean", "drift"))
    return rounded(out.select("series_id", "n_k", "d", "sd", "p", *parts, "level", "sigma2"), *parts, "level", "sigma2", digits=4)


def whole_order_seasonal(spark, d):
    """The automatic order of whole series with moving-average and seasonal terms."""
    search = SearchOptions(max_p=2, max_q=2, max_P=1, max_Q=1)
    chunked = pr.assign_chunks(staged(events_indexed(spark, d), "events"), 1)
    models = fit_automatic(chunked, ForecastConfig(period=24, search=search), tol=200)
    return rounded(models.select("series_id", "n_k", "p", "d", "q", "sp", "sd", "sq", "sigma2", "aicc", "status"), "sigma2", "aicc", digits=2)


def diff_orders(spark, d):
    chunked = pr.assign_chunks(shipments_indexed(spark, d), CHUNKS, ForecastConfig.max_chunk_rows)
    return choose_differences(chunked, ForecastConfig(period=7))


def diff_orders_whole(spark, d):
    """The same choice for whole series, one chunk each."""
    return choose_differences(pr.assign_chunks(events_indexed(spark, d), 1), ForecastConfig(period=24))


# ---- combination ----------------------------------------------------------------------------


def dlsa_weighted(spark, d):
    local = fit_local_ar(events_chunked(spark, d), 2)
    return rounded(cb.combine_terms(local).select("series_id", "pos", "theta"), "theta")


def dlsa_orders(spark, d):
    local = fit_local_ar(pr.assign_chunks(orders_indexed(spark, d, by_priority=True), 16), 1)
    return rounded(cb.combine_terms(local).select("series_id", "pos", "theta", "n_used"), "theta")


def global_sigma2(spark, d):
    local = fit_local_ar(events_chunked(spark, d), 1)
    return rounded(cb.combine(local).select("series_id", "n_used", "sigma2"), "sigma2")


def dlsa_full_p2(spark, d):
    full = cb.combine_full(fit_local_ar(events_chunked(spark, d), 1))
    out = full.select(
        "series_id", "i", "theta",
        F.get("sigma_row", F.lit(0)).alias("s0"), F.get("sigma_row", F.lit(1)).alias("s1"),
    )
    return rounded(out, "theta", "s0", "s1")


# ---- expansion ------------------------------------------------------------------------------

SEASON, TOL = 24, 60


def moment_models(spark: SparkSession, d: str) -> DataFrame:
    """Seasonal models with moment estimates per series and chunk, as input of the expansion: lag-1
    and seasonal slopes, half the lag-1 correlation of the changes as moving-average terms."""
    rows = add_lags(
        events_chunked(spark, d, 2).select("series_id", "chunk", "pos", "y"),
        [1, 2, SEASON], ["series_id", "chunk"], "pos",
    )
    change, before = F.col("y") - F.col("l1"), F.col("l1") - F.col("l2")
    stats = rows.groupBy("series_id", "chunk").agg(
        F.regr_slope("y", "l1").alias("a"),
        F.regr_slope("y", f"l{SEASON}").alias("s"),
        (F.corr(change, before) / 2).alias("b"),
        F.avg("y").alias("mean"),
        F.avg(change).alias("drift"),
    )
    return stats.select(
        "series_id", "chunk",
        F.array("a").alias("ar"), F.array("b").alias("ma"),
        F.array("s").alias("sar"), F.array(F.col("b") / 2).alias("sma"),
        (F.col("chunk") - 1).alias("d"), (2 - F.col("chunk")).alias("sd"), F.lit(SEASON).alias("m"),
        "mean", "drift", F.lit("ok").alias("status"),
    )


def poly_product(spark, d):
    polys = ex.lag_polynomials(moment_models(spark, d))
    terms = polys.select("series_id", "chunk", F.posexplode_outer("ar_poly").alias("lag", "coef"))
    return rounded(terms, "coef")


def pi_weights(spark, d):
    weights = ex.pi_weights(moment_models(spark, d), TOL)
    return rounded(weights.select("series_id", "chunk", F.posexplode_outer("pi").alias("lag", "weight")), "weight")


def pi_weights_long(spark, d):
    """Weights beyond the length that higher-order functions take."""
    weights = ex.pi_weights(moment_models(spark, d), TOL_LONG)
    return rounded(weights.select("series_id", "chunk", F.posexplode_outer("pi").alias("lag", "weight")), "weight")


def ar_intercept_trend(spark, d):
    expanded = ex.intercept_and_trend(ex.pi_weights(moment_models(spark, d), TOL))
    return rounded(expanded.select("series_id", "chunk", "c0", "c1"), "c0", "c1")


# ---- forecasts ------------------------------------------------------------------------------


def lag_design(spark, d):
    rows = fc.lag_design(shipments_indexed(spark, d), 3)
    return rows.select(
        "series_id", "idx", "y", *[F.get("lags", F.lit(i - 1)).alias(f"y_lag{i}") for i in (1, 2, 3)]
    )


def fitted_residuals(spark, d):
    indexed = staged(orders_indexed(spark, d), "orders")
    return rounded(fc.fitted_values(indexed, trained_model(indexed), 2), "fitted", "residual")


def _event_steps(spark, d, h: int = HORIZON) -> DataFrame:
    train = pr.train_rows(events_staged(spark, d))
    return fc.forecast_steps(train, trained_model(train), h, 2, HOUR)


def forecast_ar2(spark, d):
    return rounded(_event_steps(spark, d).select("series_id", "step", "pred"), "pred")


def forecast_long(spark, d):
    """More steps than the higher-order recursion takes, with their errors."""
    return rounded(_event_steps(spark, d, STEPS_LONG).select("series_id", "step", "pred", "se"), "pred", "se")


def fitted_long(spark, d):
    """Fitted values of an autoregression with more lags than fit into columns: equal weights."""
    rows = staged(shipments_indexed(spark, d), "shipments")
    coef = F.array(F.lit(0.5), F.lit(0.0), *[F.lit(0.02)] * LAGS_LONG)
    model = rows.select("series_id").distinct().withColumn("coef", coef)
    return rounded(fc.fitted_values(rows, model, LAGS_LONG), "fitted", "residual")


def psi_weights(spark, d):
    model = fc.psi_weights(trained_model(pr.train_rows(events_split(spark, d))), HORIZON)
    return rounded(model.select("series_id", F.posexplode_outer("psi").alias("lag", "psi")), "psi")


def forecast_se(spark, d):
    return rounded(_event_steps(spark, d).select("series_id", "step", "se"), "se")


def intervals_multi(spark, d):
    out = fc.add_intervals(_event_steps(spark, d), fc.check_levels([0.8, 0.95]))
    return rounded(out.select("series_id", "step", "level", "lower", "upper"), "level", "lower", "upper")


def intervals_fan(spark, d):
    out = fc.add_intervals(_event_steps(spark, d), fc.check_levels(fan=True))
    return rounded(out.select("series_id", "step", "level", "lower", "upper"), "level", "lower", "upper")


def forecast_table(spark, d):
    return rounded(text_ts(_event_steps(spark, d)), "pred", "se")


def whole_series_ar2(spark, d):
    """Comparison run with one chunk per series: the covariance sums of a whole series are built by
    many tasks, so its length does not matter."""
    train = pr.train_rows(events_staged(spark, d))
    model = cb.combine(fit_local_ar(pr.assign_chunks(train, 1), 2))
    return rounded(fc.forecast_steps(train, model, HORIZON, 2, HOUR).select("series_id", "step", "pred", "se"), "pred", "se")


def whole_series_forecast(spark, d):
    """Comparison run with an automatic seasonal model per whole series."""
    train = pr.train_rows(events_staged(spark, d))
    config = ForecastConfig(
        period=24, tol=200, h=HORIZON, search=SearchOptions(max_p=2, max_q=1, max_P=1, max_Q=1, max_order=3)
    )
    out = runs.forecast_whole_series(train, config, distributed=True)
    return rounded(text_ts(out), "pred", "se", "lower", "upper", digits=3)


def chunked_seasonal_forecast(spark, d):
    """A complete run with automatic seasonal models on chunks and its mean scores."""
    config = ForecastConfig(period=24, tol=100, chunks=CHUNKS, h=HORIZON, search=SearchOptions(approximation=True))
    run = runs.run_forecast(src.hourly_events(spark, d), config)
    return rounded(ev.mean_scores(run.scores), "mase", "smape", "msis", digits=3)


def inv_box_cox_series(spark, d):
    """Log-scale forecasts of daily orders brought back, with and without bias adjustment, and the
    power form applied to the observations."""
    logs = orders_indexed(spark, d).withColumn("y", F.log("y"))
    train = staged(pr.train_rows(pr.split_holdout(logs, HORIZON)), "logs")
    steps = fc.forecast_steps(train, trained_model(train, 1), HORIZON, 1, DAY)
    out = steps.select(
        "series_id", "step",
        inv_box_cox(F.col("pred"), 0).alias("median"),
        inv_box_cox(F.col("pred"), 0, F.col("se") * F.col("se")).alias("mean"),
        inv_box_cox(F.col("pred"), 0.5).alias("power"),
    )
    return rounded(out, "median", "mean", "power")


# ---- evaluation -----------------------------------------------------------------------------


def seasonal_scale(spark, d):
    train = pr.train_rows(events_split(spark, d))
    return rounded(ev.seasonal_scale(train, 24), "scale")


def seasonal_scale_weekly(spark, d):
    return rounded(ev.seasonal_scale(shipments_indexed(spark, d), 7), "scale")


def _event_scores(spark, d, by_type: bool = True) -> DataFrame:
    split = events_staged(spark, d, by_type)
    train = pr.train_rows(split)
    out = fc.forecast(train, trained_model(train), HORIZON, 2, HOUR, 95)
    return ev.score_steps(out, pr.test_rows(split), ev.seasonal_scale(train, 24))


def score_steps(spark, d):
    out = _event_scores(spark, d).select("series_id", "step", "level", "y", "mase", "smape", "msis")
    return rounded(out, "level", "y", "mase", "smape", "msis")


def mean_scores(spark, d):
    return rounded(ev.mean_scores(_event_scores(spark, d)), "level", "mase", "smape", "msis")


def unmatched_steps(spark, d):
    """Forecasts reach 30 steps, the hold-out only 24."""
    split = events_staged(spark, d)
    train = pr.train_rows(split)
    out = fc.forecast_steps(train, trained_model(train), 30, 2, HOUR)
    return ev.unmatched_steps(out, pr.test_rows(split))


def flagship(spark, d):
    """Hourly total: hold out a day, fit AR(2) on 4 chunks, combine, forecast and score."""
    out = _event_scores(spark, d, by_type=False).select(
        "step", "ts", "y", "pred", "lower", "upper", "mase", "smape", "msis"
    )
    return rounded(text_ts(out), "y", "pred", "lower", "upper", "mase", "smape", "msis", digits=4)


def run_sizes(spark, d):
    """Sample size, rows per chunk, coefficients and chunks of a run per series."""
    chunked = events_chunked(spark, d)
    return chunked.groupBy("series_id").agg(
        F.max("n").alias("sample_size"),
        F.max("chunk_size").alias("sample_size_per_chunk"),
        F.lit(TOL + 2).alias("n_par"),
        F.max("chunk").alias("chunks"),
    )


def run_status(spark, d):
    """What became of each customer's series of dirty orders in a run with an AR(1) per series."""
    series = staged(dirty_orders(spark, d), "orders")
    split = staged(pr.split_holdout(pr.index_series(pr.clean(millions(series)), DAY), STATUS_STEPS), "split")
    train, test = pr.train_rows(split), pr.test_rows(split)
    local = staged(fit_local_ar(pr.assign_chunks(train, 1), 1), "local")
    out = fc.forecast(train, cb.combine(local), STATUS_STEPS, 1, DAY, 95)
    return runs.run_status(series, train, local, staged(out, "forecast"), test)


QUERIES = {
    f.__name__: f
    for f in (
        hourly_series, hourly_total, daily_orders_series, daily_shipments_series, series_sizes, row_index,
        row_index_ranged, gap_fill, gap_fill_index, csv_round_trip, zone_export, coefficients_csv, forecast_csv, chunk_assign, chunk_counts, chunk_counts_short, split_holdout,
        ar1_local, ar2_local, ar3_local, ar_season24_local, ar1_local_gaps, css_loss, ar1_trend_local, local_weights, model_rows, model_status,
        order_search_ar, order_search, order_search_approximate, sarima_css, sarima_css_ar,
        sarima_whole, sarima_whole_ar, diff_orders, diff_orders_whole, whole_order_ar, whole_order_seasonal,
        dlsa_weighted, dlsa_orders, global_sigma2, dlsa_full_p2,
        poly_product, pi_weights, pi_weights_long, ar_intercept_trend,
        lag_design, fitted_residuals, fitted_long, forecast_ar2, forecast_long, psi_weights, forecast_se, intervals_multi,
        intervals_fan, forecast_table, inv_box_cox_series,
        whole_series_ar2, whole_series_forecast, chunked_seasonal_forecast,
        seasonal_scale, seasonal_scale_weekly, score_steps, mean_scores, unmatched_steps, flagship, run_sizes, run_status,
    )
}
