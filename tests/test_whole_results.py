"""No row, chunk or series vanishes or changes its model by size, by a limit or by a parallelism setting."""

import numpy as np
import pytest
from helpers import forecast_loop, ols, series_frame, series_frames, simulate
from pyspark.sql import functions as F

from chunkcast import ForecastConfig, SearchOptions
from chunkcast.functions import arrays
from chunkcast.operators import combine as cb
from chunkcast.operators import expand as ex
from chunkcast.operators import forecast as fc
from chunkcast.operators import prepare as pr
from chunkcast.operators.local_ar import fit_local_ar
from chunkcast.operators.local_sarima import fit_sarima
from chunkcast.plans import runs
from chunkcast.sources import series as src

HOUR = 3600


def test_filled_intervals_have_positions(spark):
    rows = series_frame(spark, range(20)).filter(~F.hour("ts").isin(3, 7, 8))
    indexed = pr.index_series(pr.fill_gaps(rows, HOUR, cell_rows=5), HOUR, cell_rows=5)
    got = sorted((r.idx, r.n) for r in indexed.collect())
    assert got == [(k, 20) for k in range(1, 21)]


def test_holdout_rows_without_time_take_no_step(spark):
    rows = series_frame(spark, [1.0, 2.0, 3.0]).withColumn("ts", F.when(F.col("y") != 1, F.col("ts")))
    assert sorted((r.step, r.y) for r in pr.index_holdout(rows, HOUR).collect()) == [(1, 2.0), (2, 3.0)]
    assert pr.untimed_rows(rows).first().untimed == 1


@pytest.mark.parametrize("recent", [[3.0, 2.0, 1.0], [3.0, None, 1.0], [3.0, 2.0, None], [3.0], None, [3.0, float("nan"), 0.0]])
@pytest.mark.parametrize("coef", [[0.5, 0.1, 0.6, 0.2], [0.5, 0.1, 0.6, 0.2, 0.1, 0.05], None])
def test_both_recursions_agree(spark, monkeypatch, recent, coef):
    frame = spark.createDataFrame([(coef, 3, recent)], "coef array<double>, n bigint, recent array<double>")
    short = fc.forecast_path(frame, 5, 2).first().path
    monkeypatch.setattr(fc, "HOF_WORK", 0)
    long = fc.forecast_path(frame, 5, 2).first().path
    assert (short is None) == (long is None)
    usable = coef and recent and len(recent) >= len(coef) - 2 and not any(v is None or v != v for v in recent[: len(coef) - 2])
    assert (short is not None) == bool(usable)
    if short:
        want = forecast_loop(recent[::-1], coef, 5)
        assert np.allclose(short, long) and np.allclose(short, want)


def test_both_expansions_agree(spark, monkeypatch):
    rows = [([1.0, -0.5, 0.2], [1.0, 0.4]), ([1.0], [1.0, 0.4, 0.1, 0.3]), (None, [1.0]), ([1.0, 0.2], None)]
    frame = spark.createDataFrame(rows, "num array<double>, den array<double>").coalesce(1)
    short = [r.out for r in arrays.add_series_ratio(frame, "num", "den", 12, "out").collect()]
    monkeypatch.setattr(arrays, "HOF_TERMS", 1)
    long = [r.out for r in arrays.add_series_ratio(frame, "num", "den", 12, "out").collect()]
    for a, b in zip(short, long):
        assert (a is None and b is None) or np.allclose(a, b)


def test_slots_do_not_change_the_model(spark):
    y = simulate(240, ar=[0.6], ma=[0.3], seed=5)
    chunked = pr.assign_chunks(pr.index_series(series_frame(spark, y), HOUR), 2)
    for approximation in (True, False):
        config = ForecastConfig(period=1, search=SearchOptions(max_p=2, max_q=1, max_P=0, max_Q=0, approximation=approximation))
        models = [sorted((r.chunk, r.p, r.d, r.q, r.aicc) for r in fit_sarima(chunked, config, s).collect()) for s in (1, 3)]
        assert models[0] == models[1]


def test_chunk_lengths_are_those_asked_for(spark):
    assert ForecastConfig().max_chunk_rows is None
    indexed = pr.index_series(series_frame(spark, range(100)), HOUR)
    assert runs.pr.chunk_counts(pr.assign_chunks(indexed, 1, ForecastConfig().max_chunk_rows)).first().n_k == 100


@pytest.mark.parametrize("status, kept", [("ok", True), ("no_convergence", True), ("near_unit_root", True), ("too_short", False)])
def test_estimates_that_did_not_converge_are_kept_with_their_status(spark, status, kept):
    row = [("s", 1, 50, [0.5], [], [], [], 0, 0, 1, 1.0, 0.0, 2.0, status)]
    models = spark.createDataFrame(
        row, "series_id string, chunk int, n_k bigint, ar array<double>, ma array<double>, sar array<double>, sma array<double>, "
        "d int, sd int, m int, mean double, drift double, sigma2 double, status string",
    )
    local = ex.expand_models(models, 3)
    assert (local.first().coef is not None) == kept and local.first().status == status
    assert cb.combine(local).count() == int(kept)
    assert (ex.expand_models(models, 3, keep_unconverged=False).first().coef is not None) == (status == "ok")


def test_every_series_of_a_run_has_a_status_row(spark):
    y = simulate(200, ar=[0.5], mean=10, seed=3)
    named = {"long": y, "tiny": y[:10], "one": y[:1], "void": [None] * 5, "flat": [4.0] * 60}
    config = ForecastConfig(period=1, tol=30, chunks=2, h=12, order=(1, 0, 0), search=SearchOptions(allow_drift=False))
    run = runs.run_forecast(series_frames(spark, named), config)
    rows = {r.series_id: r for r in run.status.collect()}
    assert {k: r.status for k, r in rows.items()} == {"long": "ok", "tiny": "short", "one": "short", "void": "empty", "flat": "no_model"}
    assert rows["void"].dropped == 5 and rows["long"].trained == 188 and rows["tiny"].holdout_only == 10
    assert rows["flat"].failed == 2 and rows["flat"].missing == 12
    fitted = run.fitted.filter("series_id = 'long'")
    assert fitted.count() == 188 and fitted.filter("fitted IS NULL").count() == 30


def test_missing_steps_of_a_separate_holdout_are_reported(spark):
    y = simulate(120, ar=[0.5], seed=4)
    config = ForecastConfig(period=1, tol=10, chunks=1, h=8, order=(1, 0, 0), search=SearchOptions(allow_drift=False))
    run = runs.run_forecast(series_frame(spark, y), config, series_frame(spark, y[:5]))
    row = run.status.first()
    assert (row.status, row.forecast_only, row.holdout_only) == ("ok", 3, 0)


def test_full_covariance_with_trend(spark):
    y = np.arange(300) * 0.05 + simulate(300, ar=[0.4], seed=8)
    indexed = pr.index_series(series_frame(spark, y), HOUR)
    one = cb.combine_full(fit_local_ar(pr.assign_chunks(indexed, 1), 1, trend=True)).orderBy("i").collect()
    beta, _ = ols(y, 1, trend=True)
    assert np.allclose([r.theta for r in one], beta, rtol=1e-6)
    several = cb.combine_full(fit_local_ar(pr.assign_chunks(indexed, 3), 1, trend=True)).orderBy("i").collect()
    assert all(np.isfinite(r.theta) for r in several)
    assert abs(several[1].theta - beta[1]) < 0.02 and abs(several[2].theta - beta[2]) < 0.2


def test_sums_are_exact_unless_digits_are_given(spark):
    rows = spark.createDataFrame([("2020-01-01 00:10:00", 0.004), ("2020-01-01 00:20:00", 0.003)], "ts string, v double")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert src.series_from_rows(rows, "ts", "v", HOUR).first().y == pytest.approx(0.007)
    assert src.series_from_rows(rows, "ts", "v", HOUR, digits=2).first().y == 0.0


def test_levels_name_the_offender():
    assert fc.check_levels([0.8, 0.95]) == [80.0, 95.0] and fc.check_levels((80, 95)) == [80.0, 95.0]
    with pytest.raises(ValueError, match="100"):
        fc.check_levels([80, 100])
    with pytest.raises(ValueError, match="-1"):
        fc.check_levels([-1])


def test_distributed_whole_series_without_an_order_keeps_every_step(spark):
    train = pr.index_series(series_frame(spark, [5 + (k * 37 % 11) for k in range(120)]), HOUR)
    config = ForecastConfig(period=1, tol=20, h=6, search=SearchOptions(max_p=1, max_q=1))
    out = runs.forecast_whole_series(train, config, distributed=True).collect()
    assert sorted(r.step for r in out) == list(range(1, 7)) and all(r.pred is not None for r in out)
