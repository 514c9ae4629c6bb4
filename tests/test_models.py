import math

import numpy as np
import pytest
from helpers import forecast_loop, ols, pi_loop, season, series_frame, series_frames, simulate
from pyspark.sql import functions as F

from chunkcast.config import ForecastConfig, SearchOptions
from chunkcast.functions.css import CssProblem, Order, difference_orders, fit_css, kpss_level, seasonal_strength
from chunkcast.operators import combine as cb
from chunkcast.operators import expand as ex
from chunkcast.operators import local_sarima as ls
from chunkcast.operators import prepare as pr
from chunkcast.operators.local_ar import MAX_LAGS, fit_local_ar, rebase_trend

HOUR = 3600


def chunked(spark, values, k, name="s"):
    return pr.assign_chunks(pr.index_series(series_frame(spark, values, name), HOUR), k)


# ---- autoregressions from covariance sums ----------------------------------------------------


@pytest.mark.parametrize("p,trend", [(1, False), (2, False), (1, True), (3, False), (4, True)])
def test_local_ar_equals_least_squares(spark, p, trend):
    y = simulate(600, ar=(0.5, 0.2), mean=10)
    for row in fit_local_ar(chunked(spark, y, 3), p, trend).collect():
        part = y[(row.chunk - 1) * 200 : row.chunk * 200]
        beta, sse = ols(part, p, trend)
        expected = list(beta) if trend else [beta[0], 0.0, *beta[1:]]
        assert np.allclose(row.coef, expected, atol=1e-8)
        assert row.sigma2 == pytest.approx(sse / (200 - p - 1 - trend))
        assert (row.n_k, row.n_eff, row.start) == (200, 200 - p, (row.chunk - 1) * 200 + 1)


@pytest.mark.parametrize("block_rows", [8, 13, 1000])
def test_blocks_do_not_change_the_fit(spark, block_rows):
    y = simulate(120, ar=(0.4,), mean=3)
    base = fit_local_ar(chunked(spark, y, 2), 2).orderBy("chunk").collect()
    cut = fit_local_ar(chunked(spark, y, 2), 2, block_rows=block_rows).orderBy("chunk").collect()
    assert np.allclose([r.coef for r in base], [r.coef for r in cut])
    assert [r.n_eff for r in base] == [r.n_eff for r in cut]


def test_simulated_coefficients_are_recovered(spark):
    y = simulate(20_000, ar=(0.5, 0.2), mean=10)
    for k in (1, 8):
        model = cb.combine(fit_local_ar(chunked(spark, y, k), 2)).first()
        assert model.coef[2] == pytest.approx(0.5, abs=4 * 0.007)
        assert model.coef[3] == pytest.approx(0.2, abs=4 * 0.007)
        assert model.sigma2 == pytest.approx(1.0, abs=0.05)


def test_status_of_unusable_chunks(spark):
    named = {"short": [1.0, 2.0], "flat": [5.0] * 50, "line": list(range(50)), "good": simulate(50, ar=(0.3,))}
    frame = pr.assign_chunks(pr.index_series(series_frames(spark, named), HOUR), 1)
    local = fit_local_ar(frame, 1)
    status = {r.series_id: r.status for r in local.collect()}
    assert status["short"] == "too_short" and status["flat"] == "singular" and status["good"] == "ok"
    report = {r.series_id: (r.chunks, r.failed, r.status) for r in cb.model_status(frame, local).collect()}
    assert report["flat"] == (1, 1, "no_model") and report["good"] == (1, 0, "ok")


def test_lag_limit(spark):
    with pytest.raises(ValueError):
        fit_local_ar(chunked(spark, range(50), 1), MAX_LAGS + 1)


def test_trend_rebasing(spark):
    y = 5 + 0.1 * np.arange(1, 401) + simulate(400, seed=1)
    local = fit_local_ar(chunked(spark, y, 4), 1, trend=True)
    before = {r.chunk: r.coef for r in local.collect()}
    for r in rebase_trend(local).collect():
        c0, c1, pi = before[r.chunk]
        assert r.coef == pytest.approx([c0 - c1 * (r.chunk - 1) * 100, c1, pi])
    combined = cb.combine(rebase_trend(local)).first().coef
    assert combined[1] / (1 - combined[2]) == pytest.approx(0.1, abs=0.02)


# ---- combination -----------------------------------------------------------------------------


def local_rows(spark, rows):
    return spark.createDataFrame(
        [(s, k, n, v, c, st) for s, k, n, v, c, st in rows],
        "series_id string, chunk int, n_k bigint, sigma2 double, coef array<double>, status string",
    )


def test_combination_by_hand_and_failed_chunks(spark):
    rows = [
        ("s", 1, 10, 2.0, [1.0, 0.0, 0.5], "ok"),
        ("s", 2, 30, 3.0, [2.0, 0.0, 0.1], "ok"),
        ("s", 3, 99, None, None, "singular"),
    ]
    model = cb.combine(local_rows(spark, rows)).first()
    assert model.coef == pytest.approx([(5 * 1 + 10 * 2) / 15, 0.0, (5 * 0.5 + 10 * 0.1) / 15])
    assert model.sigma2 == pytest.approx(40 / 15) and model.n_used == 40


def test_combination_ignores_order_and_partitions(spark):
    rows = [("s", k, 100, 1.0 + k, [float(k), 0.0, 1.0 / k], "ok") for k in range(1, 9)]
    one = cb.combine(local_rows(spark, rows).coalesce(1)).first()
    many = cb.combine(local_rows(spark, rows[::-1]).repartition(6)).first()
    assert one.coef == pytest.approx(many.coef)


def test_one_chunk_equals_the_local_model(spark):
    local = fit_local_ar(chunked(spark, simulate(200, ar=(0.5,)), 1), 1)
    assert cb.combine(local).first().coef == pytest.approx(local.first().coef)
    full = {r.i: r.theta for r in cb.combine_full(local).collect()}
    assert [full[0], full[1]] == pytest.approx([local.first().coef[0], local.first().coef[2]])


def test_full_and_simplified_agree_for_scalar_covariance(spark):
    """With X'X = n * identity both forms are the same weighted mean."""
    rows = [("s", k, n, n, v, [c0, 0.0, pi], "ok", [0.0, 0.0], [1.0, 0.0, 0.0, 1.0])
            for k, n, v, c0, pi in ((1, 10, 2.0, 1.0, 0.5), (2, 30, 3.0, 2.0, 0.1))]
    local = spark.createDataFrame(
        rows,
        "series_id string, chunk int, n_k bigint, n_eff bigint, sigma2 double, coef array<double>, status string, "
        "means array<double>, cov array<double>",
    )
    simple = cb.combine(local).first()
    full = cb.combine_full(local)
    got = {r.i: r for r in full.collect()}
    assert [got[0].theta, got[1].theta] == pytest.approx([simple.coef[0], simple.coef[2]])
    assert cb.full_sigma2(full).first().sigma2 == pytest.approx(simple.sigma2)


def test_weights(spark):
    row = cb.add_weights(local_rows(spark, [("s", 1, 10, 2.0, [1.0, 0.0, 0.5], "ok")])).first()
    assert row.w == 5.0 and row.wcoef == [5.0, 0.0, 2.5]


# ---- expansion -------------------------------------------------------------------------------

MODELS = [
    # name, d, sd, m, ar, ma, sar, sma, mean, drift
    ("ar1", 0, 0, 1, [0.6], [], [], [], 2.0, None),
    ("ima", 1, 0, 1, [], [-0.4], [], [], None, None),
    ("airline", 1, 1, 12, [], [-0.4], [], [-0.6], None, None),
    ("mixed", 1, 1, 12, [0.3, -0.2], [0.5], [0.4], [0.2], None, 0.1),
    ("long", 2, 1, 12, [0.2, 0.3, 0.5], [0.1, 0.4], [0.3, 0.2], [0.3], 0.3, 0.0),
    ("plain", 0, 0, 1, [0.5, 0.1], [0.3], None, None, 1.0, 0.2),
]


def models(spark):
    return spark.createDataFrame(
        [(*row, "ok") for row in MODELS],
        "name string, d int, sd int, m int, ar array<double>, ma array<double>, sar array<double>, "
        "sma array<double>, mean double, drift double, status string",
    )


def reference(row, tol):
    _, d, sd, m, ar, ma, sar, sma, mean, drift = row
    a = np.convolve(np.r_[1, -np.array(ar)], season(-np.array(sar or []), m) if m > 1 else [1.0])
    for _ in range(d):
        a = np.convolve(a, [1.0, -1.0])
    for _ in range(sd):
        a = np.convolve(a, season(np.array([-1.0]), m))
    b = np.convolve(np.r_[1, np.array(ma)], season(np.array(sma or []), m) if m > 1 else [1.0])
    pi = np.array(pi_loop(a, b, tol))
    mu, dft = mean or 0.0, drift or 0.0
    c0 = mu * (1 - pi.sum()) + dft * (np.arange(1, tol + 1) @ pi)
    return [c0, dft * (1 - pi.sum()), *pi]


@pytest.mark.parametrize("tol", [1, 40, 300])
def test_expansion_equals_the_loop(spark, tol):
    got = {r["name"]: r.coef for r in ex.expand_models(models(spark), tol).collect()}
    for row in MODELS:
        assert np.allclose(got[row[0]], reference(row, tol), atol=1e-9), row[0]


def test_known_expansions(spark):
    got = {r["name"]: r.coef for r in ex.expand_models(models(spark), 60).collect()}
    assert got["ar1"][2:5] == pytest.approx([0.6, 0, 0])
    assert got["ar1"][0] == pytest.approx(2.0 * 0.4)
    assert got["ima"][2:] == pytest.approx([(1 - 0.4) * 0.4 ** (j - 1) for j in range(1, 61)])
    assert sum(got["ima"][2:]) == pytest.approx(1.0)


# ---- seasonal fits ---------------------------------------------------------------------------


def slow_errors(problem, theta):
    o, (ar, sar, ma, sma, beta) = problem.o, problem.split(theta)
    v = problem.w - beta @ problem.x if len(beta) else problem.w
    a = np.convolve(np.r_[1, -ar], season(-sar, o.m))
    b = np.convolve(np.r_[1, ma], season(sma, o.m))
    e = np.zeros(len(v))
    for t in range(problem.start, len(v)):
        e[t] = sum(a[j] * v[t - j] for j in range(len(a)))
        e[t] -= sum(b[j] * e[t - j] for j in range(1, len(b)) if t - j >= problem.start)
    return e[problem.start :]


@pytest.mark.parametrize(
    "order,theta",
    [
        (Order(1, 0, 1, 1, 0, 1, 12), [0.4, 0.3, 0.2, -0.1, 9.0]),
        (Order(2, 1, 2, 0, 1, 1, 12), [0.4, -0.2, 0.5, 0.1, -0.4]),
        (Order(0, 1, 1, 0, 0, 0, 1, True, True), [-0.5, 0.01]),
        (Order(2, 0, 0, 1, 0, 0, 12, True, True), [0.3, 0.1, 0.2, 9.0, 0.01]),
    ],
)
def test_errors_and_derivatives(order, theta):
    y = simulate(200, ar=(0.5,), ma=(0.3,), mean=10)
    problem, theta = CssProblem(y, order), np.array(theta)
    e, jac = problem.evaluate(theta)
    assert np.allclose(e, slow_errors(problem, theta), atol=1e-9)
    for k in range(len(theta)):
        step = np.zeros(len(theta))
        step[k] = 1e-6
        slope = (problem.evaluate(theta + step)[0] - problem.evaluate(theta - step)[0]) / 2e-6
        assert np.allclose(slope, jac[k], atol=1e-4 * max(1, np.abs(jac[k]).max()))


def test_seasonal_simulation_is_recovered():
    y = simulate(6000, ar=(0.6,), ma=(0.3,), sar=(0.5,), sma=(0.4,), m=24, mean=10)
    fit = fit_css(y, Order(1, 0, 1, 1, 0, 1, 24))
    got = [*fit["ar"], *fit["ma"], *fit["sar"], *fit["sma"]]
    assert np.allclose(got, [0.6, 0.3, 0.5, 0.4], atol=0.08)
    assert fit["status"] == "ok" and fit["sigma2"] == pytest.approx(1.0, abs=0.08)


def test_pure_autoregression_equals_least_squares():
    y = simulate(300, ar=(0.5, 0.2), mean=10)
    fit = fit_css(y, Order(2, 0, 0))
    beta, sse = ols(y, 2)
    assert fit["ar"] == pytest.approx(beta[1:], abs=1e-5)
    assert fit["mean"] == pytest.approx(beta[0] / (1 - beta[1] - beta[2]), abs=1e-3)
    assert fit["sigma2"] == pytest.approx(sse / (300 - 3), rel=1e-6)


def test_short_and_flat_chunks_have_a_status():
    assert fit_css(np.arange(4.0), Order(2, 0, 2))["status"] == "too_short"
    assert fit_css(np.ones(100), Order(1, 0, 0))["status"] == "degenerate"


def test_difference_orders():
    noise = simulate(600, seed=5)
    assert difference_orders(noise, 12, 2, 1) == (0, 0)
    assert difference_orders(np.cumsum(noise), 12, 2, 1)[0] == 1
    assert difference_orders(noise + 10 * np.sin(np.arange(600) * 2 * math.pi / 12), 12, 2, 1)[1] == 1
    assert kpss_level(noise) < 0.463 < kpss_level(np.cumsum(noise))
    assert seasonal_strength(noise, 1) == 0.0


def test_candidate_grid():
    assert len(ls.candidate_orders(SearchOptions(), 24)) == 192
    assert all(sp == sq == 0 for _, _, sp, sq, _ in ls.candidate_orders(SearchOptions(), 1))
    assert not any(c[4] for c in ls.candidate_orders(SearchOptions(allow_mean=False, allow_drift=False), 24))


def test_fixed_fit_keeps_every_chunk(spark):
    named = {"good": simulate(200, ar=(0.5,), ma=(0.2,)), "flat": [1.0] * 40, "tiny": [1.0, 2.0, 3.0]}
    frame = pr.assign_chunks(pr.index_series(series_frames(spark, named), HOUR), 2)
    config = ForecastConfig(period=12, order=(1, 0, 1), search=SearchOptions(allow_drift=False))
    rows = ls.fit_sarima(frame, config).collect()
    assert len(rows) == 6
    assert {r.status for r in rows if r.series_id == "good"} == {"ok"}
    assert {r.status for r in rows if r.series_id == "flat"} == {"degenerate"}
    assert {r.status for r in rows if r.series_id == "tiny"} == {"too_short"}
    local = cb.combine(ex.expand_models(ls.fit_sarima(frame, config), 20)).collect()
    assert [r.series_id for r in local] == ["good"] and len(local[0].coef) == 22


def test_search_does_not_depend_on_slots_and_beats_fixed_orders(spark):
    y = simulate(300, ar=(0.7,), mean=4)
    frame = chunked(spark, y, 2)
    config = ForecastConfig(period=1, search=SearchOptions(max_p=2, max_q=1, max_order=3))
    one = ls.fit_sarima(frame, config, slots=1).orderBy("chunk").collect()
    three = ls.fit_sarima(frame, config, slots=3).orderBy("chunk").collect()
    assert [(r.p, r.d, r.q, r.aicc) for r in one] == [(r.p, r.d, r.q, r.aicc) for r in three]
    candidates = ls.fit_candidates(frame, config)
    best = candidates.groupBy("chunk").agg(F.min("aicc").alias("aicc")).orderBy("chunk").collect()
    assert [r.aicc for r in best] == [r.aicc for r in one]


def test_fixed_and_searched_orders_forecast_alike(spark):
    """A single autoregressive chunk: the expanded model forecasts like the model itself."""
    y = simulate(300, ar=(0.6,), mean=4)
    config = ForecastConfig(period=1, order=(1, 0, 0), search=SearchOptions(allow_drift=False))
    coef = ex.expand_models(ls.fit_sarima(chunked(spark, y, 1), config), 5).first().coef
    assert forecast_loop(y, coef, 200)[-1] == pytest.approx(coef[0] / (1 - coef[2]), abs=1e-6)


def test_ar_search(spark):
    y = simulate(2000, ar=(0.3, 0.5))
    rows = ls.search_ar(chunked(spark, y, 2), 3).collect()
    assert all(r.p >= 2 for r in rows) and all(len(r.coef) == r.p + 2 for r in rows)
