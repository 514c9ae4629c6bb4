import numpy as np
import pytest
from helpers import START, forecast_loop, psi_loop, series_frame, series_frames, simulate
from pyspark.sql import functions as F

import chunkcast.functions.arrays as arrays
import chunkcast.operators.forecast as fc
from chunkcast.functions.boxcox import inv_box_cox
from chunkcast.operators import evaluate as ev
from chunkcast.operators import prepare as pr

HOUR = 3600


def train_of(spark, named):
    return pr.index_series(series_frames(spark, named), HOUR)


def model_of(spark, coefs, sigma2=1.0):
    return spark.createDataFrame(
        [(s, sigma2, [float(x) for x in c]) for s, c in coefs.items()], "series_id string, sigma2 double, coef array<double>"
    )


@pytest.mark.parametrize("native", [True, False])
@pytest.mark.parametrize("coef", [[1.0, 0.01, 0.5, 0.2], [2.0, 0.0, 0.3, 0.1, -0.2, 0.05, 0.4]])
def test_recursion_equals_the_loop(spark, monkeypatch, native, coef):
    monkeypatch.setattr(fc, "HOF_WORK", 10_000 if native else 0)
    monkeypatch.setattr(arrays, "HOF_TERMS", 200 if native else 0)
    y, h, p = simulate(60, mean=5), 12, len(coef) - 2
    steps = fc.forecast_steps(train_of(spark, {"s": y}), model_of(spark, {"s": coef}, 2.0), h, p, HOUR)
    rows = steps.orderBy("step").collect()
    assert [r.step for r in rows] == list(range(1, h + 1))
    assert [r.pred for r in rows] == pytest.approx(forecast_loop(y, coef, h))
    psi = np.array(psi_loop(coef[2:], h))
    assert [r.se for r in rows] == pytest.approx(np.sqrt(2.0 * np.cumsum(psi**2)))
    assert rows[0].ts == START.replace() + (rows[0].ts - START) and (rows[0].ts - START).total_seconds() == 60 * HOUR


def test_psi_of_first_order_model_and_growing_errors(spark):
    psi = fc.psi_weights(model_of(spark, {"s": [0.0, 0.0, 0.7]}), 10).first().psi
    assert psi == pytest.approx([0.7**j for j in range(10)])
    steps = fc.forecast_steps(train_of(spark, {"s": range(5)}), model_of(spark, {"s": [0.0, 0.0, 0.7]}), 10, 1, HOUR)
    se = [r.se for r in steps.orderBy("step").collect()]
    assert all(b >= a for a, b in zip(se, se[1:]))
    assert fc.psi_weights(model_of(spark, {"s": [0.0, 0.0, 0.7]}), 1).first().psi == [1.0]


def test_series_without_model_or_history_keep_null_rows(spark):
    train = train_of(spark, {"short": [1.0], "lost": range(9), "fine": range(9)})
    model = model_of(spark, {"short": [0, 0, 0.5, 0.1], "fine": [0, 0, 0.5, 0.1]})
    steps = fc.forecast_steps(train, model, 3, 2, HOUR)
    out = fc.add_intervals(steps, [95.0])
    counts = {r.series_id: r.missing for r in fc.missing_forecasts(out).collect()}
    assert counts == {"short": 3, "lost": 3, "fine": 0}


def test_levels():
    assert fc.check_levels() == [80.0, 95.0]
    assert fc.check_levels([0.8, 0.95]) == pytest.approx([80.0, 95.0])
    assert fc.check_levels(95) == [95.0]
    assert fc.check_levels(fan=True) == [float(x) for x in range(51, 100, 3)]
    for bad in ([-1], [99.995], [50, 101]):
        with pytest.raises(ValueError):
            fc.check_levels(bad)
    assert fc.quantile_of(95) == pytest.approx(1.959963985)


def test_higher_level_contains_lower(spark):
    train, model = train_of(spark, {"s": simulate(30)}), model_of(spark, {"s": [0, 0, 0.5]})
    rows = fc.forecast(train, model, 4, 1, HOUR, [50, 80, 95]).orderBy("step", "level").collect()
    assert len(rows) == 12
    for a, b in zip(rows, rows[1:]):
        if a.step == b.step:
            assert b.lower < a.lower < a.pred < a.upper < b.upper


def test_horizon_must_be_positive(spark):
    with pytest.raises(ValueError):
        fc.forecast_path(None, 0, 1)


@pytest.mark.parametrize("lam", [0, 0.5, 1, -0.5, 2])
def test_inverse_box_cox(spark, lam):
    values = [0.5, 1.0, 2.0, 7.5]
    scaled = [np.log(v) if lam == 0 else (v**lam - 1) / lam for v in values]
    df = spark.createDataFrame([(float(x),) for x in scaled], "x double")
    got = [r.y for r in df.select(inv_box_cox(F.col("x"), lam).alias("y")).collect()]
    assert got == pytest.approx(values)
    mean = [r.y for r in df.select(inv_box_cox(F.col("x"), lam, F.lit(0.1)).alias("y")).collect()]
    expected = [
        v * (1 + 0.05) if lam == 0 else v * (1 + 0.5 * 0.1 * (1 - lam) / v ** (2 * lam)) for v in values
    ]
    assert mean == pytest.approx(expected)


def test_inverse_box_cox_beyond_the_pole(spark):
    df = spark.createDataFrame([(3.0,)], "x double")
    assert df.select(inv_box_cox(F.col("x"), -0.5).alias("y")).first().y is None


def test_forecast_on_box_cox_scale(spark):
    y = np.exp(simulate(50, ar=(0.5,)) / 10)
    train, model = train_of(spark, {"s": np.log(y)}), model_of(spark, {"s": [0, 0, 0.5]}, 0.01)
    plain = fc.forecast(train, model, 3, 1, HOUR, 95).orderBy("step").collect()
    back = fc.forecast(train, model, 3, 1, HOUR, 95, lam=0, bias_adjust=True).orderBy("step").collect()
    for a, b in zip(plain, back):
        assert (b.lower, b.upper) == pytest.approx((np.exp(a.lower), np.exp(a.upper)))
        assert b.pred == pytest.approx(np.exp(a.pred) * (1 + a.se**2 / 2))


@pytest.mark.parametrize("limit", [0, 100])
@pytest.mark.parametrize("block_rows", [16, 1000])
def test_fitted_values_by_columns_and_by_convolution(spark, monkeypatch, limit, block_rows):
    monkeypatch.setattr(fc, "LAG_COLUMNS", limit)
    y, coef = simulate(100, mean=3), [1.0, 0.02, 0.4, -0.2, 0.1]
    rows = fc.fitted_values(train_of(spark, {"s": y}), model_of(spark, {"s": coef}), 3, block_rows).orderBy("idx").collect()
    assert len(rows) == 100 and [r.fitted for r in rows[:3]] == [None] * 3
    for r in rows[3:]:
        t = r.idx - 1
        expected = 1.0 + 0.02 * r.idx + 0.4 * y[t - 1] - 0.2 * y[t - 2] + 0.1 * y[t - 3]
        assert r.fitted == pytest.approx(expected) and r.residual == pytest.approx(y[t] - expected)


@pytest.mark.parametrize("limit", [0, 100])
def test_a_model_without_coefficients_gives_no_fitted_values(spark, monkeypatch, limit):
    monkeypatch.setattr(fc, "LAG_COLUMNS", limit)
    y = simulate(40)
    models = model_of(spark, {"a": [1.0, 0.0, 0.5], "b": [1.0, 0.0, 0.5]}).selectExpr("series_id", "if(series_id = 'a', coef, null) AS coef")
    rows = fc.fitted_values(train_of(spark, {"a": y, "b": y, "c": y}), models, 1, 16).collect()
    have = {s: sum(r.fitted is not None for r in rows if r.series_id == s) for s in "abc"}
    assert len(rows) == 120 and have == {"a": 39, "b": 0, "c": 0}
    assert all((r.residual is None) == (r.fitted is None) for r in rows)


def test_lag_design(spark):
    rows = fc.lag_design(train_of(spark, {"s": range(6)}), 2, block_rows=3).orderBy("idx").collect()
    assert [r.lags for r in rows] == [None, None, [1.0, 0.0], [2.0, 1.0], [3.0, 2.0], [4.0, 3.0]]


# ---- scores ----------------------------------------------------------------------------------


def scored(spark, rows, level=95.0, scale=2.0):
    forecast = spark.createDataFrame(
        [("s", i + 1, None, level, float(p), float(lo), float(up)) for i, (_, p, lo, up) in enumerate(rows)],
        "series_id string, step int, ts timestamp_ntz, level double, pred double, lower double, upper double",
    )
    test = spark.createDataFrame(
        [("s", i + 1, START, None if y is None else float(y)) for i, (y, *_) in enumerate(rows)],
        "series_id string, step int, ts timestamp_ntz, y double",
    )
    scales = spark.createDataFrame([("s", scale)], "series_id string, scale double")
    return ev.score_steps(forecast, test, scales)


def test_scores_by_hand(spark):
    rows = scored(spark, [(10, 11, 8, 14), (5, 11, 8, 14), (16, 11, 8, 14), (0, 0, -1, 1), (None, 1, 0, 2)])
    out = rows.orderBy("step").collect()
    assert [r.mase for r in out] == pytest.approx([0.5, 3.0, 2.5, 0.0, None])
    assert [r.smape for r in out[:3]] == pytest.approx([200 / 21, 1200 / 16, 1000 / 27])
    assert out[3].smape is None and out[4].msis is None
    assert [r.msis for r in out[:4]] == pytest.approx([3.0, (6 + 40 * 3) / 2, (6 + 40 * 2) / 2, 1.0])
    means = ev.mean_scores(rows).first()
    assert means.mase == pytest.approx(6 / 4) and means.missing == 2


def test_perfect_forecast_and_constant_training(spark):
    perfect = scored(spark, [(10, 10, 9, 11)]).first()
    assert (perfect.mase, perfect.smape, perfect.msis) == (0.0, 0.0, 1.0)
    flat = scored(spark, [(10, 11, 9, 12)], scale=0.0).first()
    assert flat.mase is None and flat.msis is None and flat.smape is not None


@pytest.mark.parametrize("block_rows", [4, 1000])
def test_seasonal_scale(spark, block_rows):
    y = simulate(50)
    scale = ev.seasonal_scale(train_of(spark, {"s": y}), 7, block_rows).first().scale
    assert scale == pytest.approx(np.mean(np.abs(y[7:] - y[:-7])))
