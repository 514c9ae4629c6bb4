import numpy as np
import pytest
from helpers import forecast_loop, series_frame, series_frames, simulate

from chunkcast.config import ForecastConfig, SearchOptions
from chunkcast.operators import evaluate as ev
from chunkcast.operators import prepare as pr
from chunkcast.plans import catalogue
from chunkcast.plans import runs
from chunkcast.sources import sinks

HOUR = 3600
SMALL = ForecastConfig(
    period=12, tol=30, chunks=3, h=12, levels=(80, 95), order=(1, 0, 1), search=SearchOptions(allow_drift=False)
)


@pytest.fixture(scope="module")
def named():
    return {s: simulate(400, ar=(0.6,), ma=(0.2,), mean=20, seed=k) for k, s in enumerate(("a", "b"))}


@pytest.fixture(scope="module")
def run(spark, named):
    return runs.run_forecast(series_frames(spark, named), SMALL)


def test_run_tables(run, named):
    local = {(r.series_id, r.chunk): r for r in run.local.collect()}
    assert len(local) == 6 and all(r.status == "ok" and len(r.coef) == 32 for r in local.values())
    model = {r.series_id: r for r in run.model.collect()}
    for s, y in named.items():
        w = np.array([local[s, k].n_k / local[s, k].sigma2 for k in (1, 2, 3)])
        c = np.array([local[s, k].coef for k in (1, 2, 3)])
        assert model[s].coef == pytest.approx(w @ c / w.sum())
        pred = {r.step: r.pred for r in run.forecast.collect() if r.series_id == s and r.level == 95}
        assert [pred[i] for i in range(1, 13)] == pytest.approx(forecast_loop(y[:-12], model[s].coef, 12))
    assert run.scores.count() == 2 * 2 * 12
    assert run.coefficients.count() == 2 * 32
    summary = run.summary.orderBy("series_id").first()
    assert (summary.sample_size, summary.sample_size_per_chunk, summary.chunks, summary.n_par) == (388, 129, 3, 32)
    assert summary.failed_chunks == 0 and summary.seconds_fit > 0


def test_bundle_reads_back(spark, run, tmp_path):
    run.write(str(tmp_path))
    for name in ("coefficients", "forecast", "scores", "summary"):
        table = getattr(run, name)
        assert sorted(map(str, spark.read.parquet(f"{tmp_path}/{name}").collect())) == sorted(map(str, table.collect()))
    sinks.write_coefficients_csv(run.model, str(tmp_path / "coef_csv"))
    sinks.write_forecast_csv(run.forecast, str(tmp_path / "forecast_csv"))
    coefs = spark.read.option("header", True).csv(str(tmp_path / "coef_csv"))
    assert coefs.columns == ["series_id", "pos", "theta", "sigma2"] and coefs.count() == 64
    back = spark.read.option("header", True).csv(str(tmp_path / "forecast_csv"))
    assert back.count() == 48 and {"pred", "lower", "upper", "level", "ts"} <= set(back.columns)


def test_separate_holdout(spark, named):
    y = named["a"]
    run = runs.run_forecast(series_frame(spark, y[:-12], "a"), SMALL, series_frame(spark, y[-12:], "a"))
    rows = run.scores.filter("level = 95").orderBy("step").collect()
    assert [r.y for r in rows] == pytest.approx(y[-12:])
    assert ev.unmatched_steps(run.forecast, pr.index_holdout(series_frame(spark, y[-12:], "a"), HOUR)).first()[1:] == (0, 0)


def test_whole_series_run_equals_one_chunk(spark, named):
    train = pr.index_series(series_frame(spark, named["a"], "a"), HOUR)
    whole = runs.forecast_whole_series(train, SMALL).filter("level = 95").orderBy("step").collect()
    local = runs.fit_chunks(train, ForecastConfig(**{**SMALL.__dict__, "chunks": 1})).first()
    assert [r.pred for r in whole] == pytest.approx(forecast_loop(named["a"], local.coef, 12))


def test_distributed_whole_series_run(spark, named):
    train = pr.index_series(series_frame(spark, named["a"], "a"), HOUR)
    one_task = runs.forecast_whole_series(train, SMALL).filter("level = 95").orderBy("step").collect()
    by_blocks = runs.forecast_whole_series(train, SMALL, distributed=True).filter("level = 95").orderBy("step").collect()
    assert [r.pred for r in by_blocks] == pytest.approx([r.pred for r in one_task], abs=1e-2)


def test_chunked_and_whole_forecasts_are_close(spark):
    y = simulate(3000, ar=(0.6,), mean=20)
    train = pr.index_series(series_frame(spark, y, "a"), HOUR)
    one = {r.step: r.pred for r in runs.forecast_whole_series(train, SMALL).filter("level = 95").collect()}
    run = runs.run_forecast(series_frame(spark, y, "a"), SMALL, series_frame(spark, y[:12], "a"))
    many = {r.step: r.pred for r in run.forecast.filter("level = 95").collect()}
    assert all(abs(one[k] - many[k]) < 0.5 for k in one)


def test_settings_are_checked():
    for bad in ({"h": 0}, {"period": 0}, {"tol": 0}, {"chunks": 0}):
        with pytest.raises(ValueError):
            ForecastConfig(**bad)
    with pytest.raises(ValueError):
        SearchOptions(max_p=-1)


# ---- plans -----------------------------------------------------------------------------------


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ar1_local", "dlsa_weighted", "score_steps", "mean_scores", "fitted_residuals", "flagship"])
def test_no_cross_joins(spark, sf_dir, name):
    plan = physical(catalogue.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_are_pruned_and_filtered(spark, sf_dir):
    plan = physical(catalogue.ar1_local(spark, sf_dir))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan
    assert "IsNotNull(ts)" in plan


def test_windows_never_span_a_whole_series_of_rows(spark, sf_dir):
    """Row windows are partitioned by a time cell or block besides the series."""
    plan = physical(catalogue.ar1_local(spark, sf_dir))
    rows = [line for line in plan.splitlines() if " Window [" in line and ("row_number" in line or "lag(" in line)]
    assert rows and all("_cell" in line or "_block" in line for line in rows)


def test_fit_has_a_task_per_hash_of_chunk(spark, sf_dir):
    plan = physical(catalogue.sarima_css(spark, sf_dir))
    assert "hashpartitioning(series_id" in plan and "REPARTITION_BY_NUM" in plan
    after = plan.split("FlatMapGroupsInPandas")[1]
    assert after.index("REPARTITION_BY_NUM") < after.index("ENSURE_REQUIREMENTS")
