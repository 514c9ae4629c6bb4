"""Automatic orders from block sums against the fit that holds a whole chunk."""

import numpy as np
import pytest
from helpers import series_frames, simulate

from chunkcast.config import ForecastConfig, SearchOptions
from chunkcast.operators import prepare as pr
from chunkcast.operators.local_sarima import fit_sarima
from chunkcast.operators.whole_search import fit_automatic
from chunkcast.plans import runs

SERIES = {
    "arma": simulate(900, ar=(0.6,), ma=(0.4,), mean=20),
    "walk": np.cumsum(simulate(800, ma=(0.5,), seed=3)),
    "season": simulate(960, ar=(0.5,), mean=5, seed=4) + 6 * np.sin(np.arange(960) * 2 * np.pi / 12),
    "flat": np.full(200, 3.0),
    "tiny": np.arange(3.0),
}
SEARCH = SearchOptions(max_p=1, max_q=1, max_P=1, max_Q=1, max_order=3)


@pytest.fixture(scope="module")
def indexed(spark):
    return pr.index_series(pr.clean(series_frames(spark, SERIES)), 3600).cache()


@pytest.fixture(scope="module")
def whole(indexed):
    config = ForecastConfig(period=12, search=SEARCH)
    return {(r.series_id, r.chunk): r for r in fit_sarima(pr.assign_chunks(indexed, 2), config).collect()}


def test_all_candidates_give_the_choice_of_the_whole_chunk(indexed, whole):
    config = ForecastConfig(period=12, search=SEARCH)
    got = fit_automatic(pr.assign_chunks(indexed, 2), config, tol=300, best=99, block_rows=150, tolerance=1e-10)
    rows = {(r.series_id, r.chunk): r for r in got.collect()}
    assert set(rows) == set(whole)
    for key, r in rows.items():
        w = whole[key]
        if w.sigma2 is None or w.status != "ok" or r.status != "ok":
            continue
        assert (r.n_k, r.start, r.d, r.sd) == (w.n_k, w.start, w.d, w.sd)
        assert abs(r.aicc - w.aicc) < 0.05 + 1e-3 * abs(w.aicc)
        assert np.isclose(r.sigma2, w.sigma2, rtol=5e-3)
    assert sum(rows[k].status == "ok" and rows[k][4:10] == whole[k][4:10] for k in rows) >= 5
    assert {rows["flat", 1].status, rows["tiny", 1].status} <= {"no_candidate", "too_short", "ok"} and rows["flat", 1].sigma2 is None


def test_the_few_best_are_no_worse_than_the_best_ranked(indexed):
    chunked = pr.assign_chunks(indexed, 2)
    approximate = ForecastConfig(period=12, search=SearchOptions(**{**SEARCH.__dict__, "approximation": True}))
    ranked = {(r.series_id, r.chunk): r for r in fit_sarima(chunked, approximate).collect()}
    compared = 0
    for r in fit_automatic(chunked, ForecastConfig(period=12, search=SEARCH), tol=300).collect():
        w = ranked[r.series_id, r.chunk]
        if w.status == "ok" and r.status == "ok" and w.aicc is not None:
            assert r.aicc <= w.aicc + 0.5
            compared += 1
    assert compared >= 5


def test_distributed_forecast_finds_its_order(spark):
    train = pr.index_series(pr.clean(series_frames(spark, {"arma": SERIES["arma"]})), 3600)
    config = ForecastConfig(period=1, tol=100, h=5, search=SearchOptions(max_p=2, max_q=1))
    own = [r.pred for r in runs.forecast_whole_series(train, config, distributed=True).orderBy("step").collect()]
    held = [r.pred for r in runs.forecast_whole_series(train, config).orderBy("step").collect()]
    assert len(own) == 5 and np.allclose(own, held, atol=0.15)
