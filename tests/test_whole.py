import numpy as np
import pytest
from helpers import series_frames, simulate

from chunkcast.functions.css import Order, fit_css
from chunkcast.operators import combine as cb
from chunkcast.operators import expand as ex
from chunkcast.operators import prepare as pr
from chunkcast.operators.whole_sarima import fit_whole_sarima

HOUR = 3600


@pytest.mark.parametrize(
    "order,integrate",
    [(Order(1, 0, 1, 1, 0, 0, 12), 0), (Order(1, 1, 1, 0, 0, 0, 1, True, True), 1)],
)
def test_blocks_give_the_fit_of_the_whole_series(spark, order, integrate):
    named = {
        "a": simulate(3000, ar=(0.6,), ma=(0.3,), sar=(0.4,) if order.sp else (), m=12, mean=10),
        "b": simulate(2500, ar=(0.2,), ma=(-0.4,), mean=5, seed=7),
        "tiny": np.arange(4.0),
    }
    if integrate:
        named = {s: np.cumsum(y) for s, y in named.items()}
    train = pr.index_series(series_frames(spark, named), HOUR)
    models = fit_whole_sarima(train, order, tol=150, start_rows=300, block_rows=700)
    got = {r.series_id: r for r in models.collect()}
    for s in ("a", "b"):
        expected = fit_css(named[s], order)
        for part in ("ar", "ma", "sar", "sma"):
            assert getattr(got[s], part) == pytest.approx(expected[part], abs=2e-3)
        assert got[s].sigma2 == pytest.approx(expected["sigma2"], rel=1e-4)
        assert got[s].status == "ok"
        constant = "drift" if integrate else "mean"
        assert getattr(got[s], constant) == pytest.approx(expected[constant], abs=2e-2)
    assert got["tiny"].status == "too_short" and got["tiny"].sigma2 is None
    model = cb.combine(ex.expand_models(models, 50)).collect()
    assert sorted(r.series_id for r in model) == ["a", "b"] and all(len(r.coef) == 52 for r in model)


def test_a_flat_head_does_not_lose_the_series(spark):
    order = Order(1, 0, 1, 0, 0, 0, 1, True)
    lively = simulate(3000, ar=(0.6,), ma=(0.3,), mean=10)
    named = {"late": np.r_[np.full(400, 10.0), lively], "flat": np.full(900, 3.0), "plain": lively}
    train = pr.index_series(series_frames(spark, named), HOUR)
    got = {r.series_id: r for r in fit_whole_sarima(train, order, tol=150, start_rows=300, block_rows=700).collect()}
    expected = fit_css(named["late"], order)
    assert got["late"].status == got["plain"].status == "ok"
    assert got["late"].ar == pytest.approx(expected["ar"], abs=2e-3) and got["late"].ma == pytest.approx(expected["ma"], abs=2e-3)
    assert got["late"].sigma2 == pytest.approx(expected["sigma2"], rel=1e-4)
    assert got["flat"].sigma2 is None
