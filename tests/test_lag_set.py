"""Autoregressions on a set of lags against plain least squares."""

import numpy as np
import pytest

from chunkcast.operators import combine as cb
from chunkcast.operators import prepare as pr
from chunkcast.operators.lag_set import fit_lag_set
from chunkcast.operators.local_ar import fit_local_ar
from helpers import series_frame, simulate


def chunked(spark, values, k):
    return pr.assign_chunks(pr.index_series(series_frame(spark, values), 3600), k)


def plain(values, lags):
    """Coefficients, error sum and number of rows by a loop over complete rows."""
    rows = [(1.0, *(values[t - k] for k in lags), values[t]) for t in range(max(lags), len(values))]
    rows = np.array([r for r in rows if None not in r], dtype=float)
    beta = np.linalg.lstsq(rows[:, :-1], rows[:, -1], rcond=None)[0]
    return beta, float(((rows[:, -1] - rows[:, :-1] @ beta) ** 2).sum()), len(rows)


@pytest.mark.parametrize("lags", [[1], [1, 24, 25], [24, 1, 1], list(range(1, 31))])
@pytest.mark.parametrize("block_rows", [40, 50_000])
def test_equals_least_squares(spark, lags, block_rows):
    y = simulate(900, ar=(0.5,), sar=(0.3,), m=24, mean=1000).tolist()
    lags_once = sorted(set(lags))
    for r in fit_lag_set(chunked(spark, y, 3), lags, block_rows).collect():
        part = y[(r.chunk - 1) * 300 : r.chunk * 300]
        beta, sse, n = plain(part, lags_once)
        assert np.allclose(np.array(r.coef)[[0, *(k + 1 for k in lags_once)]], beta, rtol=1e-6, atol=1e-8)
        assert sum(x != 0 for x in r.coef[1:]) == len(lags_once)
        assert r.sigma2 == pytest.approx(sse / (300 - len(lags_once) - 1))
        assert (r.start, r.n_k, r.n_eff, r.status) == ((r.chunk - 1) * 300 + 1, 300, n, "ok")


def test_missing_values_are_left_out(spark):
    y = [None if t % 7 == 3 or 50 <= t < 60 else v for t, v in enumerate(simulate(400, ar=(0.6,), mean=5).tolist())]
    y[100] = float("nan")
    clean = [None if v is not None and v != v else v for v in y]
    for r in fit_lag_set(chunked(spark, y, 2), [1, 4], block_rows=30).collect():
        part = clean[(r.chunk - 1) * 200 : r.chunk * 200]
        beta, sse, n = plain(part, [1, 4])
        seen = sum(v is not None for v in part)
        assert np.allclose([r.coef[0], r.coef[2], r.coef[5]], beta, atol=1e-8)
        assert (r.n_k, r.n_eff) == (seen, n)
        assert r.sigma2 == pytest.approx(sse / (seen - 3))


def test_agrees_with_the_plain_fit_and_combines(spark):
    rows = chunked(spark, simulate(500, ar=(0.4, 0.2), mean=3), 4)
    one, other = cb.combine(fit_lag_set(rows, [1, 2])).first(), cb.combine(fit_local_ar(rows, 2)).first()
    assert np.allclose(one.coef, other.coef, atol=1e-10)
    assert one.sigma2 == pytest.approx(other.sigma2)


def test_unusable_chunks_keep_a_row(spark):
    assert [r.status for r in fit_lag_set(chunked(spark, [1.0, 2.0, 3.0], 1), [1, 24]).collect()] == ["too_short"]
    assert [r.status for r in fit_lag_set(chunked(spark, [5.0] * 60, 1), [1, 24]).collect()] == ["singular"]
    assert [r.status for r in fit_lag_set(chunked(spark, [None] * 60, 1), [1]).collect()] == ["too_short"]
    assert fit_lag_set(chunked(spark, [1.0], 1).where("false"), [1]).count() == 0
    with pytest.raises(ValueError):
        fit_lag_set(chunked(spark, [1.0], 1), [0])
