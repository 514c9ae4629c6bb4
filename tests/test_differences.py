"""The distributed choice of differences against the plain numpy computation."""

import numpy as np
import pytest
from helpers import series_frames, simulate

from chunkcast.functions.css import difference_orders, kpss_level, seasonal_strength
from chunkcast.operators import differences as df
from chunkcast.operators import prepare as pr

rng = np.random.default_rng(11)
NOISE = rng.normal(size=900)
SERIES = {
    "noise": NOISE,
    "walk": np.cumsum(NOISE),
    "double": np.cumsum(np.cumsum(NOISE)),
    "season": NOISE + 10 * np.sin(np.arange(900) * 2 * np.pi / 12),
    "odd": NOISE[:800] + np.arange(800) % 7,
    "both": np.cumsum(NOISE) / 5 + 10 * np.sin(np.arange(900) * 2 * np.pi / 12),
    "arma": simulate(700, ar=(0.9,), ma=(0.4,), mean=50),
    "flat": np.full(300, 4.0),
    "short": NOISE[:20],
    "tiny": NOISE[:3],
}


@pytest.fixture(scope="module")
def indexed(spark):
    return pr.index_series(pr.clean(series_frames(spark, SERIES)), 3600).cache()


@pytest.mark.parametrize("m", [1, 7, 12])
@pytest.mark.parametrize("chunks", [1, 3])
@pytest.mark.parametrize("block_rows", [64, 50_000])
def test_choice_equals_the_plain_one(indexed, m, chunks, block_rows):
    got = df.choose_differences(pr.assign_chunks(indexed, chunks), m, 2, 2, block_rows).collect()
    seen = {(r.series_id, r.chunk): (r.d, r.sd) for r in got}
    for name, y in SERIES.items():
        size = max(len(y) // chunks, 1)
        cuts = [y[k * size : (k + 1) * size if k + 1 < chunks else len(y)] for k in range(chunks)]
        assert {k: seen[name, k + 1] for k in range(chunks)} == {k: difference_orders(c, m, 2, 2) for k, c in enumerate(cuts)}


def test_statistics_equal_the_plain_ones(indexed):
    rows = pr.assign_chunks(indexed, 1).selectExpr("series_id", "chunk", "pos AS t", "n", "y")
    for block_rows in (50, 333, 50_000):
        levels = {r.series_id: r.level for r in df.level_statistics(rows, block_rows).collect()}
        strengths = {r.series_id: r.strength for r in df.seasonal_strengths(rows, 12, block_rows).collect()}
        for name, y in SERIES.items():
            if len(y) > 10 and np.ptp(y) > 0:
                assert np.isclose(levels[name], kpss_level(y), rtol=1e-9)
            else:
                assert name not in levels
            assert np.isclose(strengths.get(name, 0.0), seasonal_strength(y, 12), rtol=1e-7, atol=1e-9)


def test_nothing_to_choose_from(spark, indexed):
    none = pr.assign_chunks(indexed.limit(0), 2)
    assert df.choose_differences(none, 12).count() == 0
