import datetime as dt

import pytest
from helpers import START, series_frame, series_frames
from pyspark.sql import functions as F

from chunkcast.operators import prepare as pr
from chunkcast.session import shared_dir
from chunkcast.sources import series as src
from chunkcast.sources import sinks

HOUR = 3600


def positions(df):
    return {(r.series_id, r.ts, r.y): r.idx for r in df.collect()}


def test_clean_drops_incomplete_rows(spark):
    rows = [("s", START, 1.0), ("s", None, 2.0), ("s", START, None), ("s", START, float("nan"))]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double")
    assert [r.y for r in pr.clean(df).collect()] == [1.0]


@pytest.mark.parametrize("cell_rows", [1, 7, 50_000])
def test_index_is_contiguous_for_any_cell_length(spark, cell_rows):
    df = series_frames(spark, {"a": range(100), "b": range(33)}).repartition(5)
    rows = pr.index_series(df, HOUR, cell_rows).collect()
    for name, n in (("a", 100), ("b", 33)):
        mine = sorted((r.idx, r.y, r.n) for r in rows if r.series_id == name)
        assert mine == [(i + 1, float(i), n) for i in range(n)]


def test_range_index_agrees_and_keeps_copies(spark):
    rows = [("hot", START, float(i % 3)) for i in range(60)]
    rows += [("hot", START + dt.timedelta(hours=i), float(i)) for i in range(1, 20)]
    rows += [("cold", START + dt.timedelta(hours=i), float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double").repartition(4)
    got = pr.index_series_by_range(df, 5).collect()
    assert len(got) == len(rows)
    assert sorted(r.idx for r in got if r.series_id == "hot") == list(range(1, 80))
    in_order = sorted((r for r in got if r.series_id == "hot"), key=lambda r: r.idx)
    assert [r.ts for r in in_order] == sorted(r.ts for r in in_order)
    unique = df.dropDuplicates(["series_id", "ts"])
    assert positions(pr.index_series_by_range(unique, 3)) == positions(pr.index_series(unique, HOUR, 4))


def test_equal_times_are_ranked_by_value(spark):
    rows = [("s", START, y) for y in (3.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double")
    assert {r.y: r.idx for r in pr.index_series(df, HOUR).collect()} == {1.0: 1, 2.0: 2, 3.0: 3}


@pytest.mark.parametrize("n,k", [(1000, 10), (1003, 10), (7, 3), (3, 10), (1, 1)])
def test_chunks_cover_the_series(spark, n, k):
    chunked = pr.assign_chunks(pr.index_series(series_frame(spark, range(n)), HOUR), k)
    counts = {r.chunk: r.n_k for r in pr.chunk_counts(chunked).collect()}
    size = max(n // k, 1)
    assert sum(counts.values()) == n
    assert set(counts) == set(range(1, min(n, k) + 1))
    assert all(v == size for c, v in counts.items() if c < k)
    per_chunk = chunked.groupBy("chunk").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("c"))
    assert all(r.lo == 1 and r.hi == r.c for r in per_chunk.collect())


def test_chunk_length_limit_raises_the_number_of_chunks(spark):
    chunked = pr.assign_chunks(pr.index_series(series_frame(spark, range(1000)), HOUR), 2, max_chunk_rows=100)
    assert sorted(r.n_k for r in pr.chunk_counts(chunked).collect()) == [100] * 10


def test_holdout_split(spark):
    split = pr.split_holdout(pr.index_series(series_frame(spark, range(10)), HOUR), 3)
    assert sorted((r.step, r.y) for r in pr.test_rows(split).collect()) == [(1, 7.0), (2, 8.0), (3, 9.0)]
    train = pr.train_rows(split).collect()
    assert len(train) == 7 and {r.n for r in train} == {7}
    with pytest.raises(ValueError):
        pr.split_holdout(split, 0)


def test_separate_holdout_keeps_null_steps(spark):
    held = pr.index_holdout(series_frame(spark, [5.0, None, 7.0]), HOUR)
    assert sorted((r.step, r.y) for r in held.collect()) == [(1, 5.0), (2, None), (3, 7.0)]


@pytest.mark.parametrize("cell_rows", [2, 1000])
def test_gap_filling(spark, cell_rows):
    df = series_frame(spark, range(12)).filter("y not in (3, 4, 9)")
    filled = sorted(pr.fill_gaps(df, HOUR, cell_rows).collect(), key=lambda r: r.ts)
    assert [r.y for r in filled] == [None if i in (3, 4, 9) else float(i) for i in range(12)]


def test_series_from_rows_does_not_depend_on_session_zone(spark, sf_dir):
    def grouped():
        return sorted(map(tuple, src.hourly_events(spark, sf_dir).collect()))

    first = grouped()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert grouped() == first
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_csv_round_trip(spark, tmp_path):
    split = pr.split_holdout(pr.index_series(series_frames(spark, {"a": range(10), "b": range(20)}), HOUR), 4)
    sinks.write_series_csv(split, str(tmp_path / "out"))
    back = src.read_series_csv(spark, str(tmp_path / "out/series_id=a/split=train"), "a")
    assert sorted(map(tuple, back.collect())) == sorted(
        (r.series_id, r.ts, r.y) for r in pr.train_rows(split).collect() if r.series_id == "a"
    )


def test_zone_files(spark, tmp_path):
    (tmp_path / "EAST_train.csv").write_text("demand,time\n1.5,2020-01-01 00:00:00\n,2020-01-01 01:00:00\n")
    (tmp_path / "EAST_test.csv").write_text("demand,time\n2.5,2020-01-01 02:00:00\n")
    (tmp_path / "notes_other.csv").write_text("x\n1\n")
    rows = src.read_zone_csvs(spark, str(tmp_path)).collect()
    assert sorted((r.series_id, r.split, r.y) for r in rows if r.y is not None) == [
        ("EAST", "test", 2.5), ("EAST", "train", 1.5)
    ]
    assert len(rows) == 3


def test_unreadable_time_is_an_error(spark, tmp_path):
    (tmp_path / "x.csv").write_text("demand,time\n1.5,yesterday\n")
    with pytest.raises(Exception, match="CAST"):
        src.read_series_csv(spark, str(tmp_path / "x.csv"), "x").collect()


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
