import math
from datetime import date, datetime, timedelta
from statistics import stdev

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seriesloom.operators import features, grid, scale, split, windows

HOUR = timedelta(hours=1)


def at(*hm, day=1):
    return datetime(2024, 1, day, *hm)


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame([("k", t, v) for t, v in rows], "key string, ts timestamp_ntz, y double")


def test_grid_is_anchored_at_the_first_time(frame, table):
    df = frame([(at(0, 30), 1.0), (at(1, 30), 2.0), (at(2, 0), 9.0), (at(3, 30), 3.0)])
    got = [(r[1].hour, r[1].minute, r[2]) for r in table(grid.to_grid(df, ["key"]), "ts")]
    assert got == [(0, 30, 1.0), (1, 30, 2.0), (2, 30, None), (3, 30, 3.0)]


def test_duplicate_time_is_an_error(frame):
    df = frame([(at(0), 1.0), (at(0), 2.0)])
    with pytest.raises(PySparkException, match="duplicate time"):
        grid.to_grid(df, ["key"]).collect()


def test_grid_crosses_part_borders(frame, monkeypatch):
    monkeypatch.setattr(grid, "CHUNK_STEPS", 5)
    df = frame([(at(0), 1.0), (at(12), 2.0)])
    got = grid.grid_of(df, ["key"])
    assert got.count() == got.distinct().count() == 13


def test_full_grid_over_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(grid, "CHUNK_STEPS", 5)
    given = {"a": [at(3, 30), at(3, 40), at(4, 30), at(23, 30)], "b": [at(7)], "c": [at(0), at(4), at(5), at(9), at(10)]}
    rows = [(k, t, float(i)) for k, ts in given.items() for i, t in enumerate(ts)] + [(None, at(1), 1.0), ("a", None, 1.0)]
    got = [tuple(r) for r in grid.to_grid(spark.createDataFrame(rows, "key string, ts timestamp_ntz, y double"), ["key"]).collect()]
    known = {(k, t): y for k, t, y in rows}
    spans = {k: [min(ts) + i * HOUR for i in range((max(ts) - min(ts)) // HOUR + 1)] for k, ts in given.items()}
    want = [(k, t, known.get((k, t))) for k, ts in spans.items() for t in ts]
    assert sorted(got, key=lambda r: r[:2]) == want


def test_small_series_are_not_merged_into_one_task(spark):
    rows = [(k, at(h), 1.0) for k in range(40) for h in (0, 9)]
    full = grid.to_grid(spark.createDataFrame(rows, "key int, ts timestamp_ntz, y double"), ["key"], unique=True)
    assert full.select(F.spark_partition_id()).distinct().count() > 1
    assert features.lags(full, ["key"], ["y"], [1]).select(F.spark_partition_id()).distinct().count() > 1


def test_mean_and_deviation_of_columns(spark):
    row = spark.createDataFrame([(1.0, 2.0, 6.5, None)], "a double, b double, c double, d double")
    full, gappy = [F.col(c) for c in "abc"], [F.col(c) for c in "ad"]
    got = row.select(features.mean_of(full), features.deviation_of(full, features.mean_of(full)), features.mean_of(gappy)).first()
    assert got[0] == 9.5 / 3 and math.isclose(got[1], stdev([1.0, 2.0, 6.5])) and got[2] is None


def test_resample_bins(frame, table):
    df = frame([(at(5), 0.0), (at(6), 1.0), (at(7), 2.0), (at(8), 3.0), (at(15), None)])
    got = [(r[1].hour, r[2]) for r in table(grid.resample_mean(df, ["key"], ["y"], "3 hours"), "ts")]
    assert got == [(3, 0.0), (6, 2.0)]


def test_asof_fill(frame, table):
    coarse = frame([(at(3), 1.0), (at(6), 2.0)])
    hours = frame([(at(h), None) for h in range(1, 9)])
    got = [r[2] for r in table(grid.asof_fill(hours, coarse, ["key"], ["y"]), "ts")]
    assert got == [1, 1, 1, 1, 1, 2, 2, 2]


def test_asof_takes_values_from_before_the_first_wanted_time(frame, table):
    coarse = frame([(at(0), 5.0), (at(1), 7.0)])
    hours = frame([(at(3), None), (at(4), None)])
    assert [r[2] for r in table(grid.asof_fill(hours, coarse, ["key"], ["y"]), "ts")] == [7.0, 7.0]


def test_upsample(frame, table):
    got = table(grid.upsample(frame([(at(0), 1.0), (at(3), 2.0)]), ["key"], ["y"]), "ts")
    assert [r[2] for r in got] == [1.0, 1.0, 1.0, 2.0]


def test_outer_join_keeps_both_sides(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "ts int, a double")
    b = spark.createDataFrame([(2, 5.0), (3, 6.0)], "ts int, b double")
    assert sorted(map(tuple, grid.outer_join_time(a, b, ["ts"]).collect())) == [(1, 1.0, None), (2, 2.0, 5.0), (3, None, 6.0)]


def test_holidays_cover_the_whole_day(frame, spark):
    df = frame([(at(23, day=5), 1.0), (at(0, day=6), 1.0), (at(23, day=6), 1.0), (at(0, day=7), 1.0)])
    days = spark.createDataFrame([(date(2024, 1, 6),), (date(2024, 1, 6),)], "day date")
    got = features.holiday_flag(df, days).orderBy("ts").collect()
    assert [r.is_holiday for r in got] == [0, 1, 1, 0]


def test_cyclical(frame):
    row = features.add_cyclical(frame([(datetime(2024, 3, 4, 6), 1.0)])).first()
    assert row.hour_sin == pytest.approx(1.0)
    assert row.day_of_week_sin == 0.0 and row.day_of_week_cos == 1.0
    assert row.month_sin == pytest.approx(math.sin(2 * math.pi * 3 / 12))


def test_rolling_needs_every_value(series, table):
    df = series({"k": [1.0, 2.0, None, 4.0, 5.0, 6.0]})
    got = table(features.rolling(df, ["key"], ["y"], [2]), "ts")
    assert [r[3] for r in got] == [None, None, 1.5, None, None, 4.5]
    assert got[5][4] == pytest.approx(math.sqrt(0.5))


def test_sequence_windows(series, table):
    df = series({"k": [float(i) for i in range(10)], "short": [1.0, 2.0]})
    got = windows.sequence_windows(df, ["key"], ["y"], "y", 4, chunk_steps=3)
    rows = got.orderBy("ts").collect()
    assert len(rows) == 6
    assert [[v.y for v in r.seq] for r in rows][0] == [0, 1, 2, 3]
    assert [r.y for r in rows] == [4, 5, 6, 7, 8, 9]


def test_encdec_windows(series):
    df = series({"k": [float(i) for i in range(12)]})
    rows = windows.encdec_windows(df, ["key"], ["y"], "y", 4, 3, chunk_steps=4).orderBy("ts").collect()
    assert len(rows) == 12 - 4 - 3 + 1
    assert [v.y for v in rows[1].encoder] == [1, 2, 3, 4]
    assert [v.y for v in rows[1].decoder] == [3, 4, 0, 0, 0]
    assert rows[1].target == [5, 6, 7]


def test_window_counts(series):
    df = series({"k": [0.0] * 100, "s": [0.0] * 3})
    got = {r.key: tuple(r)[1:] for r in windows.window_counts(df, ["key"], 20, 4, 16).collect()}
    assert got == {"k": (100, 80, 77, 4), "s": (3, 0, 0, 0)}


def test_split_uses_the_binary_product(series):
    raw = series({"k": [0.0] * 90})
    df = split.chrono_split(raw, ["key"])
    sizes = {r.split: r.n for r in split.split_counts(raw, ["key"]).collect()}
    assert sizes == {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    assert sizes == {"train": 62, "validation": 19, "test": 9}
    assert split.eval_points(df, 4).count() == 5
    assert sum(sizes.values()) == 90


def test_recent_slice(series, table):
    df = series({"k": [float(i) for i in range(20)]})
    assert [r[2] for r in table(split.recent_slice(df, ["key"], 3), "ts")] == [11.0, 12.0, 13.0]
    assert split.recent_slice(df, ["key"], 500).count() == 14


def test_scaling(spark):
    df = spark.createDataFrame([("k", 1, 2.0, 5.0), ("k", 2, 4.0, 5.0), ("k", 3, None, None)], "key string, ts int, a double, b double")
    bounds = scale.minmax_fit(df, ["key"], ["a", "b"])
    small = scale.minmax_transform(df, bounds, ["key"], ["a", "b"])
    assert sorted(map(tuple, small.collect())) == [("k", 1, 0.0, 0.0), ("k", 2, 1.0, 0.0), ("k", 3, None, None)]
    back = scale.minmax_inverse(small, bounds, ["key"], ["a", "b"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    train = scale.minmax_fit(df, ["key"], ["a"], F.col("ts") == 1).first()
    assert (train.lo_a, train.hi_a) == (2.0, 2.0)
    target = scale.inverse_target(scale.scale_target(df, bounds, ["key"], ["b"], "a"), bounds, ["key"], ["b"], "a")
    assert [r.b for r in target.orderBy("ts").collect()] == [5.0, 5.0, None]
