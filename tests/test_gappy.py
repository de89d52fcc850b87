"""Frames over rows: the same results wherever chunks are cut and whatever times are missing."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import clean, decompose, features, forecast, profile, reshape, strategy, windows

START = datetime(2024, 1, 1)
DAY = timedelta(days=1)


@pytest.fixture(scope="module")
def gappy(spark):
    """400 hours of two series, a fifth of them missing."""
    dice = random.Random(1)
    rows = [(k, START + timedelta(hours=i), dice.gauss(10, 3)) for k in "ab" for i in range(400) if dice.random() > 0.2]
    return spark.createDataFrame(rows, "key string, ts timestamp_ntz, y double").cache()


JOBS = {
    "sequence": lambda df, n: windows.sequence_windows(df, ["key"], ["y"], "y", 24, chunk_steps=n),
    "encdec": lambda df, n: windows.encdec_windows(df, ["key"], ["y"], "y", 24, 6, chunk_steps=n),
    "volatility": lambda df, n: profile.volatility_rows(df, ["key"], "y", 48, chunk_steps=n),
    "trend": lambda df, n: decompose.trend_split(df, ["key"], "y", chunk_steps=n),
    "difference": lambda df, n: decompose.difference(df, ["key"], "y", d=1, seasonal_d=1, m=8, chunk_steps=n),
    "periods": lambda df, n: decompose.dominant_periods(df, ["key"], "y", 12, chunk_steps=n),
    "stationarity": lambda df, n: forecast.stationarity_stat(df, ["key"], "y", chunk_steps=n),
}


@pytest.mark.parametrize("name", JOBS)
def test_chunks_do_not_change_results(gappy, name):
    def rounded(x):
        return round(x, 9) if isinstance(x, float) else [rounded(v) for v in x] if isinstance(x, (list, tuple)) else x

    got = [sorted((tuple(map(rounded, r)) for r in JOBS[name](gappy, n).collect()), key=repr) for n in (8192, 100, 40)]
    assert got[0] == got[1] == got[2] and got[0]


def test_windows_of_gappy_series_are_complete(gappy):
    n = {r.key: r["count"] for r in gappy.groupBy("key").count().collect()}
    got = windows.sequence_windows(gappy, ["key"], ["y"], "y", 24, chunk_steps=64).groupBy("key").count().collect()
    assert {r.key: r["count"] for r in got} == {k: v - 24 for k, v in n.items()}


def test_grid_frames_fail_on_a_gap(gappy):
    with pytest.raises(Exception, match="not on a full grid"):
        features.lags(gappy, ["key"], ["y"], [1]).collect()


def test_rows_without_a_key_are_kept_by_lookups(spark):
    df = spark.createDataFrame([("a", START, 1.0), ("a", START + DAY, 3.0), (None, START, 2.0)], "key string, ts timestamp_ntz, y double")
    from seriesloom.operators import scale

    bounds = scale.minmax_fit(df.where("key is not null"), ["key"], ["y"])
    got = {(r.key, r.y) for r in scale.minmax_transform(df, bounds, ["key"], ["y"]).collect()}
    assert got == {("a", 0.0), ("a", 1.0), (None, None)}


def test_pivots_without_listed_values(spark):
    rows = [(1, f"v{i}", float(i)) for i in range(300)] + [(2, "v0", None), (2, None, 5.0)]
    df = spark.createDataFrame(rows, "id int, k string, y double")
    wide = reshape.pivot_wide(df, ["id"], "k", ["y"])
    assert len(wide.columns) == 301
    maps = {r.id: r.y for r in reshape.pivot_map(df, ["id"], "k", ["y"]).collect()}
    assert maps[1] == {f"v{i}": float(i) for i in range(300)} and maps[2] == {}


def test_strip_takes_all_white_space(spark):
    df = spark.createDataFrame([("   x y \x1f\n",), (None,)], "k string")
    assert [r.k for r in clean.strip(df, "k").collect()] == ["x y", None]


def test_density_is_that_of_all_kernels(spark):
    dice = random.Random(2)
    rows = [(k, float(dice.randint(-20, 20))) for k in "ab" for _ in range(300)] + [("c", 1.0), (None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "strategy string, pnl double")
    got = strategy.profit_density(df).where("strategy = 'a'").orderBy("grid_id").collect()
    values = [v for k, v in rows if k == "a"]
    mean = sum(values) / 300
    h = (sum((v - mean) ** 2 for v in values) / 299) ** 0.5 * 300**-0.2
    import math

    for r in got[::40]:
        want = sum(math.exp(-(((r.x - v) / h) ** 2) / 2) for v in values) / (300 * h * math.sqrt(2 * math.pi))
        assert abs(r.density - want) < 1e-12
    assert len(got) == 200
    assert strategy.profit_density(df.select(F.lit("z").alias("strategy"), "pnl").limit(1)).count() == 0
