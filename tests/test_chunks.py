"""Chunked windows and two-level prefixes give what one window per series gives."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesloom.operators import chunks, features

HOUR = timedelta(hours=1)


def wave(n, seed, gaps=0.15):
    rng = random.Random(seed)
    return [None if rng.random() < gaps else round(rng.uniform(-50, 50), 2) for _ in range(n)]


@pytest.fixture(scope="module")
def frame(series):
    return series({"a": wave(300, 1), "b": wave(77, 2), "c": wave(5, 3)}).cache()


@pytest.mark.parametrize("size", [7, 25, 64])
def test_bounded_window_equals_unchunked(frame, table, size):
    chunked = features.lag_roll_features(frame, ["key"], ["y"], [1, 24], [6], chunk_steps=size)
    w = Window.partitionBy("key").orderBy("ts")
    plain = frame.withColumns(features.lag_columns(w, "y", [1, 24]) | features.roll_columns(w, "y", [6]))
    got, want = table(chunked, "key", "ts"), table(plain, "key", "ts")
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:2] == b[:2]
        assert a[2:] == pytest.approx(b[2:], abs=1e-9)


def test_forward_frames_reach_into_the_next_chunk(frame, table):
    def build(spec):
        return {"ahead": F.lead("y", 3).over(spec)}

    got = chunks.grid_window(frame, ["key"], "ts", HOUR, 0, 3, build, chunk_steps=5)
    want = frame.withColumn("ahead", F.lead("y", 3).over(Window.partitionBy("key").orderBy("ts")))
    assert table(got, "key", "ts") == table(want, "key", "ts")


@pytest.mark.parametrize("size", [4, 1000])
def test_position(frame, table, size):
    kept = frame.dropna(subset=["y"])
    got = chunks.with_position(kept, ["key"], "ts", HOUR, chunk_steps=size)
    w = Window.partitionBy("key")
    want = kept.withColumn("position", (F.row_number().over(w.orderBy("ts")) - 1).cast("bigint")).withColumn(
        "n_rows", F.count(F.lit(1)).over(w)
    )
    columns = ["key", "ts", "y", "position", "n_rows"]
    assert table(got.select(*columns), "key", "ts") == table(want.select(*columns), "key", "ts")


@pytest.mark.parametrize("size", [3, 1000])
def test_running_totals(frame, table, size):
    got = chunks.running_totals(frame, ["key"], "ts", "y", step=HOUR, chunk_steps=size)
    sums = Window.partitionBy("key").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    want = frame.withColumn("equity", F.sum("y").over(sums)).withColumn("running_max", F.max("equity").over(sums))
    blank = F.col("y").isNull()
    want = want.withColumns({c: F.when(~blank, F.col(c)) for c in ("equity", "running_max")})
    for a, b in zip(table(got, "key", "ts"), table(want, "key", "ts")):
        assert a[:2] == b[:2]
        assert a[3:] == pytest.approx(b[3:], abs=1e-9)


@pytest.mark.parametrize("size", [3, 1000])
def test_fill_gaps(series, table, size):
    df = series({"a": [None, None, 1.0, None, None, None, None, 2.0, None], "b": [None, None]})
    got = chunks.fill_gaps(df, ["key"], "ts", ["y"], HOUR, chunk_steps=size)
    assert [r[2] for r in table(got, "key", "ts")] == [1.0] * 7 + [2.0] * 2 + [None, None]


def test_one_long_series_is_spread_over_tasks(spark, series):
    df = series({"a": [float(i) for i in range(4000)]})
    got = features.lags(df, ["key"], ["y"], [1], chunk_steps=100)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = got.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 1


def test_join_per_key_finds_every_row(frame, spark):
    info = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    got = chunks.join_per_key(frame, info, ["key"], "ts")
    assert got.count() == frame.count()
    assert {(r.key, r.v) for r in got.collect()} == {("a", 1), ("b", 2), ("c", None)}
