from datetime import datetime

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import clean, reshape
from seriesloom.session import scratch_path
from seriesloom.sources import files


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert [r.x for r in files.nan_to_null(df).collect()] == [None, 1.0]


def test_report_roundtrip_and_file_order(spark, table):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 5), "a", 0.1), (datetime(2024, 1, 2), "b", None)], "ts timestamp_ntz, m string, v double")
    path = scratch_path(spark, "report")
    files.write_report(df.coalesce(1), path)
    back = files.read_report(spark, path, "ts string, m string, v double", ts="ts")
    assert table(back, "ts") == table(df, "ts")
    ordered = files.read_csv(spark, path, "ts string, m string, v double", ordered=True)
    assert [r.m for r in ordered.orderBy("_file", "_line").collect()] == ["a", "b"]


def test_missing_file(spark):
    with pytest.raises(FileNotFoundError):
        files.read_csv(spark, "/tmp/there-is-no-such-file.csv", "a int")


def test_parquet_overwrites(spark):
    path = scratch_path(spark, "table")
    files.write_parquet(spark.range(5), path)
    files.write_parquet(spark.range(3), path)
    assert files.read_parquet(spark, path).count() == 3


def test_normalize_time(spark):
    df = spark.createDataFrame([("2015-01-01 00:00:00+01:00",), ("2015-07-01 00:00:00+02:00",)], "time string")
    got = [r.ts for r in files.normalize_time(df, "time").orderBy("ts").collect()]
    assert got == [datetime(2014, 12, 31, 23), datetime(2015, 6, 30, 22)]


def test_synthetic_results(spark):
    df = files.synthetic_results(spark, 500, seed=3)
    assert df.count() == 500
    first, last = df.agg(F.min("ts"), F.max("ts")).first()
    assert (first, last) == (datetime(2018, 1, 1), datetime(2018, 1, 21, 19))
    assert df.where("upper_bound < lower_bound").count() == 0
    assert df.agg(F.avg("actual")).first()[0] == pytest.approx(60, abs=3)


def test_small_table(spark):
    df = files.small_table(spark, [("a", 1), ("b", None)], "k string, v int")
    assert sorted(map(tuple, df.collect())) == [("a", 1), ("b", None)]


def test_combine_and_drop(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (None, 2.0, 1)], "a double, b double, i int")
    assert [tuple(r) for r in clean.combine_columns(df, "s", ["a", "b"]).orderBy("i").collect()] == [(0, 3.0), (1, None)]
    assert clean.drop_columns(df, ["a"]).columns == ["b", "i"]
    with pytest.raises(ValueError):
        clean.drop_columns(df, ["nope"])


def test_strip_removes_all_white_space(spark):
    df = spark.createDataFrame([(" \t Barcelona\n",)], "c string")
    assert clean.strip(df, "c").first().c == "Barcelona"


def test_dedupe_keeps_the_first_in_order(spark):
    rows = [("x", 2, 20.0, None), ("x", 1, 10.0, None), ("y", 5, None, "t")]
    df = spark.createDataFrame(rows, "k string, line int, v double, note string")
    got = clean.dedupe_first(df, ["k"], ["line"])
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [("x", 1, 10.0, None), ("y", 5, None, "t")]


def test_dedupe_reduces_copies_before_the_shuffle(spark):
    df = spark.range(0, 10000, 1, 4).select((F.col("id") % 2).alias("k"), "id")
    plan = clean.dedupe_first(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_min_by") == 1


def test_nulls_and_slices(spark):
    df = spark.createDataFrame([(datetime(2024, 1, d), v) for d, v in ((1, 1.0), (2, None), (3, 3.0))], "ts timestamp_ntz, v double")
    assert clean.drop_null(df, ["v"]).count() == clean.drop_null_any(df).count() == 2
    assert clean.time_slice(df, datetime(2024, 1, 1), datetime(2024, 1, 2)).count() == 2


def test_features_target_known_before(spark):
    df = spark.createDataFrame([], "ts timestamp_ntz, y double, load double, y_lag_1 double, hour_sin double, is_holiday int")
    assert clean.features_target(df, "y", ["ts"])[0] == ["load", "y_lag_1", "hour_sin", "is_holiday"]
    assert clean.features_target(df, "y", ["ts"], known_before=True)[0] == ["y_lag_1", "hour_sin", "is_holiday"]


def test_pivot_names_and_discovery(spark):
    df = spark.createDataFrame([(1, "b", 1.0, 5), (1, "a", 2.0, 6), (2, "a", 3.0, 7)], "t int, city string, temp double, wind int")
    got = reshape.pivot_wide(df, ["t"], "city", ["temp", "wind"])
    assert got.columns == ["t", "temp_a", "temp_b", "wind_a", "wind_b"]
    assert sorted(map(tuple, got.collect())) == [(1, 2.0, 1.0, 6, 5), (2, 3.0, None, 7, None)]


def test_assemble_keeps_common_times(spark):
    actual = spark.createDataFrame([(t, float(t)) for t in range(6)], "ts int, y double")
    a = spark.createDataFrame([(t, t + 0.5) for t in range(2, 6)], "ts int, y_pred double")
    b = spark.createDataFrame([(t, None if t == 4 else t - 0.5) for t in range(1, 5)], "ts int, y_pred double")
    got = reshape.assemble_predictions(actual, {"a": a, "b": b}, ["ts"])
    assert sorted(map(tuple, got.collect())) == [(2, 2.0, 2.5, 1.5), (3, 3.0, 3.5, 2.5), (4, 4.0, 4.5, None)]


def test_residuals_long(spark):
    df = spark.createDataFrame([(1, 10.0, 11.0, 8.0)], "ts int, y double, a double, b double")
    assert sorted(map(tuple, reshape.residuals_long(df, ["ts"], "y", ["a", "b"]).collect())) == [(1, "a", 1.0), (1, "b", -2.0)]
