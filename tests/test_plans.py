"""The chains from raw tables to reports, and the driver contract."""

import glob
import os
from datetime import date, datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from seriesloom.plans import evaluate, preprocess
from seriesloom.session import scratch_path
from seriesloom.sources import files

DATA = "/root/testdata/sf0.001"


def raw_tables(spark):
    """A small energy table with a missing hour and gaps, and weather rows with repeats."""
    energy, weather = [], []
    start = datetime(2015, 1, 1)
    for h in range(240):
        if h == 50:
            continue
        text = (start + timedelta(hours=h)).strftime("%Y-%m-%d %H:%M:%S+01:00")
        load = None if h in (200, 201) else 100.0 + h % 24
        energy.append((text, 40.0 + h % 24, load, 5.0, 7.0, *[0.0] * len(preprocess.UNUSED_ENERGY)))
        for city in (" Barcelona", "Madrid"):
            weather.append((text, city, 280.0 + h % 24, 1.0))
            if h % 40 == 0:
                weather.append((text, city, -1.0, -1.0))
    names = ["time", *preprocess.LAGGED, *preprocess.FOSSIL_PARTS, *preprocess.UNUSED_ENERGY]
    e = spark.createDataFrame(energy, ", ".join(f"`{n}` {'string' if n == 'time' else 'double'}" for n in names))
    w = spark.createDataFrame(weather, "time string, city_name string, temp double, wind double")
    w = w.withColumns({c: F.lit("x") for c in preprocess.UNUSED_WEATHER})
    return e, w.withColumn("_line", F.monotonically_increasing_id())


def test_prepare(spark):
    energy, weather = raw_tables(spark)
    energy = files.normalize_time(energy, "time")
    weather = files.normalize_time(weather, "time")
    calendar = spark.createDataFrame([(date(2015, 1, 9),)], "day date")
    out = preprocess.prepare(energy, weather, calendar, order=["_line"])
    rows = {r.ts: r for r in out.collect()}
    assert out.where(" or ".join(f"`{c}` is null" for c in out.columns)).count() == 0
    assert {"temp_Barcelona", "wind_Madrid", "generation_fossil_total", "price actual_lag_168"} <= set(out.columns)
    assert not set(preprocess.UNUSED_ENERGY) & set(out.columns)
    first, last = min(rows), max(rows)
    # Hour 50 has no price, so the row a week after it has no lag and is left out.
    assert first == datetime(2015, 1, 7, 23) and last == datetime(2015, 1, 10, 22)
    assert len(rows) == 240 - 168 - 1
    assert rows[last].generation_fossil_total == pytest.approx(12.0)
    assert min(r.temp_Madrid for r in rows.values()) > 0
    assert rows[datetime(2015, 1, 9, 5)].is_holiday == 1.0 and rows[first].is_holiday == 0.0


def test_evaluate_writes_every_table(spark):
    rows = []
    for h in range(240):
        y = 50.0 + 10 * ((h * 7) % 24) / 24
        rows.append((datetime(2024, 1, 1) + timedelta(hours=h), y, y + 1, y - 2, y - 3, y + 3, [y - 1, y, y + 1]))
    df = spark.createDataFrame(
        rows, "ts timestamp_ntz, y double, a double, b double, lo double, hi double, draws array<double>"
    )
    tables = evaluate.evaluate(
        df, "y", ["a", "b"], {"a": ("lo", "hi", 0.9)}, {"oracle": ("y", "y"), "naive": ("a", "a")}, samples={"a": "draws"}
    )
    point = {r.model: r for r in tables["point_metrics"].collect()}
    assert (point["a"].mae, point["b"].mae) == (pytest.approx(1.0), pytest.approx(2.0))
    band = tables["interval_metrics"].first()
    assert (band.picp, band.mpiw, band.n) == (100.0, pytest.approx(6.0), 240)
    assert band.crps == pytest.approx(2 / 3 - 4 / 9)
    assert tables["daily_pnl"].count() == 10
    folder = scratch_path(spark, "reports")
    evaluate.write_reports(tables, folder)
    assert {os.path.basename(p) for p in glob.glob(f"{folder}/*")} == set(tables)


def test_contract():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) >= 70


def test_entry(spark):
    assert contract.entry(spark).count() == 5


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    yield connection
    connection.close()


SAMPLE = ["dedupe_first", "pivot_wide", "hourly_grid", "processed_features", "scoreboard", "crps", "daily_pnl",
          "pnl_summary", "error_quartiles", "decompose_hourly", "rescaled_meta", "knn_impute"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, db, name):
    """A sample; ``tools/check_oracle.py`` compares all of them."""
    df = contract.queries()[name](spark, DATA)
    result = db.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in result.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in sorted(names)) for r in df.collect()), key=repr)
    assert got == want and got
