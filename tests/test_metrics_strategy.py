import math
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import intervals, metrics, profile, reshape, strategy


@pytest.fixture(scope="module")
def predictions(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(200):
        y = float(rng.normal(50, 10))
        rows.append((datetime(2024, 1, 1) + timedelta(hours=i), y, y + float(rng.normal(0, 2)), y - float(rng.normal(1, 3))))
    return spark.createDataFrame(rows, "ts timestamp_ntz, y double, a double, b double").cache()


def test_scoreboard(predictions):
    pdf = predictions.toPandas()
    got = {r.model: r for r in metrics.scoreboard(reshape.predictions_long(predictions, ["ts"], "y", ["a", "b"])).collect()}
    for m in ("a", "b"):
        e = pdf[m] - pdf["y"]
        assert got[m].n == 200
        assert got[m].mae == pytest.approx(e.abs().mean())
        assert got[m].rmse == pytest.approx(math.sqrt((e**2).mean()))
        assert got[m].smape == pytest.approx((2 * e.abs() / (pdf[m].abs() + pdf["y"].abs())).mean() * 100)


def test_smape_skips_zero_against_zero(spark):
    df = spark.createDataFrame([("m", 0.0, 0.0), ("m", 1.0, 3.0)], "model string, y_true double, y_pred double")
    row = metrics.scoreboard(df).first()
    assert (row.smape, row.mae) == (100.0, 1.0)


def test_error_corr_and_lookup(predictions, spark):
    errors = reshape.residuals(predictions, "y", ["a", "b"])
    pdf = errors.toPandas()
    got = {(r.a, r.b): r.r for r in metrics.error_corr(errors, ["a", "b"]).collect()}
    assert got[("a", "b")] == got[("b", "a")] == pytest.approx(np.corrcoef(pdf.a, pdf.b)[0, 1])
    assert got[("a", "a")] == 1.0
    scores = metrics.scoreboard(reshape.predictions_long(predictions, ["ts"], "y", ["a", "b"]))
    old = spark.createDataFrame([("a", 0.5)], "model string, ms_per_prediction double")
    assert {r.model: r.ms_per_prediction for r in metrics.latency_tradeoff(scores, old).collect()} == {"a": 0.5, "b": None}


def test_box_stats(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(datetime(2024, 1, d + 1, 5), "m", v) for d, v in enumerate(values)], "ts timestamp_ntz, model string, error double")
    row = metrics.error_by_hour(df).first()
    assert (row.hour, row.p25, row.p50, row.p75) == (5, 2.0, 3.0, 4.0)
    assert (row.whisker_low, row.whisker_high, row.outliers, row.n) == (1.0, 4.0, 1, 5)


def test_interval_metrics_count_absent_bounds_as_misses(spark):
    rows = [(1.0, 1.0, 2.0), (3.0, 1.0, 2.0), (1.5, None, 2.0), (2.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "y double, lo double, hi double")
    row = intervals.interval_metrics(df, [], "y", "lo", "hi").first()
    assert (row.n, row.picp, row.mpiw) == (4, 50.0, 1.0)
    got = intervals.calibration(df, "y", {"band": ("lo", "hi", 0.9)}).first()
    assert tuple(got) == ("band", 0.9, 0.5)


def test_crps_equals_the_pair_form(spark):
    rng = np.random.default_rng(2)
    rows, want = [], []
    for i in range(20):
        xs, y = rng.normal(size=50), float(rng.normal())
        want.append(np.abs(xs - y).mean() - np.abs(xs[:, None] - xs[None, :]).mean() / 2)
        rows.append((y, [float(x) for x in xs]))
    df = spark.createDataFrame(rows, "y_true double, samples array<double>")
    assert intervals.crps(df, []).first().crps == pytest.approx(np.mean(want))
    bounds = intervals.sample_bounds(df.limit(1)).first()
    assert (bounds.lower, bounds.upper) == pytest.approx(tuple(np.percentile(rows[0][1], [5, 95])))


def test_uncertainty_split(spark):
    means, sigmas = [1.0, 2.0, 4.0], [0.1, 0.2, 0.3]
    df = spark.createDataFrame([(means, sigmas, 10.0)], "means array<double>, sigmas array<double>, data_range double")
    row = intervals.uncertainty_split(df).first()
    assert row.epistemic == pytest.approx(np.std(means))
    assert row.aleatoric == pytest.approx(math.sqrt(np.mean(np.square(sigmas))) * 10)
    assert row.total == pytest.approx(math.hypot(row.epistemic, row.aleatoric))


def test_gauss_density_integrates_to_one(spark):
    df = spark.createDataFrame([(50.0, 51.0, 2.0)], "y double, mean double, total double")
    rows = intervals.gauss_density(df, "y").orderBy("grid_id").collect()
    xs, pdf = [r.x for r in rows], [r.pdf for r in rows]
    assert (len(xs), xs[0], xs[-1]) == (1000, 20.0, pytest.approx(80.0))
    assert np.trapezoid(pdf, xs) == pytest.approx(1.0, abs=1e-6)
    share = np.trapezoid([p for p, r in zip(pdf, rows) if r.inside], [r.x for r in rows if r.inside])
    assert share == pytest.approx(0.95, abs=0.01)


def test_samples_array(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 1, 3.0)], "ts int, sample_id int, value double")
    assert sorted(intervals.samples_array(df, ["ts"]).first().samples) == [2.0, 3.0]


def day_rows(day, values, start=0):
    return [(datetime(2024, 1, day, h + start), *v) for h, v in enumerate(values)]


def test_daily_pnl_ties_nulls_and_short_days(spark):
    forecast = [1.0, 3.0, 3.0, 1.0] + [2.0] * 20
    actual = [10.0, 20.0, 90.0, 5.0] + [15.0] * 20
    rows = day_rows(1, zip(actual, forecast)) + day_rows(2, zip(actual[:23], forecast[:23]))
    df = spark.createDataFrame(rows, "ts timestamp_ntz, y double, f double").withColumn("blank", F.lit(None).cast("double"))
    got = strategy.daily_pnl(df, (), "y", {"oracle": ("y", "y"), "naive": ("f", "f"), "blank": ("blank", "f")}).collect()
    assert [tuple(r) for r in got] == [(date(2024, 1, 1), 85.0, 10.0, None)]
    partly = df.withColumn("f", F.when(F.hour("ts") == 0, None).otherwise(F.col("f")))
    assert strategy.daily_pnl(partly, (), "y", {"naive": ("f", "f")}).first().naive == 20.0 - 5.0


def pnl_frame(spark, values, name="s"):
    rows = [(name, date(2024, 1, 1) + timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "strategy string, day date, pnl double")


@pytest.mark.parametrize(
    "values, drawdowns",
    [([-1.0, 2.0, -5.0], [0.0, 0.0, -5.0]), ([0.0, -2.0, -5.0], [None, None, None])],
)
def test_drawdown_signs(spark, values, drawdowns):
    curve = strategy.drawdown(strategy.equity_curve(pnl_frame(spark, values), ()))
    assert [r.drawdown for r in curve.orderBy("day").collect()] == drawdowns


def test_pnl_summary(spark):
    values = [3.0, -1.0, 2.0, -4.0, 6.0, 1.0]
    row = strategy.pnl_summary(pnl_frame(spark, values), ()).first()
    losses = [v for v in values if v < 0]
    assert (row.days, row.total_profit, row.final_equity) == (6, 7.0, 7.0)
    assert row.sharpe == pytest.approx(np.mean(values) / np.std(values, ddof=1) * math.sqrt(365))
    assert row.sortino == pytest.approx(np.mean(values) / np.std(losses, ddof=1) * math.sqrt(365))
    assert row.max_drawdown == pytest.approx(-100.0)


def test_pnl_summary_special_cases(spark):
    flat = strategy.pnl_summary(pnl_frame(spark, [2.0, 2.0, 2.0]), ()).first()
    assert (flat.sharpe, flat.sortino, flat.max_drawdown, flat.total_profit) == (0.0, 0.0, 0.0, 6.0)
    one_loss = strategy.pnl_summary(pnl_frame(spark, [2.0, -1.0, 3.0]), ()).first()
    assert one_loss.sortino == float("inf")


def test_rolling_sharpe(spark):
    values = [float((i * 7) % 11) - 4 for i in range(40)]
    df = pnl_frame(spark, values, "a").unionByName(pnl_frame(spark, values, "oracle"))
    rows = strategy.rolling_sharpe(df, (), rows=30, chunk_steps=8).orderBy("day").collect()
    got = [r.rolling_sharpe for r in rows]
    assert {r.strategy for r in rows} == {"a"} and got[:29] == [None] * 29
    last = values[-30:]
    assert got[-1] == pytest.approx(np.mean(last) / np.std(last, ddof=1) * math.sqrt(365))


def test_oracle_is_never_beaten(spark):
    rng = np.random.default_rng(8)
    rows = [r for d in range(1, 8) for r in day_rows(d, [(float(rng.normal()), float(rng.normal())) for _ in range(24)])]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, y double, f double")
    pnl = strategy.daily_pnl(df, (), "y", {"oracle": ("y", "y"), "naive": ("f", "f")})
    assert pnl.where("naive > oracle").count() == 0


def test_density_integrates_to_one(spark):
    rng = np.random.default_rng(1)
    df = pnl_frame(spark, [float(v) for v in rng.normal(5, 3, 80)])
    rows = strategy.profit_density(df).orderBy("grid_id").collect()
    assert np.trapezoid([r.density for r in rows], [r.x for r in rows]) == pytest.approx(1.0, abs=0.01)


def test_describe_and_profile(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 1, 1, h), float(h), None if h else 3.0) for h in range(5)], "ts timestamp_ntz, a double, b double"
    ).withColumn("blank", F.lit(None).cast("double"))
    got = {r.column: r for r in profile.describe_long(df, ["a", "b", "blank"]).collect()}
    assert (got["a"]["count"], got["a"].mean, got["a"].p25, got["a"].max) == (5, 2.0, 1.0, 4.0)
    assert (got["b"]["count"], got["b"].p50) == (1, 3.0)
    assert (got["blank"]["count"], got["blank"].p50) == (0, None)
    p = profile.dataset_profile(df).first()
    assert (p.n_rows, p.n_columns, p.n_cells, p.n_nulls, p.n_blank_columns, p.hours) == (5, 4, 20, 9, 1, 4.0)


def test_volatility(spark, series):
    values = [float((i * i) % 17) for i in range(400)]
    df = series({"k": values})
    rows = profile.volatility_rows(df, ["key"], "y", rows=168).orderBy("ts").collect()
    assert rows[166].volatility is None
    assert rows[300].volatility == pytest.approx(np.std(values[133:301], ddof=1))
    timed = profile.volatility_time(df, ["key"], "y").orderBy("ts").collect()
    assert timed[0].volatility is None
    assert timed[300].volatility == pytest.approx(np.std(values[133:301], ddof=1))
    full = profile.volatility_rows(df, ["key"], "y", rows=168)
    week = profile.volatile_week(full, ["key"])
    peak = profile.argmax_time(full, ["key"], "volatility").first().peak
    first, last = week.agg(F.min("ts"), F.max("ts")).first()
    assert first == peak - timedelta(days=3) and last == min(peak + timedelta(days=4), rows[-1].ts)
