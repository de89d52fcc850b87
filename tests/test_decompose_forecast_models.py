import math
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import decompose, forecast, models, split, windows

HOUR = timedelta(hours=1)


def seasonal(n, period, noise=0.0, seed=0, slope=0.01):
    rng = np.random.default_rng(seed)
    return [slope * i + 5 * math.sin(2 * math.pi * i / period) + float(rng.normal(0, noise)) if noise else slope * i + 5 * math.sin(2 * math.pi * i / period) for i in range(n)]


@pytest.mark.parametrize("period, size", [(7, 20), (8, 1000)])
def test_decompose(series, period, size):
    values = seasonal(60, period, 0.5, 3)
    df = series({"k": values, "short": values[:10]})
    rows = decompose.seasonal_decompose(df, ["key"], "y", period, step=HOUR, chunk_steps=size).orderBy("key", "ts").collect()
    k = [r for r in rows if r.key == "k"]
    weights = np.ones(period) / period if period % 2 else np.array([0.5, *[1.0] * (period - 1), 0.5]) / period
    half = period // 2
    trend = np.convolve(values, weights, "valid")
    assert [r.trend for r in k[:half]] == [None] * half and [r.trend for r in k[-half:]] == [None] * half
    assert [r.trend for r in k[half:-half]] == pytest.approx(list(trend))
    assert sum(r.seasonal for r in k[:period]) == pytest.approx(0.0, abs=1e-9)
    assert all(r.trend + r.seasonal + r.resid == pytest.approx(r.y) for r in k[half:-half])
    assert {r.trend for r in rows if r.key == "short"} == {None}


def test_trend_split_uses_what_there_is_at_the_ends(series):
    values = [1.0, 2.0, 3.0, 4.0, 5.0]
    rows = decompose.trend_split(series({"k": values}), ["key"], "y", 3, chunk_steps=2).orderBy("ts").collect()
    assert [r.trend for r in rows] == [1.5, 2.0, 3.0, 4.0, 4.5]
    assert all(r.trend + r.seasonal == pytest.approx(r.y) for r in rows)


def test_periods_find_the_season(series):
    df = series({"k": seasonal(300, 12, slope=0.0)})
    rows = decompose.dominant_periods(df, ["key"], "y", 30).orderBy("rank").collect()
    assert len(rows) == int(math.log(30))
    assert {rows[0].lag, rows[1].lag} == {12, 24}
    assert sum(r.weight for r in rows) == pytest.approx(1.0)
    weights = decompose.dominant_periods(df, ["key"], "y", 30).select("key", "lag", "weight")
    out = decompose.delay_aggregate(df, ["key"], "y", weights).orderBy("ts").collect()
    deepest = max(r.lag for r in rows)
    assert out[deepest - 1].delayed is None and out[deepest].delayed is not None
    want = sum(r.weight * out[100 - r.lag].y for r in rows)
    assert out[100].delayed == pytest.approx(want)


def test_difference(series):
    values = [float(v) for v in np.random.default_rng(1).normal(size=40)]
    assert decompose.difference_weights(1, 1, 8) == {0: 1, 1: -1, 8: -1, 9: 1}
    df = series({"k": values}, step=timedelta(hours=3))
    got = [r.diff for r in decompose.difference(df, ["key"], "y", d=1, seasonal_d=1, m=8).orderBy("ts").collect()]
    want = np.diff(np.array(values[8:]) - np.array(values[:-8]))
    assert got[:9] == [None] * 9 and got[9:] == pytest.approx(list(want))


def test_seasonal_naive(series):
    df = series({"k": [float(i) for i in range(20)]}, step=timedelta(hours=3))
    rows = forecast.seasonal_naive(df, ["key"], "y", m=4).orderBy("ts").collect()
    assert [r.y_pred for r in rows] == [10.0, 11.0, 12.0, 13.0, 10.0, 11.0]
    assert [r.horizon for r in rows] == [1, 2, 3, 4, 5, 6]


@pytest.fixture(scope="module")
def base(series):
    rng = np.random.default_rng(9)
    y = np.cumsum(rng.normal(size=400)) + 50
    df = series({"k": [float(v) for v in y]})
    good, bad = F.col("y") + F.sin(F.hour("ts")), F.col("y") + 4 * F.cos(F.hour("ts"))
    return split.chrono_split(df.withColumns({"good": good, "bad": bad}), ["key"]).cache()


def test_bands_do_not_cross_and_cover(base):
    rows = forecast.quantile_bands(base, ["key"], "y", "bad").collect()
    assert len(rows) == 40
    assert all(r.p10 <= r.p50 <= r.p90 for r in rows)


def test_samples_repeat_and_follow_the_residuals(base):
    train = base.where("split = 'train'")
    curves = forecast.residual_curve(train, ["key"], "y", "bad")
    test = base.where("split = 'test'")
    a = forecast.predictive_samples(test, curves, ["key"], "bad").orderBy("ts").collect()
    b = forecast.predictive_samples(test.repartition(7), curves, ["key"], "bad").orderBy("ts").collect()
    assert [r.samples for r in a] == [r.samples for r in b]
    drawn = np.array([[s - r.bad for s in r.samples] for r in a]).ravel()
    residual = np.array([r.y - r.bad for r in train.collect()])
    assert drawn.min() >= residual.min() - 1e-9 and drawn.max() <= residual.max() + 1e-9
    assert np.median(drawn) == pytest.approx(np.median(residual), abs=0.4)


def test_blend_prefers_the_better_model(base):
    weights = forecast.fit_blend(base, ["key"], "y", ["good", "bad"])
    w = weights.first()
    assert w.w_good + w.w_bad == pytest.approx(1.0) and w.w_good > 0.7
    plain = forecast.blend(base, weights, ["key"], ["good", "bad"]).orderBy("ts").collect()
    scaled = forecast.rescaled_blend(base, ["key"], "y", ["good", "bad"]).orderBy("ts").collect()
    assert [r.blend for r in scaled] == pytest.approx([r.blend for r in plain])


def test_stationarity_stat(series):
    rng = np.random.default_rng(3)
    noise = rng.normal(size=200)
    df = series({"noise": [float(v) for v in noise], "walk": [float(v) for v in np.cumsum(noise)]})
    got = {r.key: r for r in forecast.stationarity_stat(df, ["key"], "y").collect()}
    x, dy = noise[:-1], np.diff(noise)
    beta, cov = np.polyfit(x, dy, 1, cov=True)
    assert got["noise"].n == 199
    assert got["noise"].t_stat == pytest.approx(beta[0] / math.sqrt(cov[0, 0]))
    assert got["noise"].t_stat < -8 < -3 < got["walk"].t_stat


def test_series_that_never_change(series):
    df = series({"flat": [3.0] * 60})
    assert forecast.stationarity_stat(df, ["key"], "y").first().t_stat is None
    assert decompose.dominant_periods(df, ["key"], "y", 10).count() == 0


def test_rank_features(spark):
    df = spark.createDataFrame([(float(i), float(i) + (i % 3), float(-i), 1.0) for i in range(30)], "y double, near double, exact double, flat double")
    rows = forecast.rank_features(df, ["near", "exact", "flat"], "y", n=2).collect()
    assert [(r.rank, r.feature) for r in rows] == [(1, "exact"), (2, "near")]


def test_score_models_times_every_model(base):
    rows = base.select("key", "ts", "y")
    registry = {"same": lambda df: df.withColumnRenamed("y", "y_pred"), "half": lambda df: df.select("key", "ts", (F.col("y") / 2).alias("y_pred"))}
    table, latency = forecast.score_models(rows, registry, ["key", "ts"], "y", timed=True)
    assert table.count() == 400 and table.where("same != y or half != y / 2").count() == 0
    assert {r.model for r in latency.collect()} == {"same", "half"}


def test_window_ridge_and_encdec_steps(series):
    df = series({"k": seasonal(200, 12, slope=0.0)})
    rows = windows.encdec_windows(df, ["key"], ["y"], "y", 24, 3)
    fitted = models.fit_window(rows, "encoder", ["y"], "target", steps=(1, 3))
    for h, model in fitted.items():
        out = models.score_window(model, rows.withColumn("want", F.get("target", F.lit(h - 1))), "encoder", ["y"], ["want"])
        assert out.agg(F.avg(F.abs(F.col("want") - F.col("y_pred")))).first()[0] < 0.2


def test_stack_beats_its_parts(base):
    out = models.fit_stack(base, ["key"], "y", ["good", "bad"]).where("split = 'test'")
    errors = out.agg(*[F.avg(F.abs(F.col(c) - F.col("y"))).alias(c) for c in ("good", "bad", "stack")]).first()
    assert errors.stack < errors.good < errors.bad


def test_trees_beat_a_constant(spark, base):
    rows = base.withColumns({"x1": F.col("y") + F.sin("position"), "x2": F.cos("position")})
    model = models.fit_point(rows, ["x1", "x2"], "y", rounds=10, depth=3, rate=0.3)
    known = rows.where("split = 'validation'")
    scored = models.score(model, known, ["x1", "x2"], ["ts", "y"])
    mean = rows.where("split = 'train'").agg(F.avg("y")).first()[0]
    mae, flat = scored.agg(F.avg(F.abs(F.col("y") - F.col("y_pred"))), F.avg(F.abs(F.col("y") - mean))).first()
    assert mae < flat
    top = models.feature_importance(model, ["x1", "x2"], 1, spark).first()
    assert (top.rank, top.feature) == (1, "x1")
