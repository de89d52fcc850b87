"""Lagged sums, window models and per-series autoregressions against plain numpy."""

import math
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import arma, forecast, lagged, scale, split, stacking, window_model

HOUR = timedelta(hours=1)


def wave(n, seed, period=24, level=50.0):
    rng = np.random.default_rng(seed)
    noise = np.convolve(rng.normal(size=n + 5), [1, 0.6, 0.3, 0.2, 0.1, 0.05], "valid")[:n]
    return level + 5 * np.sin(2 * np.pi * np.arange(n) / period) + noise


def values_of(x):
    return [None if v is None or math.isnan(v) else float(v) for v in x]


@pytest.mark.parametrize("size", [8192, 64])
def test_lagged_sums_are_those_of_a_loop(series, size):
    dice = np.random.default_rng(4)
    x = np.where(dice.random(300) < 0.1, np.nan, wave(300, 1) - 50)
    df = series({"k": values_of(x), "short": values_of(x[:7])}).withColumn("z", F.col("y") * F.hour("ts"))
    rows = lagged.number_rows(df, ["key"], ["y", "z"], chunk_steps=size)
    got = {(r.key, r.a, r.b, r.lag): r for r in lagged.lagged_sums(rows, ["key"], ["y", "z"], 40, chunk_steps=size).collect()}
    assert len(got) == 2 * 4 * 41
    for key, n in (("k", 300), ("short", 7)):
        both = np.stack([x[:n], x[:n] * (np.arange(n) % 24)])
        for a in range(2):
            for b in range(2):
                for lag in range(41):
                    u, v = (both[a][lag:], both[b][: n - lag]) if lag < n else (np.zeros(0), np.zeros(0))
                    known = ~np.isnan(u) & ~np.isnan(v)
                    u, v = u[known], v[known]
                    want = [len(u), u.sum(), v.sum(), (u * u).sum(), (v * v).sum(), (u * v).sum()]
                    row = got[key, a, b, lag]
                    assert [row[s] for s in lagged.SUMS] == pytest.approx(want, rel=1e-9, abs=1e-7)


def test_series_without_keys_and_flat_series(series):
    df = series({"k": [0.1] * 90}).drop("key")
    rows = lagged.centred(lagged.number_rows(df, [], ["y"]), [], ["y"], "ts")
    sums = lagged.lagged_sums(rows, [], ["y"], 5, [(0, 0)])
    assert sums.count() == 6


def plain_windows(x, y, length, horizon, ridge):
    """Intercepts and weights from window arrays: x has a column per feature."""
    at = range(length - 1, len(y) - horizon)
    past = np.array([np.concatenate([x[t - length + 1 : t + 1, k][::-1] for k in range(x.shape[1])]) for t in at])
    ahead = np.array([y[t + 1 : t + 1 + horizon] for t in at])
    mx, my = past.mean(0), ahead.mean(0)
    gram = (past - mx).T @ (past - mx) / len(past) + ridge * np.eye(past.shape[1])
    weights = np.linalg.solve(gram, (past - mx).T @ (ahead - my) / len(past)).T
    return my - weights @ mx, weights, past


@pytest.mark.parametrize("length, horizon, size", [(5, 3, 64), (5, 3, 8192), (48, 24, 100), (1, 1, 50)])
def test_window_model_is_the_ridge_of_window_arrays(series, length, horizon, size):
    x = wave(260, 2)
    df = series({"k": values_of(x), "short": values_of(x[: length + horizon])}).withColumn("z", F.hour("ts").cast("double"))
    z = (np.arange(260) % 24).astype(float)
    model = window_model.fit_windows(df, ["key"], ["y", "z"], "y", length, horizon, 0.01, chunk_steps=size)
    row = model.collect()
    assert [r.key for r in row] == ["k"] and row[0].n == 260 - length - horizon + 1
    both = np.stack([x, z], 1)
    bias, weights, past = plain_windows(both, x, length, horizon, 0.01)
    assert np.allclose(row[0].weights, weights, atol=1e-7) and np.allclose(row[0].intercepts, bias, atol=1e-5)
    out = window_model.forecast_windows(df, model, ["key"], ["y", "z"], length, chunk_steps=size).orderBy("ts").collect()
    assert len(out) == 260 - length + 1
    got = np.array([r.forecast for r in out])
    assert np.allclose(got[: len(past)], bias + past @ weights.T, atol=1e-5)


def test_long_windows_forecast_a_day(series):
    """336 rows to 24 steps, better than the value of a day before."""
    x = wave(1500, 3)
    df = series({"k": values_of(x)}).drop("key")
    model = window_model.fit_windows(df.where(F.col("ts") < F.lit("2024-02-20").cast("timestamp_ntz")), [], ["y"], "y", ridge=0.1)
    out = {r.ts: r.forecast for r in window_model.forecast_windows(df, model, [], ["y"]).collect()}
    rows = {r.ts: r.y for r in df.collect()}
    errors, naive = [], []
    for t, f in out.items():
        if t.month == 2 and t.day >= 21 or t.month == 3:
            for h in (1, 12, 24):
                later = t + h * HOUR
                if later in rows:
                    errors.append(abs(f[h - 1] - rows[later]))
                    naive.append(abs(rows[later - timedelta(hours=24)] - rows[later]))
    assert len(errors) > 500 and np.mean(errors) < 0.9 * np.mean(naive)


def test_window_fit_shuffles_no_arrays(series):
    df = series({"k": values_of(wave(120, 5))})
    rows = lagged.number_rows(df, ["key"], ["y"])
    plan = lagged.lagged_sums(rows, ["key"], ["y"], 40)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "array<" not in plan


def lag(x, k):
    return np.concatenate([np.full(min(k, len(x)), np.nan), x[: max(len(x) - k, 0)]])


def plain_arma(y, x, shape, orders):
    """The two-stage fit and its one-step forecasts, with whole arrays; x has a column per exogenous series."""
    def change_of(v):
        for _ in range(shape.d):
            v = v - lag(v, 1)
        for _ in range(shape.seasonal_d):
            v = v - lag(v, shape.m)
        return v

    def fit(columns, w):
        rows = np.column_stack([*columns, w])
        rows = rows[~np.isnan(rows).any(1)]
        return np.linalg.lstsq(rows[:, :-1], rows[:, -1], rcond=None)[0], rows

    w, u = change_of(y), [change_of(c) for c in x.T]
    one = np.ones(len(w))
    e = np.zeros(len(w))
    if shape.shocks:
        first = [one, *[lag(w, k) for k in range(1, shape.long + 1)], *u]
        beta, _ = fit(first, w)
        e = w - np.column_stack(first) @ beta
    terms = [one, *[lag(w, k) for k in range(1, shape.max_p + 1)], *[lag(w, shape.m)] * shape.max_seasonal_p]
    terms += [*[lag(e, k) for k in range(1, shape.max_q + 1)], *[lag(e, shape.m)] * shape.max_seasonal_q, *u]
    _, rows = fit(terms, w)
    best = None
    for order in orders:
        used = shape.used(*order)
        beta = np.linalg.lstsq(rows[:, used], rows[:, -1], rcond=None)[0]
        left = ((rows[:, -1] - rows[:, used] @ beta) ** 2).sum()
        aic = len(rows) * math.log(left / len(rows)) + 2 * (len(used) + 1)
        if best is None or aic < best[0] - 1e-9:
            full = np.zeros(len(terms))
            full[used] = beta
            best = (aic, order, full)
    made = np.column_stack(terms) @ best[2] + (y - w)
    return best, made, w, e, u


def arma_series(n, seed, m=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    shock, w = rng.normal(size=n), np.zeros(n)
    for t in range(2, n):
        w[t] = 0.6 * w[t - 1] - 0.2 * w[t - 2] + shock[t] + 0.4 * shock[t - 1] + 1.5 * x[t]
    return 1000 + np.cumsum(w) * 0.1 + 3 * np.sin(2 * np.pi * np.arange(n) / m), x


@pytest.mark.parametrize("d, seasonal_d, q, size", [(1, 1, 1, 8192), (0, 1, 2, 120), (0, 0, 1, 120), (1, 0, 0, 120)])
def test_arma_is_that_of_whole_arrays(series, d, seasonal_d, q, size):
    y, x = arma_series(400, 7)
    shape = arma.Shape("y", ("x",), d, seasonal_d, 8, 2, q, 1, 0, 10)
    df = series({"k": list(zip(map(float, y), map(float, x)))}, step=timedelta(hours=3), schema="key string, ts timestamp_ntz, v struct<y:double,x:double>").select("key", "ts", "v.*")
    fits = arma.fit_arma(df, ["key"], shape, chunk_steps=size)
    (aic, order, beta), made, *_ = plain_arma(y - y.mean(), (x - x.mean())[:, None], shape, arma.grid_of(shape))
    row = fits.first()
    assert (row.p, row.q, row.seasonal_p, row.seasonal_q) == order and row.aic == pytest.approx(aic, abs=1e-4)
    assert np.allclose(row.coefficients, beta, atol=1e-6)
    got = arma.forecast_next(df, fits, ["key"], shape, chunk_steps=size).orderBy("ts").collect()
    assert [r.y_pred for r in got] == pytest.approx(list(made[~np.isnan(made)] + y.mean()), abs=1e-5)


def test_moving_average_terms_are_recovered(series):
    rng = np.random.default_rng(1)
    e = rng.normal(size=6001)
    df = series({"k": [float(v) for v in 5 + e[1:] + 0.7 * e[:-1]]}, step=timedelta(hours=3))
    shape = arma.Shape("y", (), 0, 0, 8, 0, 1, 0, 0, 20)
    fit = arma.fit_arma(df, ["key"], shape, [(0, 1, 0, 0)], chunk_steps=500).first()
    assert fit.coefficients[1] == pytest.approx(0.7, abs=0.03)


@pytest.mark.parametrize("with_exog", [True, False])
def test_horizon_repeats_its_own_forecasts(series, with_exog):
    y, x = arma_series(260, 9)
    past, horizon = 220, 40
    exog = ("x",) if with_exog else ()
    shape = arma.Shape("y", exog, 1, 1, 8, 2, 1, 1, 1, 10)
    df = series({"k": list(zip(map(float, y), map(float, x)))}, step=timedelta(hours=3), schema="key string, ts timestamp_ntz, v struct<y:double,x:double>").select("key", "ts", "v.*")
    known = df.orderBy("ts").limit(past)
    fits = arma.fit_arma(known, ["key"], shape)
    got = arma.forecast_horizon(known, fits, ["key"], shape, horizon, df).orderBy("ts").collect()
    xs = x[:past, None] if with_exog else np.zeros((past, 0))
    (_, _, beta), _, w, e, _ = plain_arma(y[:past] - y[:past].mean(), xs - (xs.mean(0) if with_exog else 0), shape, arma.grid_of(shape))
    level, w, e = list(y[:past]), list(w), list(e)
    du = x - lag(x, 1)
    du = du - lag(du, 8)
    for t in range(past, past + horizon):
        terms = [1.0, w[t - 1], w[t - 2], w[t - 8], e[t - 1], e[t - 8], *([du[t]] if with_exog else [])]
        w.append(float(np.dot(beta, terms)))
        e.append(0.0)
        level.append(w[t] + level[t - 1] + level[t - 8] - level[t - 9])
    assert [r.horizon for r in got] == list(range(1, horizon + 1))
    assert [r.y_pred for r in got] == pytest.approx(level[past:], abs=1e-4)
    assert [r.ts for r in got] == [r.ts for r in df.orderBy("ts").collect()][past:]


def test_arma_of_series_without_keys_and_short_series(series):
    y, _ = arma_series(120, 3)
    shape = arma.Shape("y", (), 1, 0, 4, 1, 1, 0, 0, 4)
    one = series({"k": [float(v) for v in y]}, step=timedelta(hours=3)).drop("key")
    fits = arma.fit_arma(one, [], shape)
    assert fits.count() == 1
    assert arma.forecast_next(one, fits, [], shape).count() == 120 - shape.reach
    assert arma.forecast_horizon(one, fits, [], shape, 5).count() == 5
    short = series({"a": [1.0, 2.0], "b": [float(v) for v in y]}, step=timedelta(hours=3))
    fits = arma.fit_arma(short, ["key"], shape)
    assert {r.key for r in arma.forecast_horizon(short, fits, ["key"], shape, 3).collect()} == {"b"}


def plain_unit_root(y, max_lags=3):
    dy = np.diff(y)
    best = None
    for k in range(max_lags + 1):
        x = [np.ones(len(dy) - max_lags), y[max_lags:-1], *[dy[max_lags - j : len(dy) - j] for j in range(1, k + 1)]]
        x, t = np.stack(x, 1), dy[max_lags:]
        beta = np.linalg.lstsq(x, t, rcond=None)[0]
        left = ((t - x @ beta) ** 2).sum()
        aic = len(t) * math.log(left / len(t)) + 2 * x.shape[1]
        if best is None or aic < best[0]:
            best = (aic, k, beta[1] / math.sqrt(left / (len(t) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1]))
    return best[1:]


@pytest.mark.parametrize("size", [8192, 60])
def test_series_are_differenced_until_no_unit_root_is_left(series, size):
    rng = np.random.default_rng(2)
    noise = rng.normal(size=300) + 100
    data = {"flow": noise, "stock": np.cumsum(noise - 100), "twice": np.cumsum(np.cumsum(noise - 100)), "flat": np.full(50, 7.0), "line": np.arange(50.0)}
    df = series({k: values_of(v) for k, v in data.items()}, step=timedelta(hours=3))
    orders = arma.difference_order(df, ["key"], "y", chunk_steps=size)
    got = {r.key: r for r in orders.collect()}
    assert {k: r.d for k, r in got.items()} == {"flow": 0, "stock": 1, "twice": 2, "flat": 0, "line": 1}
    assert got["flat"].t_stat is None
    for key, d in (("flow", 0), ("stock", 1), ("twice", 2)):
        lags, t = plain_unit_root(np.diff(data[key], d))
        assert (got[key].lags, got[key].t_stat) == (lags, pytest.approx(t, rel=1e-6))
    made = arma.difference_rounds(df, orders, ["key"], "y", chunk_steps=size)
    for key, d in (("flow", 0), ("stock", 1), ("twice", 2)):
        diff = [r.diff for r in made.where(F.col("key") == key).orderBy("ts").collect()]
        assert diff[:d] == [None] * d and diff[d:] == pytest.approx(list(np.diff(data[key], d)), abs=1e-6)


def test_base_forecasts_have_not_seen_their_own_fold(series):
    """Changing the targets of a fold changes no forecast inside it."""
    y = wave(300, 6)
    df = series({"k": values_of(y)}).withColumns({"x1": F.sin("y"), "x2": F.hour("ts").cast("double")})
    rows = stacking.blocked_folds(df, ["key"], 4)
    fold = np.array([r.fold for r in rows.orderBy("ts").collect()])
    assert sorted(set(fold)) == [-1, 0, 1, 2, 3] and (fold == -1).sum() == 30
    names = ["x1", "x2"]

    def base(r):
        made = stacking.fold_forecasts(r, stacking.fit_folds(r, ["key"], names, "y"), ["key"], names)
        return np.array([v.base for v in made.orderBy("ts").collect()])

    other = rows.withColumn("y", F.when(F.col("fold") == 2, F.col("y") * 3 - 7).otherwise(F.col("y")))
    a, b = base(rows), base(other)
    assert np.allclose(a[fold == 2], b[fold == 2], atol=1e-9) and not np.allclose(a[fold == 1], b[fold == 1], atol=1e-3)
    x = np.column_stack([np.ones(300), np.sin(y), np.arange(300) % 24])
    for f in (0, 3, -1):
        learnt = (fold != f) & (fold >= 0)
        beta = np.linalg.lstsq(x[learnt], y[learnt], rcond=None)[0]
        assert np.allclose(a[fold == f], x[fold == f] @ beta, atol=1e-8)


def test_weights_are_the_best_that_are_not_negative():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 6))
        x = rng.normal(size=(20, n)) @ rng.normal(size=(n, n))
        if rng.random() < 0.3 and n > 1:
            x[:, 1] = x[:, 0]
        y = rng.normal(size=20)
        got = stacking.nonnegative(x.T @ x, x.T @ y)
        assert (got >= 0).all()
        best = np.inf
        for bits in range(2**n):
            used = [j for j in range(n) if bits >> j & 1]
            beta = np.linalg.lstsq(x[:, used], y, rcond=None)[0] if used else np.zeros(0)
            if (beta >= -1e-12).all():
                best = min(best, ((y - x[:, used] @ beta) ** 2).sum())
        assert ((y - x @ got) ** 2).sum() == pytest.approx(best, abs=1e-8)


def test_scale_counts_for_meta_weights(series):
    """Weights learnt on scaled values, met with forecasts on another scale, give another mix."""
    y = wave(400, 8)
    df = series({"k": values_of(y)}).withColumns({"a": F.col("y") * 0.5 + 3 * F.sin(F.hour("ts")), "b": F.col("y") + 5})
    rows = split.chrono_split(df, ["key"])
    made = stacking.nonnegative_meta(rows, ["key"], "y", ["a", "b"]).orderBy("ts").collect()
    assert np.allclose([r.meta for r in made], y, atol=1e-6)
    bounds = scale.minmax_fit(rows, ["key"], ["y"], F.col("split") == "train")
    small = scale.scale_target(rows, bounds, ["key"], ["y", "a", "b"], "y")
    weights = stacking.fit_nonnegative(small, ["key"], "y", ["a", "b"], F.col("split") == "validation").first()
    raw = [weights.intercept + weights.w_a * r.a + weights.w_b * r.b for r in made]
    assert not np.allclose(raw, y, atol=1e-2)


def test_permuted_values_are_each_used_once(series):
    df = series({"k": [float(i) for i in range(100)], "j": [float(i) for i in range(7919)]})
    for key, n in (("k", 100), ("j", 7919)):
        rows = stacking.permuted(df.where(F.col("key") == key), ["key"], ["y"]).collect()
        assert sorted(r.permuted_y for r in rows) == [float(i) for i in range(n)]
        assert sum(r.y == r.permuted_y for r in rows) < n / 10


def test_worth_finds_the_column_that_matters(series):
    df = series({"k": values_of(wave(300, 4))}).withColumns({"x1": F.col("y") * 2, "x2": F.sin(F.hour("ts"))})
    got = stacking.permutation_importance(df, ["key"], ["x1", "x2"], "y", lambda d: d.withColumn("y_pred", F.col("x1") / 2)).collect()
    assert [r.feature for r in got] == ["x1", "x2"] and got[0].importance > 1 and got[1].importance == pytest.approx(0)


def test_draws_are_residuals(series):
    y = wave(200, 5)
    df = series({"k": values_of(y), "none": [None] * 5}).withColumn("p", F.coalesce("y", F.lit(0.0)) + F.sin(F.hour("ts")))
    index = forecast.residual_index(df, ["key"], "y", "p", chunk_steps=50)
    got = forecast.residual_draws(df, index, ["key"], "p", 20).join(df, ["key", "ts"]).collect()
    assert len(got) == 200 * 20 and {r.key for r in got} == {"k"}
    residuals = np.array([r.residual for r in index.collect()])
    drawn = np.array([r.value - r.p for r in got])
    assert np.abs(drawn[:, None] - residuals[None, :]).min(1).max() < 1e-9
    assert drawn.mean() == pytest.approx(residuals.mean(), abs=0.05) and len(np.unique(drawn.round(9))) > 20


def test_timed_models_run_once(spark, series):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = series({"k": [float(i) for i in range(50)]})
    model = lambda rows: rows.mapInPandas(count, rows.schema).withColumnRenamed("y", "y_pred")
    table, latency = forecast.score_models(df, {"same": model}, ["key", "ts"], "y", timed=True)
    assert table.count() == 50 and table.where("same <> y").isEmpty()
    row = latency.first()
    assert seen.value == 50 and row.n == 50 and row.ms_per_prediction > 0
