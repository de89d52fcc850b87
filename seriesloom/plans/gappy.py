"""Queries over series with missing hours, cut into chunks of 100 steps, and their SQL.

Frames count rows, so a result must not depend on where chunks are cut or which times are missing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.operators import decompose, features, forecast, grid, impute, profile, scale, split, windows
from seriesloom.plans import panels
from seriesloom.plans.oracle import ORACLE as FITTED
from seriesloom.plans.oracle import TYPED, hourly, r, rolled, shown
from seriesloom.plans.panels import TYPES, USERS
from seriesloom.plans.queries import KT, Query, _array_sum, _out

CHUNK = 100
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def windows_gappy(spark, folder):
    rows = windows.sequence_windows(panels.hourly_mean(spark, folder), TYPES, ["y"], "y", 24, chunk_steps=CHUNK)
    return _out(rows.withColumn("total", _array_sum("seq", "y")), KT, ["y", "total"])


@query
def encdec_gappy(spark, folder):
    rows = windows.encdec_windows(panels.hourly_mean(spark, folder), TYPES, ["y"], "y", 48, 12, chunk_steps=CHUNK)
    shown = {"encoder_total": _array_sum("encoder", "y"), "decoder_first": F.col("decoder")[0]["y"], "target_total": _array_sum("target")}
    return _out(rows.withColumns(shown), KT, list(shown))


@query
def volatility_gappy(spark, folder):
    return _out(profile.volatility_rows(panels.hourly_mean(spark, folder), TYPES, "y", 48, chunk_steps=CHUNK), KT, ["volatility"])


@query
def trend_gappy(spark, folder):
    return _out(decompose.trend_split(panels.hourly_mean(spark, folder), TYPES, "y", chunk_steps=CHUNK), KT, ["trend", "seasonal"])


@query
def diff_gappy(spark, folder):
    rows = decompose.difference(panels.hourly_mean(spark, folder), TYPES, "y", d=1, seasonal_d=1, m=8, chunk_steps=CHUNK)
    return _out(rows, KT, ["diff"])


@query
def acf_gappy(spark, folder):
    rows = decompose.dominant_periods(panels.hourly_mean(spark, folder), TYPES, "y", 24, chunk_steps=CHUNK)
    return _out(rows, [*TYPES, "rank", "lag"], ["r", "weight"])


@query
def delay_gappy(spark, folder):
    means = panels.hourly_mean(spark, folder)
    weights = means.select(*TYPES).distinct().select(*TYPES, F.explode(F.lit([3, 24])).alias("lag")).withColumn("weight", F.col("lag") / 27)
    return _out(decompose.delay_aggregate(means, TYPES, "y", weights, chunk_steps=CHUNK), KT, ["delayed"])


@query
def df_stat_gappy(spark, folder):
    """Users' hours with events only: most hours are missing."""
    rows = forecast.stationarity_stat(panels.hourly_mean(spark, folder, USERS), USERS, "y", chunk_steps=CHUNK)
    return _out(rows, [*USERS, "n"], ["slope", "t_stat"])


@query
def lags_chunked(spark, folder):
    """Lags and rolling values of the full grid, in chunks of 200 steps."""
    rows = features.lag_roll_features(panels.hourly_dense(spark, folder), TYPES, ["y"], (1, 168), (24,), chunk_steps=200)
    return _out(rows, KT, ["y_lag_1", "y_lag_168", "y_roll_mean_24", "y_roll_std_24"])


@query
def upsample_hours(spark, folder):
    """3-hour means of the gappy series, repeated hour by hour."""
    coarse = grid.resample_mean(panels.hourly_mean(spark, folder), TYPES, ["y"], "3 hours")
    return _out(grid.upsample(coarse, TYPES, ["y"]), KT, ["y"])


@query
def minmax_cells(spark, folder):
    """The scaled values themselves, by bounds of the first 70% of each series."""
    rows = split.chrono_split(panels.hourly_mean(spark, folder), TYPES, chunk_steps=CHUNK)
    bounds = scale.minmax_fit(rows, TYPES, ["y"], F.col("split") == "train")
    return _out(scale.minmax_transform(rows, bounds, TYPES, ["y"], "ts"), [*KT, "split"], ["y"])


@query
def knn_blocks(spark, folder):
    """Imputation with blocks of 64 donors, so that every series has many cells and blocks."""
    rows = features.lags(panels.hourly_gappy(spark, folder).drop("n"), TYPES, ["y"], [1, 24])
    rows = features.add_cyclical(rows, parts=("hour",))
    names = ["y", "y_lag_1", "y_lag_24", "hour_sin", "hour_cos"]
    return _out(impute.knn_impute(rows, TYPES, names, block_rows=64), KT, ["y", "y_lag_1", "y_lag_24"])


_SRC = f"WITH {hourly()}, src AS (SELECT event_type, ts, total / n AS y FROM hourly)"
_ROWS = "PARTITION BY event_type ORDER BY ts"

ORACLE = {
    "knn_blocks": FITTED["knn_impute"],
    "windows_gappy": f"""{_SRC}, w AS (SELECT *, sum(y) OVER f AS total, count(y) OVER f AS c FROM src
    WINDOW f AS ({_ROWS} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT {TYPED}, {shown(['y', 'total'])} FROM w WHERE c = 24""",
    "encdec_gappy": f"""{_SRC}, w AS (SELECT *, lag(y, 23) OVER ({_ROWS}) AS decoder_first, sum(y) OVER e AS encoder_total,
    count(y) OVER e AS ne, sum(y) OVER t AS target_total, count(y) OVER t AS nt FROM src
    WINDOW e AS ({_ROWS} ROWS BETWEEN 47 PRECEDING AND CURRENT ROW), t AS ({_ROWS} ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING))
SELECT {TYPED}, {shown(['encoder_total', 'decoder_first', 'target_total'])} FROM w WHERE ne = 48 AND nt = 12""",
    "volatility_gappy": f"{_SRC} SELECT {TYPED}, {r(rolled('y', 'stddev_samp', -47, 0))} AS volatility FROM src",
    "trend_gappy": f"""{_SRC}, t AS (SELECT *, avg(y) OVER ({_ROWS} ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS trend FROM src)
SELECT {TYPED}, {r('trend')} AS trend, {r('y - trend')} AS seasonal FROM t""",
    "diff_gappy": f"""{_SRC} SELECT {TYPED}, {r('y - lag(y, 1) OVER w - lag(y, 8) OVER w + lag(y, 9) OVER w')} AS diff
FROM src WINDOW w AS ({_ROWS})""",
    "acf_gappy": f"""{_SRC}, num AS (SELECT *, row_number() OVER ({_ROWS}) AS i FROM src),
acf AS (SELECT a.event_type, l.lag, corr(a.y, b.y) AS r FROM num a, (SELECT unnest(range(1, 25))::INTEGER AS lag) l, num b
    WHERE a.event_type = b.event_type AND b.i = a.i - l.lag GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY r DESC, lag) AS rank FROM acf),
top AS (SELECT event_type, rank, lag, r, exp(r) / sum(exp(r)) OVER (PARTITION BY event_type) AS weight FROM ranked WHERE rank <= 3)
SELECT event_type, CAST(rank AS INTEGER) AS rank, lag, {shown(['r', 'weight'])} FROM top""",
    "delay_gappy": f"""{_SRC} SELECT {TYPED}, {r('lag(y, 3) OVER w * 3 / 27 + lag(y, 24) OVER w * 24 / 27')} AS delayed
FROM src WINDOW w AS ({_ROWS})""",
    "df_stat_gappy": f"""WITH {hourly('user_id')}, src AS (SELECT user_id, ts, total / n AS y FROM hourly),
d AS (SELECT user_id, y - lag(y) OVER w AS dy, lag(y) OVER w AS b FROM src WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, regr_count(dy, b) AS n, regr_slope(dy, b) AS slope, regr_sxx(dy, b) AS sxx, regr_syy(dy, b) AS syy, regr_sxy(dy, b) AS sxy FROM d GROUP BY 1)
SELECT user_id, CAST(n AS BIGINT) AS n, {r('CASE WHEN sxx > 0 THEN sxy / sxx END')} AS slope,
    {r('CASE WHEN sxx > 0 AND n > 2 AND syy - sxy * sxy / sxx > 0 THEN slope / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) END')} AS t_stat FROM s""",
    "lags_chunked": f"""WITH {hourly()} SELECT {TYPED}, {r('lag(y, 1) OVER w')} AS y_lag_1, {r('lag(y, 168) OVER w')} AS y_lag_168,
    {r(rolled('y', 'avg', -24, -1))} AS y_roll_mean_24, {r(rolled('y', 'stddev_samp', -24, -1))} AS y_roll_std_24
FROM dense WINDOW w AS ({_ROWS})""",
    "upsample_hours": f"""{_SRC}, coarse AS (SELECT event_type, time_bucket(INTERVAL '3 hours', ts) AS ts, avg(y) AS y FROM src GROUP BY 1, 2),
span AS (SELECT event_type, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM coarse GROUP BY 1)
SELECT s.event_type, s.ts, {r('c.y')} AS y FROM span s ASOF LEFT JOIN coarse c ON s.event_type = c.event_type AND s.ts >= c.ts""",
    "minmax_cells": f"""{_SRC}, num AS (SELECT *, row_number() OVER ({_ROWS}) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM src),
parted AS (SELECT *, CASE WHEN i < CAST(trunc(n * CAST(0.7 AS DOUBLE)) AS BIGINT) THEN 'train'
    WHEN i < CAST(trunc(n * CAST(0.9 AS DOUBLE)) AS BIGINT) THEN 'validation' ELSE 'test' END AS split FROM num),
bounds AS (SELECT event_type, min(y) AS lo, max(y) AS hi FROM parted WHERE split = 'train' GROUP BY 1)
SELECT p.event_type, ts, split, {r('CASE WHEN hi = lo THEN 0 ELSE (y - lo) / (hi - lo) END')} AS y FROM parted p JOIN bounds USING (event_type)""",
}
