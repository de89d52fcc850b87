"""Whole chains as queries: preparation, evaluation, and the jobs around them, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from seriesloom.functions.columns import calendar_part, rounded
from seriesloom.operators import clean, models, split
from seriesloom.operators.features import LAGS, WIDTHS
from seriesloom.operators.impute import NEIGHBOURS
from seriesloom.plans import panels
from seriesloom.plans.evaluate import evaluate
from seriesloom.plans.oracle import CYCLES, DAYS_SQL, ERRORS, EVENT_TYPES, ORACLE as SINGLE, forecasts, hourly, r, scores, splits
from seriesloom.plans.panels import MODELS, TYPES
from seriesloom.plans.preprocess import FOSSIL_PARTS, LAGGED, TARGET, UNUSED_ENERGY, UNUSED_WEATHER, prepare
from seriesloom.plans.queries import KT, STRATEGIES, Query, _calendar, _out, _test

QUERIES: dict[str, Query] = {}

# A week inside the events, both ends included.
WEEK = (datetime(2024, 1, 8), datetime(2024, 1, 14, 23))
PRICE, LOAD = LAGGED


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def plain(name: str) -> str:
    return name.replace(" ", "_")


@query
def time_slice(spark, folder):
    return _out(clean.time_slice(panels.hourly_mean(spark, folder), *WEEK), [*KT, "n"], ["y"])


@query
def prepared(spark, folder):
    """Raw tables to complete features: purchases are the priced series, views and errors its two fuels, and every event
    type is a place that measures the same thing twice. The preparation fills all gaps."""
    means = panels.hourly_mean(spark, folder)
    part = lambda t, c: F.max(F.when(F.col("event_type") == t, F.col(c)))
    energy = means.groupBy("ts").agg(
        part("purchase", "y").alias(PRICE),
        part("purchase", "n").cast("double").alias(LOAD),
        part("view", "y").alias(FOSSIL_PARTS[0]),
        part("error", "y").alias(FOSSIL_PARTS[1]),
    )
    energy = energy.withColumns({c: F.lit(1.0) for c in UNUSED_ENERGY})
    places = means.select("ts", F.concat(F.lit(" "), "event_type").alias("city_name"), "y")
    twice = places.withColumn("_line", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("y", F.col("y") * F.col("_line"))
    twice = twice.withColumns({c: F.lit("x") for c in UNUSED_WEATHER})
    rows = prepare(energy, twice, _calendar(spark), order=("_line",))
    named = rows.toDF(*[plain(c) for c in rows.columns])
    return _out(named, ["ts"], [c for c in named.columns if c != "ts"], 5)


@query
def evaluation(spark, folder):
    """The point, interval and strategy tables of an evaluation of all forecasts, as (table, series, name, metric, value)."""
    results = panels.split_forecasts(spark, folder).select(*KT, "y", *MODELS, "lo", "hi")
    tables = evaluate(results, "y", MODELS, {"normal": ("lo", "hi", 0.95)}, STRATEGIES, TYPES)
    shown = {
        "point_metrics": ("model", ["n", "mae", "rmse", "smape"]),
        "interval_metrics": ("model", ["n", "picp", "mpiw"]),
        "strategy_metrics": ("strategy", ["days", "total_profit", "std_profit", "sharpe", "sortino", "max_drawdown", "final_equity"]),
    }
    parts = []
    for name, (by, metrics) in shown.items():
        wide = tables[name].select("event_type", F.col(by).alias("name"), *[F.col(m).cast("double").alias(m) for m in metrics])
        long = wide.unpivot(["event_type", "name"], metrics, "metric", "value")
        parts.append(long.select(F.lit(name).alias("table_name"), "event_type", "name", "metric", rounded("value").alias("value")))
    return parts[0].union(parts[1]).union(parts[2])


@query
def stump_point(spark, folder):
    """One boosting round of depth one on the hour and the weekday: the best split and its two means."""
    rows = split.chrono_split(panels.hourly_dense(spark, folder), TYPES)
    parts = {p: calendar_part("ts", p).cast("double") for p in ("hour", "day_of_week")}
    rows = rows.withColumns(parts)
    model = models.fit_point(rows, list(parts), "y", rounds=1, depth=1, share=1.0)
    return _out(models.score(model, _test(rows), list(parts), KT), KT, ["y_pred"])


def _prepared_sql() -> str:
    quoted = lambda c: f'"{c}"'
    places = [f"y_{t}" for t in EVENT_TYPES]
    lagged = [f"{c}_lag_{k}" for c in LAGGED for k in LAGS]
    rolls = [f"{c}_roll_{f}_{w}" for c in LAGGED for w in WIDTHS for f in ("mean", "std")]
    names = [PRICE, LOAD, "generation_fossil_total", *places, "is_holiday", *CYCLES, *lagged, *rolls]
    lag_sql = ", ".join(f'lag("{c}", {k}) OVER (ORDER BY ts) AS "{c}_lag_{k}"' for c in LAGGED for k in LAGS)
    frame = "OVER (ORDER BY ts ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    roll_sql = ", ".join(
        f'CASE WHEN count("{c}") {frame.format(w=w)} = {w} THEN {fold}("{c}") {frame.format(w=w)} END AS "{c}_roll_{f}_{w}"'
        for c in LAGGED
        for w in WIDTHS
        for f, fold in (("mean", "avg"), ("std", "stddev_samp"))
    )
    of = lambda t, x: f"max(CASE WHEN event_type = '{t}' THEN {x} END)"
    size = len(names)
    return f"""WITH {hourly()},
wide AS (SELECT ts, {of('purchase', 'total / n')} AS "{PRICE}", {of('purchase', 'CAST(n AS DOUBLE)')} AS "{LOAD}",
    {of('view', 'total / n')} + {of('error', 'total / n')} AS generation_fossil_total,
    {', '.join(f"{of(t, 'total / n')} AS y_{t}" for t in EVENT_TYPES)} FROM hourly GROUP BY 1),
axis AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM wide),
g AS (SELECT axis.ts, wide.* EXCLUDE (ts), CAST(CAST(axis.ts AS DATE) IN ({DAYS_SQL}) AS INTEGER) AS is_holiday FROM axis LEFT JOIN wide ON axis.ts = wide.ts),
c AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in CYCLES.items())} FROM g),
f AS (SELECT *, {lag_sql}, {roll_sql} FROM c),
raw AS MATERIALIZED (SELECT ts, [{', '.join(f'CAST({quoted(n)} AS DOUBLE)' for n in names)}] AS v FROM f WHERE "{TARGET}_lag_168" IS NOT NULL),
cells AS (SELECT ts, unnest(range(1, {size + 1})) AS j, unnest(v) AS x FROM raw),
b AS MATERIALIZED (SELECT j, min(x) AS lo, max(x) AS hi FROM cells GROUP BY 1),
small AS MATERIALIZED (SELECT ts, j, CASE WHEN hi = lo THEN x - lo ELSE (x - lo) / (hi - lo) END AS x FROM cells JOIN b USING (j)),
means AS (SELECT j, avg(x) AS x FROM small GROUP BY 1),
s AS MATERIALIZED (SELECT ts, list(x ORDER BY j) AS v FROM small GROUP BY 1),
gaps AS (SELECT DISTINCT ts FROM small WHERE x IS NULL),
far AS MATERIALIZED (SELECT a.ts, d.ts AS dts, d.v AS dv,
    list_sum(list_transform(a.v, lambda x, i: coalesce((x - d.v[i]) * (x - d.v[i]), 0))) * {size}
        / list_sum(list_transform(a.v, lambda x, i: CASE WHEN x IS NOT NULL AND d.v[i] IS NOT NULL THEN 1 ELSE 0 END)) AS dist
    FROM s a JOIN gaps ON gaps.ts = a.ts, s d),
near AS (SELECT c.ts, c.j, far.dv[c.j] AS x, row_number() OVER (PARTITION BY c.ts, c.j ORDER BY dist, dts) AS k
    FROM small c JOIN far ON far.ts = c.ts WHERE c.x IS NULL AND far.dv[c.j] IS NOT NULL),
found AS (SELECT ts, j, avg(x) AS x FROM near WHERE k <= {NEIGHBOURS} GROUP BY 1, 2),
done AS (SELECT small.ts, j, CASE WHEN hi = lo THEN y + lo ELSE y * (hi - lo) + lo END AS x FROM (
    SELECT small.ts, small.j, coalesce(small.x, found.x, means.x) AS y FROM small LEFT JOIN found ON found.ts = small.ts AND found.j = small.j
    JOIN means ON means.j = small.j) small JOIN b USING (j)),
rows AS (SELECT ts, list(x ORDER BY j) AS v FROM done GROUP BY 1)
SELECT ts, {', '.join(f"{r(f'v[{i + 1}]', 5)} AS {plain(n)}" for i, n in enumerate(names))} FROM rows"""


def _long(source: str, table: str, name: str, metrics: list[str]) -> str:
    cells = ", ".join(f"CAST({m} AS DOUBLE)" for m in metrics)
    return f"""SELECT '{table}' AS table_name, event_type, name, metric, {r('value')} AS value
FROM (SELECT event_type, {name} AS name, unnest({metrics}) AS metric, unnest([{cells}]) AS value FROM ({source}))"""


_POINTS = f"""WITH {forecasts()}, {ERRORS.format(ids='event_type', source='fc')}
SELECT event_type, model, {scores('y', 'p')} FROM err GROUP BY 1, 2"""
_INTERVALS = f"""WITH {forecasts()}
SELECT event_type, 'normal' AS model, count(*) AS n, avg(CAST(y >= lo AND y <= hi AS INTEGER)) * 100 AS picp, avg(hi - lo) AS mpiw FROM fc GROUP BY 1"""

ORACLE = {
    "time_slice": f"""WITH {hourly()} SELECT event_type, ts, n, {r('total / n')} AS y FROM hourly
WHERE ts BETWEEN TIMESTAMP '{WEEK[0]}' AND TIMESTAMP '{WEEK[1]}'""",
    "prepared": _prepared_sql(),
    "evaluation": " UNION ALL ".join(
        [
            _long(_POINTS, "point_metrics", "model", ["n", "mae", "rmse", "smape"]),
            _long(_INTERVALS, "interval_metrics", "model", ["n", "picp", "mpiw"]),
            _long(SINGLE["trading_summary"], "strategy_metrics", "strategy", ["days", "total_profit", "std_profit", "sharpe", "sortino", "max_drawdown", "final_equity"]),
        ]
    ),
    "stump_point": f"""WITH {hourly()}, {splits('dense', 'sp')},
x AS (SELECT *, CAST(hour(ts) AS DOUBLE) AS a, CAST(isodow(ts) - 1 AS DOUBLE) AS b FROM sp),
t AS (SELECT 'a' AS f, a AS v, y FROM x WHERE split = 'train' UNION ALL SELECT 'b', b, y FROM x WHERE split = 'train'),
cuts AS (SELECT f, v AS low, lead(v) OVER (PARTITION BY f ORDER BY v) AS high FROM (SELECT DISTINCT f, v FROM t)),
tried AS (SELECT c.f, (low + high) / 2 AS cut, avg(y) FILTER (WHERE v <= low) AS below, avg(y) FILTER (WHERE v > low) AS above,
    var_pop(y) FILTER (WHERE v <= low) * count(*) FILTER (WHERE v <= low) + var_pop(y) FILTER (WHERE v > low) * count(*) FILTER (WHERE v > low) AS rest
    FROM cuts c JOIN t USING (f) WHERE high IS NOT NULL GROUP BY c.f, low, high),
best AS (SELECT arg_min(struct_pack(f := f, cut := cut, below := below, above := above), rest) AS s FROM tried)
SELECT event_type, ts, {r('CASE WHEN (CASE s.f WHEN ' + "'a'" + ' THEN a ELSE b END) <= s.cut THEN s.below ELSE s.above END')} AS y_pred FROM x, best WHERE split = 'test'""",
}
