"""The same results as the registered queries, in SQL over the same tables."""

from __future__ import annotations

import math

from seriesloom.plans.queries import HOLIDAYS, MAX_LAG

# Fixed value: the event types.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def r(x: str, digits: int = 6) -> str:
    scale = f"1e{digits}"
    return f"(floor(({x}) * {scale} + 0.5) / {scale})"


def shown(names, digits: int = 6) -> str:
    return ", ".join(f"{r(c, digits)} AS {c}" for c in names)


def hourly(k: str = "event_type") -> str:
    return f"""
hourly AS (SELECT {k}, time_bucket(INTERVAL '1 hour', ts) AS ts,
    CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n FROM events GROUP BY 1, 2),
grid AS (SELECT {k}, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts
    FROM (SELECT {k}, min(ts) AS lo, max(ts) AS hi FROM hourly GROUP BY 1)),
dense AS (SELECT g.{k}, g.ts, coalesce(h.total, 0) AS y FROM grid g LEFT JOIN hourly h ON g.{k} = h.{k} AND g.ts = h.ts),
totals AS (SELECT g.{k}, g.ts, h.total AS y FROM grid g LEFT JOIN hourly h ON g.{k} = h.{k} AND g.ts = h.ts),
gappy AS (SELECT g.{k}, g.ts, h.total / h.n AS y, h.n FROM grid g LEFT JOIN hourly h ON g.{k} = h.{k} AND g.ts = h.ts)"""


def splits(source: str, name: str, k: str = "event_type") -> str:
    return f"""
{name}_n AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY ts) - 1 AS position,
    count(*) OVER (PARTITION BY {k}) AS n_rows FROM {source}),
{name}_c AS (SELECT *, CAST(trunc(n_rows * CAST(0.7 AS DOUBLE)) AS BIGINT) AS c1,
    CAST(trunc(n_rows * CAST(0.9 AS DOUBLE)) AS BIGINT) AS c2 FROM {name}_n),
{name} AS (SELECT *, CASE WHEN position < c1 THEN 'train' WHEN position < c2 THEN 'validation' ELSE 'test' END AS split,
    position - CASE WHEN position < c1 THEN 0 WHEN position < c2 THEN c1 ELSE c2 END AS split_position FROM {name}_c)"""


def forecasts(k: str = "event_type") -> str:
    return f"""{hourly(k)},
fc_raw AS (SELECT {k}, ts, y, lag(y, 1) OVER w AS naive1, lag(y, 24) OVER w AS naive24,
    CASE WHEN count(y) OVER f = 24 THEN avg(y) OVER f END AS roll24,
    CASE WHEN count(y) OVER f = 24 THEN 1.96 * stddev_samp(y) OVER f END AS reach
    FROM dense WINDOW w AS (PARTITION BY {k} ORDER BY ts),
    f AS (PARTITION BY {k} ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
fc_known AS (SELECT {k}, ts, y, naive1, naive24, roll24, {r('roll24 - reach')} AS lo, {r('roll24 + reach')} AS hi FROM fc_raw WHERE roll24 IS NOT NULL),
{splits("fc_known", "fc", k)}"""


ERRORS = """err AS (SELECT {ids}, 'naive1' AS model, naive1 - y AS error, y, naive1 AS p FROM {source}
    UNION ALL SELECT {ids}, 'naive24', naive24 - y, y, naive24 FROM {source}
    UNION ALL SELECT {ids}, 'roll24', roll24 - y, y, roll24 FROM {source})"""

SCORES = """count(*) AS n, {mae}, {rmse}, {smape}"""


def scores(y: str, p: str) -> str:
    return SCORES.format(
        mae=r(f"avg(abs({y} - {p}))") + " AS mae",
        rmse=r(f"sqrt(avg(({y} - {p}) * ({y} - {p})))") + " AS rmse",
        smape=r(f"avg(2 * abs({p} - {y}) / nullif(abs({y}) + abs({p}), 0)) * 100") + " AS smape",
    )


def quartiles(x: str, digits: int = 6) -> str:
    return (
        f"{r(f'min({x})', digits)} AS min, {r(f'quantile_cont({x}, 0.25)', digits)} AS p25, "
        f"{r(f'quantile_cont({x}, 0.5)', digits)} AS p50, {r(f'quantile_cont({x}, 0.75)', digits)} AS p75, "
        f"{r(f'max({x})', digits)} AS max"
    )


def rolled(x: str, fold: str, start: int, end: int, k: str = "event_type") -> str:
    side = lambda n: f"{-n} PRECEDING" if n < 0 else ("CURRENT ROW" if n == 0 else f"{n} FOLLOWING")
    frame = f"(PARTITION BY {k} ORDER BY ts ROWS BETWEEN {side(start)} AND {side(end)})"
    return f"CASE WHEN count({x}) OVER {frame} = {end - start + 1} THEN {fold}({x}) OVER {frame} END"


TYPED = "event_type, ts"
THREE = "time_bucket(INTERVAL '3 hours', ts)"
COARSE = f"coarse AS (SELECT event_type, {THREE} AS ts, avg(y) AS y FROM {{source}} GROUP BY 1, 2 HAVING avg(y) IS NOT NULL)"

SHIP = """ship AS (SELECT l_suppkey, l_returnflag AS strategy, CAST(l_shipdate AS DATE) AS day,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(5,2)))
        * CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END) AS DOUBLE) AS pnl
    FROM lineitem GROUP BY 1, 2, 3),
eq AS (SELECT *, sum(pnl) OVER (PARTITION BY l_suppkey, strategy ORDER BY day ROWS UNBOUNDED PRECEDING) AS equity FROM ship),
pk AS (SELECT *, max(equity) OVER (PARTITION BY l_suppkey, strategy ORDER BY day ROWS UNBOUNDED PRECEDING) AS running_max FROM eq),
dd AS (SELECT *, (equity - running_max) / nullif(running_max, 0) AS drawdown FROM pk)"""


def summary(source: str, keys: str, money_digits: int = 6, std_digits: int = 6) -> str:
    """Profit and risk per strategy from a table that has pnl, equity and drawdown by day."""
    d = money_digits
    return f"""stats AS (SELECT {keys}, strategy, count(pnl) AS days, sum(pnl) AS total, avg(pnl) AS m,
    stddev_samp(pnl) AS s, stddev_samp(CASE WHEN pnl < 0 THEN pnl END) AS loss, min(drawdown) AS worst,
    max_by(equity, day) AS final_equity FROM {source} GROUP BY {keys}, strategy)
SELECT {keys}, strategy, days, {r('total', d)} AS total_profit, {r('s', std_digits)} AS std_profit,
    {r('final_equity', d)} AS final_equity,
    {r('CASE WHEN s = 0 THEN 0 ELSE m / s * sqrt(365) END')} AS sharpe,
    CASE WHEN s = 0 THEN 0.0 WHEN loss > 0 THEN {r('m / loss * sqrt(365)')} ELSE CAST('inf' AS DOUBLE) END AS sortino,
    {r('CASE WHEN s = 0 THEN 0 ELSE coalesce(worst * 100, 0) END')} AS max_drawdown FROM stats"""


def pnl(base: str, k: str) -> str:
    """Daily profit of the three strategies; the earliest hour wins a tie."""

    def at(col: str, way: str) -> str:
        return f"first(y ORDER BY {col} {way}, ts)"

    return f"""{base},
pnl AS (SELECT {k}, CAST(ts AS DATE) AS day, max(y) - min(y) AS oracle,
    {at('naive24', 'DESC')} - {at('naive24', 'ASC')} AS naive,
    {at('lo', 'DESC')} - {at('hi', 'ASC')} AS risk_aware
    FROM fc GROUP BY 1, 2 HAVING count(*) >= 24)"""


EXTREMES = f"""{hourly('user_id')},
ex AS (SELECT user_id, ts, y, lag(y, 24) OVER w AS naive24, min(y) OVER f AS lo, max(y) OVER f AS hi FROM dense
    WINDOW w AS (PARTITION BY user_id ORDER BY ts), f AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
fc AS (SELECT * FROM ex WHERE naive24 IS NOT NULL)"""
CURVES = f"""{forecasts()},
curve AS (SELECT event_type, quantile_cont(y - roll24, {[i / 100 for i in range(101)]}) AS q
    FROM fc WHERE split = 'train' GROUP BY 1),
draws AS (SELECT f.event_type, f.ts, f.y, f.roll24, c.q, b.sample_id,
    CAST('0x' || substr(md5(f.event_type || '|' || CAST(epoch(f.ts) AS BIGINT) || '|' || b.sample_id), 1, 12) AS BIGINT)
        / 281474976710656.0::DOUBLE * 100 AS pos
    FROM fc f JOIN curve c USING (event_type), (SELECT unnest(range(50))::INTEGER AS sample_id) b WHERE f.split = 'test'),
samples AS (SELECT event_type, ts, y, sample_id, roll24 + q[CAST(floor(pos) AS INTEGER) + 1]
    + (q[CAST(floor(pos) AS INTEGER) + 2] - q[CAST(floor(pos) AS INTEGER) + 1]) * (pos - floor(pos)) AS value FROM draws)"""


def decomposed(source: str, period: int, part: str) -> str:
    """Additive decomposition of a table (k, ts, y); ``part`` is the partition expression."""
    h = period // 2
    frame = f"(PARTITION BY {part} ORDER BY ts ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    order = f"(PARTITION BY {part} ORDER BY ts)"
    whole = f"count(y) OVER {frame} = {2 * h + 1}"
    if period % 2:
        trend = f"CASE WHEN {whole} THEN avg(y) OVER {frame} END"
    else:
        trend = (
            f"CASE WHEN {whole} THEN (sum(y) OVER {frame} - (lag(y, {h}) OVER {order} + lead(y, {h}) OVER {order}) / 2) / {period} END"
        )
    return f"""
tr AS (SELECT *, {trend} AS trend, (row_number() OVER {order} - 1) % {period} AS phase FROM {source}),
ph AS (SELECT {part} AS part, phase, avg(y - trend) AS m FROM tr GROUP BY 1, 2),
se AS (SELECT part, phase, m - avg(m) OVER (PARTITION BY part) AS seasonal FROM ph),
de AS (SELECT tr.*, se.seasonal, y - trend - se.seasonal AS resid FROM tr JOIN se ON se.part = {part} AND se.phase = tr.phase)"""


TOP_LAGS = int(math.log(MAX_LAG))
ACF = f"""{hourly()},
num AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i FROM dense),
acf AS (SELECT a.event_type, l.lag, corr(a.y, b.y) AS r FROM num a, (SELECT unnest(range(1, {MAX_LAG + 1}))::INTEGER AS lag) l, num b
    WHERE a.event_type = b.event_type AND b.i = a.i - l.lag GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY r DESC, lag) AS rank FROM acf),
top AS (SELECT event_type, rank, lag, r, exp(r) / sum(exp(r)) OVER (PARTITION BY event_type) AS weight FROM ranked WHERE rank <= {TOP_LAGS})"""

BLEND = """mae AS (SELECT {k}, avg(abs(y - naive1)) AS m1, avg(abs(y - naive24)) AS m24, avg(abs(y - roll24)) AS mr
    FROM fc WHERE split = 'validation' GROUP BY 1),
inv AS (SELECT {k}, 1 / greatest(m1, 1e-9) AS i1, 1 / greatest(m24, 1e-9) AS i24, 1 / greatest(mr, 1e-9) AS ir FROM mae),
mixed AS (SELECT f.*, (i1 * naive1 + i24 * naive24 + ir * roll24) / (i1 + i24 + ir) AS blend
    FROM fc f LEFT JOIN inv USING ({k}) WHERE split = 'test')"""

FEATURES = ["y_lag_1", "y_lag_2", "y_lag_3", "y_lag_24", "y_lag_48", "y_lag_168"]
LAGGED = ", ".join(f"lag(y, {k}) OVER w AS y_lag_{k}" for k in (1, 2, 3, 24, 48, 168))


def lagged(source: str) -> str:
    return f"lagged AS (SELECT *, {LAGGED} FROM {source} WINDOW w AS (PARTITION BY event_type ORDER BY ts))"


CYCLES = {
    "hour_sin": "sin(2 * pi() * hour(ts) / 24.0)",
    "hour_cos": "cos(2 * pi() * hour(ts) / 24.0)",
    "day_of_week_sin": "sin(2 * pi() * (isodow(ts) - 1) / 7.0)",
    "day_of_week_cos": "cos(2 * pi() * (isodow(ts) - 1) / 7.0)",
    "month_sin": "sin(2 * pi() * month(ts) / 12.0)",
    "month_cos": "cos(2 * pi() * month(ts) / 12.0)",
}


def top_features() -> str:
    names = [*FEATURES, *[f"y_roll_{f}_{w}" for w in (6, 12, 24) for f in ("mean", "std")]]
    names += ["hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos"]
    rolls = ", ".join(
        f"{rolled('y', fold, -w, -1)} AS y_roll_{f}_{w}" for w in (6, 12, 24) for f, fold in (("mean", "avg"), ("std", "stddev_samp"))
    )
    cycles = ", ".join(f"{CYCLES[c]} AS {c}" for c in names[-4:])
    parts = " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, y)) AS importance FROM ready" for c in names)
    return f"""WITH {hourly()}, {lagged("dense")},
feats AS (SELECT *, {rolls}, {cycles} FROM lagged), ready AS (SELECT * FROM feats WHERE y_lag_168 IS NOT NULL),
imp AS ({parts}),
rk AS (SELECT CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank, feature, importance FROM imp)
SELECT rank, feature, {r('importance')} AS importance FROM rk WHERE rank <= 10"""


def knn() -> str:
    cols = ["y", "y_lag_1", "y_lag_24", "hour_sin", "hour_cos"]
    base = f"""WITH {hourly()},
raw AS (SELECT event_type, ts, y, lag(y, 1) OVER w AS y_lag_1, lag(y, 24) OVER w AS y_lag_24,
    {CYCLES['hour_sin']} AS hour_sin, {CYCLES['hour_cos']} AS hour_cos FROM gappy WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
b AS (SELECT event_type, {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in cols)} FROM raw GROUP BY 1),
s AS (SELECT event_type, ts, {', '.join(f'({c} - lo_{c}) / (hi_{c} - lo_{c}) AS {c}' for c in cols)} FROM raw JOIN b USING (event_type)),
mean AS (SELECT event_type, {', '.join(f'avg({c}) AS {c}' for c in cols)} FROM s GROUP BY 1)"""
    total = " + ".join(f"coalesce((a.{c} - d.{c}) * (a.{c} - d.{c}), 0)" for c in cols)
    both = " + ".join(f"CAST(a.{c} IS NOT NULL AND d.{c} IS NOT NULL AS INTEGER)" for c in cols)
    fills, joins, outs = "", "", []
    for c in cols[:3]:
        fills += f""",
n_{c} AS (SELECT a.event_type, a.ts, d.ts AS dts, d.{c} AS v, ({total}) * 5 / ({both}) AS dist
    FROM s a JOIN s d ON a.event_type = d.event_type AND a.{c} IS NULL AND d.{c} IS NOT NULL),
f_{c} AS (SELECT event_type, ts, avg(v) AS v FROM (SELECT *, row_number() OVER (PARTITION BY event_type, ts ORDER BY dist, dts) AS k
    FROM n_{c}) WHERE k <= 5 GROUP BY 1, 2)"""
        joins += f" LEFT JOIN f_{c} ON f_{c}.event_type = s.event_type AND f_{c}.ts = s.ts"
        value = f"coalesce(s.{c}, f_{c}.v, mean.{c}) * (hi_{c} - lo_{c}) + lo_{c}"
        outs.append(f"{r(value)} AS {c}")
    return f"""{base}{fills}
SELECT s.event_type, s.ts, {', '.join(outs)} FROM s JOIN b ON b.event_type = s.event_type
JOIN mean ON mean.event_type = s.event_type{joins}"""


def box(ids: str) -> str:
    return f"""{ERRORS.format(ids="hour(ts) AS hour", source="fc")},
bx AS (SELECT {ids}, quantile_cont(error, 0.25) AS p25, quantile_cont(error, 0.5) AS p50, quantile_cont(error, 0.75) AS p75 FROM err GROUP BY {ids}),
mk AS (SELECT err.*, p25, p50, p75, error BETWEEN p25 - (p75 - p25) * 1.5 AND p75 + (p75 - p25) * 1.5 AS inside FROM err JOIN bx USING ({ids}))
SELECT CAST(hour AS INTEGER) AS hour, model, count(*) AS n, CAST(count(*) FILTER (WHERE NOT inside) AS BIGINT) AS outliers,
    {r('any_value(p25)')} AS p25, {r('any_value(p50)')} AS p50, {r('any_value(p75)')} AS p75,
    {r('min(error) FILTER (WHERE inside)')} AS whisker_low, {r('max(error) FILTER (WHERE inside)')} AS whisker_high
FROM mk GROUP BY hour, model"""


def describe() -> str:
    parts = []
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"):
        parts.append(
            f"SELECT '{c}' AS \"column\", count({c}) AS count, {r(f'avg({c})', 4)} AS mean, "
            f"{r(f'stddev_samp({c})', 4)} AS std, {quartiles(c, 4)} FROM lineitem"
        )
    return " UNION ALL ".join(parts)


def user_mixed() -> str:
    return f"""WITH {forecasts('user_id')}, {BLEND.format(k='user_id')},
err AS (SELECT 'naive1' AS model, y, naive1 AS p FROM mixed UNION ALL SELECT 'naive24', y, naive24 FROM mixed
    UNION ALL SELECT 'roll24', y, roll24 FROM mixed UNION ALL SELECT 'blend', y, blend FROM mixed)
SELECT model, {scores('y', 'p')} FROM err WHERE p IS NOT NULL GROUP BY 1"""


def processed() -> str:
    lag_sql = ", ".join(f"lag({c}, {k}) OVER w AS {c}_lag_{k}" for c in ("price", "load") for k in (1, 2, 3, 24, 48, 168))
    names = ["price", "load", *[f"y_{t}" for t in EVENT_TYPES], *CYCLES]
    names += [f"{c}_lag_{k}" for c in ("price", "load") for k in (1, 2, 3, 24, 48, 168)]
    frame = "OVER (ORDER BY ts ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"
    six, day = frame.format(6), frame.format(24)
    return f"""WITH {hourly()},
wide AS (SELECT ts, {', '.join(f"max(CASE WHEN event_type = '{t}' THEN total / n END) AS y_{t}" for t in EVENT_TYPES)},
    max(CASE WHEN event_type = 'purchase' THEN total / n END) AS price,
    max(CASE WHEN event_type = 'purchase' THEN CAST(n AS DOUBLE) END) AS load FROM hourly GROUP BY 1),
axis AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM wide),
g AS (SELECT axis.ts, wide.* EXCLUDE (ts), CAST(CAST(axis.ts AS DATE) IN ({DAYS_SQL}) AS INTEGER) AS is_holiday FROM axis LEFT JOIN wide ON axis.ts = wide.ts),
c AS (SELECT *, {', '.join(f'{x} AS {c}' for c, x in CYCLES.items())} FROM g),
l AS (SELECT *, {lag_sql}, CASE WHEN count(load) {six} = 6 THEN avg(load) {six} END AS load_roll_mean_6,
    CASE WHEN count(load) {day} = 24 THEN stddev_samp(load) {day} END AS load_roll_std_24 FROM c WINDOW w AS (ORDER BY ts))
SELECT ts, is_holiday, {shown([*names, 'load_roll_mean_6', 'load_roll_std_24'])} FROM l WHERE load_lag_168 IS NOT NULL"""


DAYS_SQL = ", ".join(f"DATE '{d}'" for d in HOLIDAYS)
PASSES = "mean, sqrt(((naive1 - mean) ** 2 + (naive24 - mean) ** 2 + (roll24 - mean) ** 2) / 3) AS epistemic"

ORACLE: dict[str, str] = {
    "lag24_scoreboard": f"""WITH {hourly()},
l AS (SELECT *, lag(y, 24) OVER (PARTITION BY event_type ORDER BY ts) AS p FROM dense),
k AS (SELECT * FROM l WHERE p IS NOT NULL), {splits('k', 'sp')}
SELECT event_type, {scores('y', 'p')} FROM sp WHERE split = 'test' GROUP BY 1""",
    "src_csv_roundtrip": f"WITH {hourly()} SELECT {TYPED}, n, {r('total / n')} AS y FROM hourly",
    "src_parquet_roundtrip": f"WITH {hourly()} SELECT {TYPED}, {r('y')} AS y FROM dense",
    "ts_normalize": """SELECT event_id, date_trunc('second', ts) - CASE WHEN event_id % 2 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 2 HOUR END AS ts
FROM events""",
    "proj_drop": "SELECT event_id, ts, event_type, value FROM events",
    "proj_combine": f"SELECT l_orderkey, l_linenumber, l_partkey, {r('l_quantity + l_extendedprice', 2)} AS combined FROM lineitem",
    "str_strip": f"""SELECT event_type, count(*) AS n, {r('CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE)', 2)} AS total
FROM events GROUP BY 1""",
    "dedupe_first": """SELECT event_id, ts, event_type, value, hour FROM (SELECT *, time_bucket(INTERVAL '1 hour', ts) AS hour,
    row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL '1 hour', ts) ORDER BY ts, event_id) AS k FROM events) WHERE k = 1""",
    "drop_null_subset": f"""WITH {hourly()}, {lagged('gappy')}
SELECT {TYPED}, {shown(['y', 'y_lag_168'])} FROM lagged WHERE y_lag_168 IS NOT NULL""",
    "drop_null_any": f"""WITH {hourly()}, {lagged('gappy')}
SELECT {TYPED}, {shown(['y', 'y_lag_1', 'y_lag_2', 'y_lag_3', 'y_lag_24'])} FROM lagged
WHERE y IS NOT NULL AND y_lag_1 IS NOT NULL AND y_lag_2 IS NOT NULL AND y_lag_3 IS NOT NULL AND y_lag_24 IS NOT NULL""",
    "pivot_wide": f"""WITH {hourly()} SELECT ts,
    {', '.join(f"max(CASE WHEN event_type = '{t}' THEN n END) AS n_{t}" for t in EVENT_TYPES)},
    {', '.join(f"max({r(f'''CASE WHEN event_type = '{t}' THEN total / n END''')}) AS y_{t}" for t in EVENT_TYPES)}
FROM hourly GROUP BY 1""",
    "pivot_map": f"""WITH {hourly()} SELECT ts, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM hourly GROUP BY ts""",
    "residuals_long": f"""WITH {forecasts()}, t AS (SELECT * FROM fc WHERE split = 'test'), {ERRORS.format(ids='event_type, ts', source='t')}
SELECT {TYPED}, model, {r('error')} AS error FROM err""",
    "pred_table": f"""WITH {hourly()},
p AS (SELECT *, lag(y, 1) OVER w AS naive1, lag(y, 24) OVER w AS naive24, {rolled('y', 'avg', -72, -1)} AS roll72
    FROM dense WINDOW w AS (PARTITION BY event_type ORDER BY ts))
SELECT {TYPED}, {shown(['y', 'naive1', 'naive24', 'roll72'])} FROM p WHERE roll72 IS NOT NULL AND naive24 IS NOT NULL AND naive1 IS NOT NULL""",
    "scoreboard": f"""WITH {forecasts('user_id')}, t AS (SELECT * FROM fc WHERE split = 'test'), {ERRORS.format(ids='user_id', source='t')}
SELECT model, {scores('y', 'p')} FROM err GROUP BY 1""",
    "join_outer_time": f"""WITH o AS (SELECT o_orderdate AS ts, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1000 AS ordered FROM orders GROUP BY 1),
s AS (SELECT l_shipdate AS ts, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(5,2)))) AS DOUBLE) / 1000 AS shipped
    FROM lineitem GROUP BY 1)
SELECT coalesce(o.ts, s.ts) AS ts, {shown(['ordered', 'shipped'], 7)} FROM o FULL OUTER JOIN s ON o.ts = s.ts""",
    "hourly_grid": f"WITH {hourly()} SELECT {TYPED}, n, {r('y')} AS y FROM gappy",
    "asof_upsample": f"""WITH {hourly()}, {COARSE.format(source='gappy')},
a AS (SELECT g.event_type, g.ts, c.y FROM gappy g ASOF LEFT JOIN coarse c ON g.event_type = c.event_type AND g.ts >= c.ts),
h AS (SELECT event_type, min_by(y, ts) AS first_y FROM a WHERE y IS NOT NULL GROUP BY 1)
SELECT a.event_type, a.ts, {r('coalesce(a.y, h.first_y)')} AS y FROM a JOIN h USING (event_type)""",
    "resample_3h": f"WITH {hourly()}, {COARSE.format(source='gappy')} SELECT {TYPED}, {r('y')} AS y FROM coarse",
    "resample_daily": f"""WITH {hourly('user_id')}
SELECT user_id, time_bucket(INTERVAL '1 day', ts) AS ts, {r('avg(y)')} AS y FROM gappy GROUP BY 1, 2 HAVING avg(y) IS NOT NULL""",
    "holiday_flag": f"WITH {hourly()} SELECT {TYPED}, CAST(CAST(ts AS DATE) IN ({DAYS_SQL}) AS INTEGER) AS is_holiday FROM dense",
    "cyclical_features": f"""WITH {hourly()} SELECT {TYPED}, {', '.join(f'{r(x)} AS {c}' for c, x in CYCLES.items())} FROM dense""",
    "lag_features": f"WITH {hourly()}, {lagged('gappy')} SELECT {TYPED}, {shown(['y', *FEATURES])} FROM lagged",
    "roll_mean": f"""WITH {hourly()} SELECT {TYPED},
    {', '.join(f"{r(rolled('y', 'avg', -w, -1))} AS y_roll_mean_{w}" for w in (6, 12, 24))} FROM totals""",
    "roll_std": f"""WITH {hourly()} SELECT {TYPED},
    {', '.join(f"{r(rolled('y', 'stddev_samp', -w, -1))} AS y_roll_std_{w}" for w in (6, 12, 24))} FROM dense""",
    "top_features": top_features(),
    "sequence_windows": f"""WITH {hourly()}, w AS (SELECT *, lag(y, 72) OVER o AS first, lag(y, 1) OVER o AS last, sum(y) OVER f AS total, count(y) OVER f AS c
    FROM dense WINDOW o AS (PARTITION BY event_type ORDER BY ts), f AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING))
SELECT {TYPED}, CAST(c AS INTEGER) AS n, {shown(['y', 'first', 'last', 'total'])} FROM w WHERE c = 72""",
    "nth_window": f"""WITH {hourly()}, w AS (SELECT *, sum(y) OVER f AS total, count(y) OVER f AS c FROM dense
    WINDOW f AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS position FROM w WHERE c = 72)
SELECT {TYPED}, position, {shown(['y', 'total'])} FROM p WHERE position = 200""",
    "encdec_windows": f"""WITH {hourly()}, w AS (SELECT *, lag(y, 167) OVER o AS decoder_first, lead(y, 1) OVER o AS target_first,
    sum(y) OVER e AS encoder_total, count(*) OVER e AS ne, sum(y) OVER t AS target_total, count(*) OVER t AS nt FROM dense
    WINDOW o AS (PARTITION BY event_type ORDER BY ts), e AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 335 PRECEDING AND CURRENT ROW),
    t AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING))
SELECT {TYPED}, 336 AS n_encoder, 192 AS n_decoder, 24 AS n_target, {r('decoder_first')} AS decoder_first, {r('y')} AS decoder_known_last,
    CAST(0 AS DOUBLE) AS decoder_pad, {shown(['encoder_total', 'target_first', 'target_total'])} FROM w WHERE ne = 336 AND nt = 24""",
    "window_counts": f"""WITH {hourly('user_id')}, c AS (SELECT user_id, count(*) AS n FROM dense GROUP BY 1)
SELECT user_id, n AS n_rows, greatest(n - 336, 0) AS n_sequences, greatest(n - 360 + 1, 0) AS n_encdec, greatest(n - 360, 0) // 32 AS batch_steps FROM c""",
    "processed_features": processed(),
    "chrono_split": f"WITH {hourly()}, {splits('dense', 'sp')} SELECT {TYPED}, position, n_rows, split, split_position FROM sp",
    "recent_slice": f"""WITH {hourly()}, {COARSE.format(source='dense')}, {splits('coarse', 'sp')}
SELECT {TYPED}, {r('y')} AS y FROM sp WHERE position < c1 AND position >= greatest(0, c1 - 100)""",
    "eval_points": f"""WITH {hourly()}, {splits('dense', 'sp')}
SELECT {TYPED}, split_position FROM sp WHERE split = 'test' AND split_position >= 24""",
    "split_counts": f"WITH {hourly('user_id')}, {splits('dense', 'sp', 'user_id')} SELECT user_id, split, count(*) AS n FROM sp GROUP BY 1, 2",
    "minmax_bounds": f"""WITH {hourly()}, {splits('gappy', 'sp')}
SELECT event_type, min(n) AS lo_n, max(n) AS hi_n, {r('min(y)')} AS lo_y, {r('max(y)')} AS hi_y FROM sp WHERE split = 'train' GROUP BY 1""",
    "minmax_scale": f"""WITH {hourly()}, {splits('gappy', 'sp')},
b AS (SELECT event_type, min(y) AS ly, max(y) AS hy, min(n) AS ln, max(n) AS hn FROM sp WHERE split = 'train' GROUP BY 1)
SELECT {TYPED}, {r('(y - ly) / (hy - ly)')} AS y, {r('(n - ln) / CAST(hn - ln AS DOUBLE)')} AS n FROM sp JOIN b USING (event_type)""",
    "minmax_roundtrip": f"""WITH {forecasts()}, b AS (SELECT event_type, min(y) AS lo, max(y) AS hi FROM fc WHERE split = 'train' GROUP BY 1)
SELECT {TYPED}, {shown(['y', 'naive1', 'naive24', 'roll24'])},
    {', '.join(f"{r(f'({c} - b.lo) / (b.hi - b.lo)')} AS scaled_{c}" for c in ('y', 'naive1', 'naive24', 'roll24'))} FROM fc JOIN b USING (event_type)""",
    "knn_impute": knn(),
    "interval_metrics": f"""WITH {forecasts('user_id')}
SELECT user_id, count(*) AS n, {r('avg(CAST(y >= lo AND y <= hi AS INTEGER)) * 100')} AS picp, {r('avg(hi - lo)')} AS mpiw
FROM fc WHERE split = 'test' GROUP BY 1""",
    "mc_samples": f"WITH {CURVES} SELECT {TYPED}, sample_id, {r('value')} AS value FROM samples",
    "crps": f"""WITH {CURVES},
o AS (SELECT *, row_number() OVER (PARTITION BY event_type, ts ORDER BY value) AS i FROM samples),
p AS (SELECT event_type, ts, avg(abs(value - y)) - sum(value * (2 * i - 51)) / 2500 AS c FROM o GROUP BY 1, 2)
SELECT event_type, {r('avg(c)')} AS crps FROM p GROUP BY 1""",
    "mc_bounds": f"""WITH {CURVES}
SELECT {TYPED}, {r('quantile_cont(value, 0.05)')} AS lower, {r('quantile_cont(value, 0.95)')} AS upper FROM samples GROUP BY 1, 2""",
    "calibration": f"""WITH {forecasts('user_id')}, t AS (SELECT *, (hi - lo) / (2 * 1.96) * 0.6745 AS half FROM fc WHERE split = 'test')
SELECT 'normal' AS model, 0.95::DOUBLE AS nominal, {r('avg(CAST(y >= lo AND y <= hi AS INTEGER))')} AS observed FROM t
UNION ALL SELECT 'half', 0.5::DOUBLE, {r('avg(CAST(y >= roll24 - half AND y <= roll24 + half AS INTEGER))')} FROM t""",
    "error_corr": f"""WITH {forecasts('user_id')}, t AS (SELECT naive1 - y AS naive1, naive24 - y AS naive24, roll24 - y AS roll24 FROM fc WHERE split = 'test')
{" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})')} AS r FROM t" for a in ('naive1', 'naive24', 'roll24') for b in ('naive1', 'naive24', 'roll24'))}""",
    "error_quartiles": f"""WITH {forecasts('user_id')}, t AS (SELECT * FROM fc WHERE split = 'test'), {ERRORS.format(ids='user_id', source='t')}
SELECT model, count(*) AS n, {quartiles('error')} FROM err GROUP BY 1""",
    "error_by_hour": f"WITH {forecasts()}, {box('hour, model')}",
    "tradeoff_table": f"""WITH {forecasts()}, t AS (SELECT * FROM fc WHERE split = 'test'), {ERRORS.format(ids='event_type', source='t')}
SELECT model, count(*) AS n, true AS timed, {r('avg(abs(error))')} AS mae FROM err GROUP BY 1""",
    "uncertainty_split": f"""WITH {forecasts()}, b AS (SELECT event_type, max(y) - min(y) AS w FROM fc WHERE split = 'train' GROUP BY 1),
t AS (SELECT event_type, ts, naive1, naive24, roll24, (naive1 + naive24 + roll24) / 3 AS mean, (hi - lo) / (2 * 1.96) / w AS s, w FROM fc JOIN b USING (event_type) WHERE split = 'test'),
u AS (SELECT {TYPED}, {PASSES}, sqrt(s * s * (1 + 0.25 + 2.25) / 3) * w AS aleatoric FROM t)
SELECT {TYPED}, {shown(['mean', 'epistemic', 'aleatoric'])}, {r('sqrt(epistemic * epistemic + aleatoric * aleatoric)')} AS total FROM u""",
    "gauss_interval": f"""WITH {forecasts()} SELECT {TYPED}, {r('roll24')} AS mean, {r('roll24 - (hi - roll24)')} AS lower, {r('hi')} AS upper
FROM fc WHERE split = 'test'""",
    "gauss_density": f"""WITH {forecasts()}, t AS (SELECT event_type, ts, y, roll24 AS mean, (hi - roll24) / 1.96 AS s FROM fc WHERE split = 'test' AND split_position = 10),
g AS (SELECT *, y - 30 + i * (60.0::DOUBLE / 999) AS x FROM t, (SELECT unnest(range(1000))::INTEGER AS i))
SELECT {TYPED}, i AS grid_id, x >= mean - 1.96 * s AND x <= mean + 1.96 * s AS inside, {r('x')} AS x,
    {r('exp(-((x - mean) / s) * ((x - mean) / s) / 2) / (s * sqrt(2 * pi()))')} AS pdf, {r('mean - 1.96 * s')} AS lower, {r('mean + 1.96 * s')} AS upper FROM g""",
    "describe_long": describe(),
    "dataset_profile": f"""WITH {hourly()} SELECT event_type, count(*) AS n_rows, 3 AS n_columns, count(*) * 3 AS n_cells,
    CAST(2 * count(*) - count(y) - count(n) AS BIGINT) AS n_nulls, CAST(count(y) = 0 AS INTEGER) + CAST(count(n) = 0 AS INTEGER) AS n_blank_columns,
    min(ts) AS first_ts, max(ts) AS last_ts, {r('(epoch(max(ts)) - epoch(min(ts))) / 3600')} AS hours FROM gappy GROUP BY 1""",
    "volatility_rows": f"WITH {hourly()} SELECT {TYPED}, {r(rolled('y', 'stddev_samp', -167, 0))} AS volatility FROM dense",
    "volatility_time": f"""WITH {hourly()}, m AS (SELECT {TYPED}, total / n AS y FROM hourly)
SELECT {TYPED}, {r("stddev_samp(y) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '6 days 23:59:59.999999' PRECEDING AND CURRENT ROW)")} AS volatility FROM m""",
    "volatile_week": f"""WITH {hourly()}, v AS (SELECT *, {rolled('y', 'stddev_samp', -167, 0)} AS volatility FROM dense),
p AS (SELECT event_type, first(ts ORDER BY volatility DESC NULLS LAST, ts) AS peak FROM v GROUP BY 1)
SELECT {TYPED}, {shown(['y', 'volatility'])} FROM v JOIN p USING (event_type) WHERE ts BETWEEN peak - INTERVAL 3 DAY AND peak + INTERVAL 4 DAY""",
    "daily_pnl": f"WITH {pnl(EXTREMES, 'user_id')} SELECT user_id, day, {shown(['oracle', 'naive', 'risk_aware'], 2)} FROM pnl",
    "pnl_summary": f"WITH {SHIP}, {summary('dd', 'l_suppkey', 4, 3)}",
    "trading_summary": f"""WITH {pnl(forecasts(), 'event_type')},
long AS (SELECT event_type, day, 'oracle' AS strategy, oracle AS pnl FROM pnl UNION ALL SELECT event_type, day, 'naive', naive FROM pnl
    UNION ALL SELECT event_type, day, 'risk_aware', risk_aware FROM pnl),
eq AS (SELECT *, sum(pnl) OVER (PARTITION BY event_type, strategy ORDER BY day ROWS UNBOUNDED PRECEDING) AS equity FROM long),
pk AS (SELECT *, max(equity) OVER (PARTITION BY event_type, strategy ORDER BY day ROWS UNBOUNDED PRECEDING) AS running_max FROM eq),
dd AS (SELECT *, (equity - running_max) / nullif(running_max, 0) AS drawdown FROM pk), {summary('dd', 'event_type')}""",
    "equity_curve": f"WITH {SHIP} SELECT l_suppkey, strategy, day, {shown(['equity', 'running_max'], 4)} FROM pk",
    "drawdown": f"WITH {SHIP} SELECT l_suppkey, strategy, day, {r('drawdown')} AS drawdown FROM dd",
    "rolling_sharpe": f"""WITH {SHIP}, f AS (SELECT *, count(pnl) OVER w AS c, avg(pnl) OVER w AS m, stddev_samp(pnl) OVER w AS s FROM ship WHERE strategy <> 'R'
    WINDOW w AS (PARTITION BY l_suppkey, strategy ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT l_suppkey, strategy, day, {r('CASE WHEN c = 30 THEN m / nullif(s, 0) * sqrt(365) END')} AS rolling_sharpe FROM f""",
    "pnl_quartiles": f"WITH {SHIP} SELECT strategy, count(pnl) AS n, {quartiles('pnl')} FROM ship GROUP BY 1",
    "pnl_density": f"""WITH {SHIP}, s AS (SELECT strategy, count(*) AS n, min(pnl) AS lo, max(pnl) AS hi, stddev_samp(pnl) * power(count(*), -0.2) AS h FROM ship GROUP BY 1),
g AS (SELECT strategy, n, h, i, lo - 3 * h + (hi - lo + 6 * h) * i / 199.0::DOUBLE AS x FROM s, (SELECT unnest(range(200))::INTEGER AS i))
SELECT strategy, i AS grid_id, {r('x', 3)} AS x, {r('1e6 * sum(exp(-((x - pnl) / h) * ((x - pnl) / h) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi()))')} AS density
FROM g JOIN ship USING (strategy) GROUP BY strategy, i, x""",
    "decompose_daily": f"""WITH o AS (SELECT o_orderdate AS ts, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1000 AS y FROM orders GROUP BY 1),
{decomposed('o', 365, '1')} SELECT ts, {shown(['trend', 'seasonal', 'resid'], 4)} FROM de""",
    "decompose_hourly": f"WITH {hourly()}, {decomposed('dense', 24, 'event_type')} SELECT {TYPED}, {shown(['trend', 'seasonal', 'resid'])} FROM de",
    "trend_split": f"""WITH {hourly()}, t AS (SELECT *, avg(y) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS trend FROM dense)
SELECT {TYPED}, {r('trend')} AS trend, {r('y - trend')} AS seasonal FROM t""",
    "acf_topk": f"WITH {ACF} SELECT event_type, CAST(rank AS INTEGER) AS rank, lag, {shown(['r', 'weight'])} FROM top",
    "delay_aggregate": f"""WITH {ACF}, d AS (SELECT a.event_type, a.ts, sum(t.weight * b.y) AS v, count(b.y) AS c FROM num a JOIN top t USING (event_type)
    LEFT JOIN num b ON b.event_type = a.event_type AND b.i = a.i - t.lag GROUP BY 1, 2)
SELECT {TYPED}, {r(f'CASE WHEN c = {TOP_LAGS} THEN v END')} AS delayed FROM d""",
    "seasonal_diff": f"""WITH {hourly()}, {COARSE.format(source='dense')}
SELECT {TYPED}, {r('y - lag(y, 1) OVER w - lag(y, 8) OVER w + lag(y, 9) OVER w')} AS diff FROM coarse WINDOW w AS (PARTITION BY event_type ORDER BY ts)""",
    "quantile_bands": f"""WITH {forecasts()}, q AS (SELECT event_type, hour(ts) AS h, quantile_cont(y - roll24, 0.1) AS q1, quantile_cont(y - roll24, 0.5) AS q5,
    quantile_cont(y - roll24, 0.9) AS q9 FROM fc WHERE split = 'validation' GROUP BY 1, 2)
SELECT fc.event_type, fc.ts, {r('roll24 + q1')} AS p10, {r('roll24 + q5')} AS p50, {r('roll24 + q9')} AS p90
FROM fc LEFT JOIN q ON q.event_type = fc.event_type AND q.h = hour(fc.ts) WHERE split = 'test'""",
    "seasonal_naive": f"""WITH {hourly()}, {COARSE.format(source='dense')}, {splits('coarse', 'sp')},
a AS (SELECT event_type, ts, position - c1 AS ahead, y FROM sp),
f AS (SELECT a.event_type, a.ts, a.ahead + 1 AS horizon, s.y AS y_pred FROM a LEFT JOIN a s ON s.event_type = a.event_type AND s.ahead = a.ahead % 8 - 8 WHERE a.ahead >= 0),
{splits('dense', 'hs')}
SELECT h.event_type, h.ts, f.horizon, {r('f.y_pred')} AS y_pred FROM hs h ASOF JOIN f ON h.event_type = f.event_type AND h.ts >= f.ts WHERE h.split = 'test'""",
    "blend_inverse_mae": f"WITH {forecasts()}, {BLEND.format(k='event_type')} SELECT {TYPED}, {r('blend')} AS blend FROM mixed",
    "rescaled_meta": user_mixed(),
    "df_stat": f"""WITH {hourly('user_id')}, d AS (SELECT user_id, y - lag(y) OVER w AS dy, lag(y) OVER w AS b FROM dense WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, regr_count(dy, b) AS n, regr_slope(dy, b) AS slope, regr_sxx(dy, b) AS sxx, regr_syy(dy, b) AS syy, regr_sxy(dy, b) AS sxy FROM d GROUP BY 1)
SELECT user_id, CAST(n AS BIGINT) AS n, {r('slope')} AS slope, {r('slope / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx)')} AS t_stat FROM s""",
}
