"""Queries of models fitted per series, and their SQL, which solves the same equations in another way."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from seriesloom.operators import (
    arma,
    clean,
    features,
    forecast,
    grid,
    metrics,
    models,
    reshape,
    scale,
    split,
    stacking,
    window_model,
)
from seriesloom.operators.chunks import running_totals, with_position
from seriesloom.plans import panels
from seriesloom.plans.oracle import TYPED, forecasts, hourly, r, scores, shown, splits
from seriesloom.plans.panels import MODELS, TYPES, USERS
from seriesloom.plans.queries import KT, STEP_3H, Query, _array_sum, _out, _test
from seriesloom.session import cut_lineage

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def window_forecast(spark, folder):
    """336 past hours to the next 24, fitted on the scaled training rows, for every hour of the test rows."""
    rows = split.chrono_split(panels.hourly_dense(spark, folder), TYPES).select(*KT, "y", "split")
    bounds = scale.minmax_fit(rows, TYPES, ["y"], F.col("split") == "train")
    small = scale.minmax_transform(rows, bounds, TYPES, ["y"])
    model = window_model.fit_windows(small.where(F.col("split") == "train"), TYPES, ["y"], "y")
    out = window_model.forecast_windows(small.drop("split"), model, TYPES, ["y"])
    steps = {"step_1": F.col("forecast")[0], "step_24": F.col("forecast")[23], "mean": _array_sum("forecast") / 24}
    level = scale.inverse_target(out.withColumns(steps), bounds, TYPES, list(steps), "y")
    return _out(level.join(_test(rows).select(*KT), KT, "left_semi"), KT, list(steps))


SHORT = 72


@query
def window_ridge(spark, folder):
    """72 past hours to the next one, split by windows: fitted on the first 70% of them, shown for the last tenth."""
    rows = with_position(panels.hourly_dense(spark, folder), TYPES, "ts")
    rows = rows.withColumn("split", split.split_label(F.col("position") - SHORT, F.col("n_rows") - SHORT)).select(*KT, "y", "split")
    model = window_model.fit_windows(rows.where(F.col("split") == "train").drop("split"), TYPES, ["y"], "y", SHORT, 1)
    out = window_model.forecast_windows(rows.drop("split"), model, TYPES, ["y"], SHORT)
    ahead = out.select(*TYPES, (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"), F.col("forecast")[0].alias("y_pred"))
    return _out(ahead.join(_test(rows).select(*KT), KT, "left_semi"), KT, ["y_pred"])


# --- seasonal autoregressions ---------------------------------------------------------------

CANDIDATES = ("n", "day_of_week_sin", "day_of_week_cos")
EXOG_SHAPE = arma.Shape("y", ("x1", "x2"), 1, 1, 8, 2, 1, 1, 0, 12)
PLAIN_SHAPE = arma.Shape("y", (), 1, 1, 8, 2, 1, 1, 0, 12)
AR_SHAPE = arma.Shape("y", (), 1, 1, 8, 3, 0, 1, 0)
EXOG_ORDERS = [(2, 1, 1, 0)]
HORIZON = 72


def _coarse(spark, folder, keys):
    rows = grid.resample_mean(panels.hourly_dense(spark, folder, keys), keys, ["y"], "3 hours")
    return split.chrono_split(rows, keys, step=STEP_3H).select(*keys, "ts", "y", "split")


@query
def seasonal_arma(spark, folder):
    """One step ahead with shocks and the two best of three exogenous columns, fitted before 70% and run after."""
    hours = grid.to_grid(panels.hourly(spark, folder), TYPES, unique=True).withColumnRenamed("total", "y")
    hours = features.add_cyclical(hours.fillna(0, ["y", "n"]).withColumn("n", F.col("n").cast("double")), parts=("day_of_week",))
    coarse = grid.resample_mean(hours, TYPES, ["y", *CANDIDATES], "3 hours")
    rows = split.chrono_split(coarse, TYPES, step=STEP_3H).drop("position", "n_rows")
    train = rows.where(F.col("split") == "train")
    best = [r["feature"] for r in forecast.rank_features(train, CANDIDATES, "y", 2).orderBy("rank").collect()]
    used = clean.select_features(rows, best, [*KT, "split", "y"]).toDF(*KT, "split", "y", "x1", "x2")
    fits = arma.fit_arma(used.where(F.col("split") == "train"), TYPES, EXOG_SHAPE, EXOG_ORDERS)
    made = arma.forecast_next(used, fits, TYPES, EXOG_SHAPE)
    return _out(made.join(used.where(F.col("split") != "train").select(*KT), KT, "left_semi"), KT, ["y_pred"])


@query
def arma_orders(spark, folder):
    """The order of each series by AIC."""
    rows = _coarse(spark, folder, TYPES)
    fits = arma.fit_arma(rows.where(F.col("split") == "train"), TYPES, PLAIN_SHAPE)
    return _out(fits, [*TYPES, "p", "q", "seasonal_p", "seasonal_q", "n"], ["aic"], 5)


@query
def arma_horizon(spark, folder):
    """From the end of the training rows on, each 3-hour step on the forecasts before it, carried to the hours."""
    dense = panels.hourly_dense(spark, folder)
    train = _coarse(spark, folder, TYPES).where(F.col("split") == "train")
    fits = arma.fit_arma(train, TYPES, PLAIN_SHAPE)
    made = arma.forecast_horizon(train, fits, TYPES, PLAIN_SHAPE, HORIZON)
    hours = _test(split.chrono_split(dense, TYPES)).select(*KT)
    return _out(grid.asof_fill(hours, made, TYPES, ["y_pred", "horizon"]), [*KT, "horizon"], ["y_pred"])


@query
def seasonal_ar(spark, folder):
    """Per-user seasonal autoregressions on 3-hour means with one plain and one seasonal difference,
    fitted before 70% and scored after."""
    rows = _coarse(spark, folder, USERS)
    fits = arma.fit_arma(rows.where(F.col("split") == "train"), USERS, AR_SHAPE)
    made = arma.forecast_next(rows.drop("split"), fits, USERS, AR_SHAPE)
    scored = rows.where(F.col("split") != "train").join(made, [*USERS, "ts"])
    return _out(metrics.scoreboard(scored.withColumnRenamed("y", "y_true"), USERS), [*USERS, "n"], ["mae", "rmse", "smape"], 5)


# --- unit roots -----------------------------------------------------------------------------

KINDS = ["event_type", "kind"]


def _flows_and_stocks(spark, folder):
    """The 3-hour means of each type, their running totals, and the running totals of these: differenced 0, 1 and 2 times."""
    rows = _coarse(spark, folder, TYPES).select(*KT, "y")
    parts, level = [], rows
    for kind in ("flow", "stock", "stock_of_stock"):
        parts.append(level.select("event_type", F.lit(kind).alias("kind"), "ts", "y"))
        level = running_totals(level, TYPES, "ts", "y", "stock", step=STEP_3H).select(*KT, F.col("stock").alias("y"))
    return parts[0].union(parts[1]).union(parts[2])


@query
def difference_order(spark, folder):
    return _out(arma.difference_order(_flows_and_stocks(spark, folder), KINDS, "y"), [*KINDS, "d", "lags", "n"], ["t_stat"])


@query
def difference_rounds(spark, folder):
    """Every series, differenced as often as its own test says."""
    rows = cut_lineage(_flows_and_stocks(spark, folder))
    made = arma.difference_rounds(rows, arma.difference_order(rows, KINDS, "y"), KINDS, "y")
    return _out(made, [*KINDS, "ts"], ["diff"], 5)


# --- learning from forecasts ----------------------------------------------------------------

FEATURES = ["naive1", "naive24", "roll24"]


def _folded(spark, folder):
    rows = panels.split_forecasts(spark, folder).select(*KT, "y", *FEATURES, "split")
    return stacking.blocked_folds(rows, TYPES)


@query
def fold_forecasts(spark, folder):
    """Every row by the regression of its fold, fitted on the other folds; test rows by that of all folds."""
    rows = _folded(spark, folder)
    made = stacking.fold_forecasts(rows, stacking.fit_folds(rows, TYPES, FEATURES, "y"), TYPES, FEATURES)
    return _out(made, [*KT, "fold"], ["base"])


@query
def nonnegative_meta(spark, folder):
    """The forecasts mixed by weights that are not negative, learnt and used on the scale of the training rows."""
    rows = panels.split_forecasts(spark, folder)
    return _out(_test(stacking.nonnegative_meta(rows, TYPES, "y", MODELS)), KT, ["meta"])


@query
def column_worth(spark, folder):
    """How much worse the base regression gets on the test rows when a column changes places."""
    rows = _folded(spark, folder)
    fits = stacking.fit_folds(rows, TYPES, FEATURES, "y").where(F.col("fold") == stacking.ALL)
    predict = lambda df: stacking.fold_forecasts(df, fits, TYPES, FEATURES, out="y_pred")
    return _out(stacking.permutation_importance(_test(rows), TYPES, FEATURES, "y", predict), ["rank", "feature"], ["importance"])


@query
def tree_meta(spark, folder):
    """Boosted trees on out-of-fold forecasts, stopped by the validation rows, scored on the test rows next to their parts."""
    rows = _folded(spark, folder)
    base = stacking.fold_forecasts(rows, stacking.fit_folds(rows, TYPES, FEATURES, "y"), TYPES, FEATURES)
    names = ["base", *FEATURES]
    model = models.fit_point(base, names, "y", rounds=50, depth=3)
    made = models.score(model, _test(base), names, [*KT, "y", *names]).withColumnRenamed("y_pred", "trees")
    return metrics.scoreboard(reshape.predictions_long(made, KT, "y", ["trees", *names]))


@query
def residual_draws(spark, folder):
    """Fifty draws of every test row from the training residuals of its series."""
    rows = panels.split_forecasts(spark, folder)
    index = forecast.residual_index(rows.where(F.col("split") == "train"), TYPES, "y", "roll24")
    return _out(forecast.residual_draws(_test(rows), index, TYPES, "roll24"), [*KT, "sample_id"], ["value"])


def solved(source: str, key: str, name: str = "solved") -> str:
    """``solved``: for each key the matrix ``m`` after elimination of its square left part; what stands right of it is the solution."""
    return f"""
{name}_steps({key}, k, m) AS (
    SELECT {key}, 0, m FROM {source}
    UNION ALL
    SELECT {key}, k + 1, list_transform(m, lambda row, i: CASE WHEN i = k + 1 THEN list_transform(row, lambda x: x / row[k + 1])
        ELSE list_transform(row, lambda x, j: x - row[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END)
    FROM {name}_steps WHERE k < len(m)
),
{name} AS (SELECT {key}, m FROM {name}_steps WHERE k = len(m))"""


def matrix(terms: Sequence[str], *targets: str) -> str:
    """Sums of products of the terms with each other and with the targets, as a list of rows."""
    row = lambda a: "[" + ", ".join(f"sum(({a}) * ({b}))::DOUBLE" for b in [*terms, *targets]) + "]"
    return "[" + ", ".join(row(a) for a in terms) + "]"


def dot(coefficients: str, terms: Sequence[str]) -> str:
    return " + ".join(f"{coefficients}[{i + 1}] * ({t})" for i, t in enumerate(terms))


def arma_sql(key: str, shape: arma.Shape, orders: Sequence[tuple[int, int, int, int]]) -> str:
    """From ``src`` (key, ts, i, fit, y, exogenous columns): ``rows`` with all terms, and ``best`` with the order and coefficients of each series."""
    over = f"OVER (PARTITION BY {key} ORDER BY i)"
    diff = lambda c: f"{c} - lag({c}, 1) {over} - lag({c}, 8) {over} + lag({c}, 9) {over}"
    inputs = [f"u_{x}" for x in shape.exog]
    changes = ", ".join(f"{diff(x)} AS u_{x}" for x in shape.exog)
    past = [f"l{k}" for k in range(1, shape.long + 1)]
    first = ["1", *past, *inputs]
    names = {"one": "1", "seasonal_ar": "sar", **{f"ar{k}": f"l{k}" for k in range(1, 4)}, **{f"ma{k}": f"e{k}" for k in range(1, 4)}}
    terms = [names.get(t, f"u_{t}") for t in shape.terms]
    deepest = max(shape.long, shape.max_p)
    lags = ", ".join(f"lag(w, {k}) {over} AS l{k}" for k in range(1, deepest + 1))
    shocks = "".join(f", lag(e, {k}) {over} AS e{k}" for k in range(1, shape.max_q + 1))
    whole = " AND ".join(f"{t} IS NOT NULL" for t in [*terms, "w"])
    if shape.shocks:
        long = f"""
first_m AS (SELECT {key}, {matrix(first, 'w')} AS m FROM lagged WHERE fit AND w IS NOT NULL AND {past[-1]} IS NOT NULL GROUP BY 1),
{solved('first_m', key, 'first')},
shocked AS (SELECT g.*, w - ({dot('c', first)}) AS e FROM lagged g JOIN (SELECT {key}, list_transform(m, lambda row: row[len(row)]) AS c FROM first) USING ({key})),"""
    else:
        long = "shocked AS (SELECT *, 0 AS e FROM lagged),"
    each = " UNION ALL ".join(
        f"SELECT {key} || '|{o}' AS id, {matrix([terms[i] for i in shape.used(*order)], 'w')} AS m, count(*) AS n, sum(w * w) AS ww FROM rows WHERE fit AND {whole} GROUP BY {key}"
        for o, order in enumerate(orders)
    )
    full = " ".join(
        f"WHEN {o} THEN [{', '.join(f'c[{shape.used(*order).index(i) + 1}]' if i in shape.used(*order) else '0' for i in range(len(terms)))}]"
        for o, order in enumerate(orders)
    )
    shown_orders = ", ".join(
        f"CASE o {' '.join(f'WHEN {o} THEN {order[j]}' for o, order in enumerate(orders))} END AS {name}"
        for j, name in enumerate(("p", "q", "seasonal_p", "seasonal_q"))
    )
    return f"""
changed AS (SELECT *, {diff('y')} AS w{', ' + changes if changes else ''} FROM src),
lagged AS MATERIALIZED (SELECT *, {lags} FROM changed), {long}
rows AS MATERIALIZED (SELECT *, lag(w, {shape.m}) {over} AS sar{shocks} FROM shocked),
order_m AS MATERIALIZED ({each}),
{solved('order_m', 'id', 'fitted')},
tried AS (
    SELECT split_part(id, '|', 1) AS k, split_part(id, '|', 2)::INTEGER AS o, o.n,
        list_transform(f.m, lambda row: row[len(row)]) AS c, list_transform(o.m, lambda row: row[len(row)]) AS moment, ww
    FROM fitted f JOIN order_m o USING (id)
),
judged AS (SELECT *, n * ln((ww - list_dot_product(c, moment)) / n) + 2 * (len(c) + 1) AS aic FROM tried),
best AS MATERIALIZED (
    SELECT k, n, aic, {shown_orders}, CASE o {full} END AS c
    FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY aic, o) AS place FROM judged) WHERE place = 1
),
made AS (SELECT g.*, y - w + {dot('c', terms)} AS y_pred FROM rows g JOIN best ON best.k = g.{key}::VARCHAR)"""


def coarse_sql(key: str) -> str:
    return f"""{hourly(key)},
coarse AS (SELECT {key}, time_bucket(INTERVAL '3 hours', ts) AS ts, avg(y) AS y FROM dense GROUP BY 1, 2),
{splits('coarse', 'sp', key)},
src AS (SELECT {key}, ts, position AS i, split = 'train' AS fit, y FROM sp)"""


CYCLE = ", ".join(f"avg({f}(2 * pi() * ((dayofweek(ts) + 6) % 7) / 7.0)) AS day_of_week_{f}" for f in ("sin", "cos"))


def _unit_root_sql() -> str:
    """``orders``: the number of differences of each series of ``src`` (key, i, y)."""
    over = "OVER (PARTITION BY key ORDER BY i)"
    rounds = "d0 AS (SELECT key, i, y - avg(y) OVER (PARTITION BY key) AS v0 FROM src)"
    rounds += "".join(f", d{d} AS (SELECT *, v{d - 1} - lag(v{d - 1}) {over} AS v{d} FROM d{d - 1})" for d in range(1, arma.MAX_D + 2))
    lags = range(1, arma.MAX_LAGS + 1)
    each = []
    for d in range(arma.MAX_D + 1):
        cells = ", ".join(f"lag(v{d + 1}, {k}) {over} AS l{k}" for k in lags)
        source = f"(SELECT key, v{d + 1} AS dy, lag(v{d}) {over} AS b, {cells} FROM d{arma.MAX_D + 1})"
        for k in range(arma.MAX_LAGS + 1):
            terms = ["1", "b", *[f"l{j}" for j in range(1, k + 1)]]
            each.append(f"""SELECT key || '|{d}|{k}' AS id, {matrix(terms, 'dy')} AS m, count(*) AS n, sum(dy * dy) AS ww
                FROM {source} WHERE l{arma.MAX_LAGS} IS NOT NULL GROUP BY key""")
    return f"""
{rounds},
order_m AS MATERIALIZED ({' UNION ALL '.join(each)}),
unit AS (SELECT id, list_transform(m, lambda row, i: list_append(row, CASE WHEN i = 2 THEN 1 ELSE 0 END)) AS m FROM order_m),
{solved('unit', 'id', 'fitted')},
tried AS (
    SELECT split_part(id, '|', 1) AS key, split_part(id, '|', 2)::INTEGER AS d, split_part(id, '|', 3)::INTEGER AS lags, n,
        len(f.m) AS size, list_transform(f.m, lambda row: row[len(row) - 1]) AS c, f.m[2][len(f.m) + 2] AS inv,
        ww - list_dot_product(list_transform(f.m, lambda row: row[len(row) - 1]), list_transform(o.m, lambda row: row[len(row)])) AS rest
    FROM fitted f JOIN order_m o USING (id)
),
chosen AS (SELECT *, c[2] / sqrt(rest / (n - size) * inv) AS t_stat, row_number() OVER (PARTITION BY key, d ORDER BY n * ln(rest / n) + 2 * size) AS place FROM tried),
orders AS (
    SELECT key, min_by(struct_pack(d := d, lags := lags, n := n, t_stat := t_stat), d) AS o FROM chosen
    WHERE place = 1 AND (t_stat < {arma.UNIT_ROOT_5} OR d = {arma.MAX_D}) GROUP BY key
)"""


FLOWS = f"""{hourly()},
coarse AS (SELECT event_type, time_bucket(INTERVAL '3 hours', ts) AS ts, avg(y) AS y FROM dense GROUP BY 1, 2),
stock AS (SELECT event_type, ts, sum(y) OVER (PARTITION BY event_type ORDER BY ts) AS y FROM coarse),
stock2 AS (SELECT event_type, ts, sum(y) OVER (PARTITION BY event_type ORDER BY ts) AS y FROM stock),
every AS (SELECT event_type, 'flow' AS kind, ts, y FROM coarse UNION ALL SELECT event_type, 'stock', ts, y FROM stock
    UNION ALL SELECT event_type, 'stock_of_stock', ts, y FROM stock2),
src AS (SELECT *, event_type || '/' || kind AS key, row_number() OVER (PARTITION BY event_type, kind ORDER BY ts) AS i FROM every)"""

FOLDED = f"""{forecasts()},
folded AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS p, count(*) OVER (PARTITION BY event_type) AS np FROM fc),
cuts AS (SELECT *, CAST(trunc(np * CAST(0.9 AS DOUBLE)) AS BIGINT) AS cut FROM folded),
rows AS MATERIALIZED (SELECT *, CASE WHEN p < cut THEN CAST(floor(p * {stacking.FOLDS} / cut) AS INTEGER) ELSE {stacking.ALL} END AS fold FROM cuts),
folds AS (SELECT unnest(range(-1, {stacking.FOLDS}))::INTEGER AS f),
fold_m AS (SELECT event_type || '|' || f AS id, {matrix(['1', *FEATURES], 'y')} AS m FROM rows, folds WHERE fold >= 0 AND fold <> f GROUP BY event_type, f),
{solved('fold_m', 'id')},
betas AS (SELECT split_part(id, '|', 1) AS event_type, split_part(id, '|', 2)::INTEGER AS fold, list_transform(m, lambda row: row[len(row)]) AS c FROM solved)"""

_SUBSETS = [[m for j, m in enumerate(MODELS) if bits >> j & 1] for bits in range(2 ** len(MODELS))]


def _weights_sql() -> str:
    """``best``: of all subsets of the models whose least-squares weights are not negative, that with the least squares left."""
    each = " UNION ALL ".join(
        f"SELECT event_type || '|{o}' AS id, {matrix(['1', *[f's_{m}' for m in used]], 's_y')} AS m, sum(s_y * s_y) AS ww FROM small WHERE split = 'validation' GROUP BY event_type"
        for o, used in enumerate(_SUBSETS)
    )
    full = " ".join(
        f"WHEN {o} THEN [c[1], {', '.join(f'c[{used.index(m) + 2}]' if m in used else '0' for m in MODELS)}]" for o, used in enumerate(_SUBSETS)
    )
    scaled = ", ".join(f"({c} - b.lo) / (b.hi - b.lo) AS s_{c}" for c in ("y", *MODELS))
    return f"""
b AS (SELECT event_type, min(y) AS lo, max(y) AS hi FROM fc WHERE split = 'train' GROUP BY 1),
small AS MATERIALIZED (SELECT event_type, ts, split, b.lo, b.hi, {scaled} FROM fc JOIN b USING (event_type)),
order_m AS MATERIALIZED ({each}),
{solved('order_m', 'id')},
tried AS (SELECT split_part(id, '|', 1) AS event_type, split_part(id, '|', 2)::INTEGER AS o, list_transform(s.m, lambda row: row[len(row)]) AS c,
    ww - list_dot_product(list_transform(s.m, lambda row: row[len(row)]), list_transform(o.m, lambda row: row[len(row)])) AS rest
    FROM solved s JOIN order_m o USING (id)),
best AS (SELECT event_type, min_by(CASE o {full} END, rest) AS c FROM tried WHERE coalesce(list_min(c[2:]), 0) >= 0 GROUP BY 1)"""


STRIDE = "coalesce(" + ", ".join(f"CASE WHEN n % {s} <> 0 THEN {s} END" for s in stacking.STRIDES) + ", 1)"

ORACLE = {
    "fold_forecasts": f"""
WITH RECURSIVE {FOLDED}
SELECT event_type, ts, fold, {r(dot('c', ['1', *FEATURES]))} AS base FROM rows JOIN betas USING (event_type, fold)""",
    "nonnegative_meta": f"""
WITH RECURSIVE {forecasts()}, {_weights_sql()}
SELECT event_type, ts, {r('(' + dot('c', ['1', *[f's_{m}' for m in MODELS]]) + ') * (hi - lo) + lo')} AS meta FROM small JOIN best USING (event_type) WHERE split = 'test'""",
    "column_worth": f"""
WITH RECURSIVE {FOLDED},
test AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM rows WHERE split = 'test'),
asks AS (SELECT t.*, c, (i * {STRIDE} + {stacking.OFFSET}) % n AS j FROM test t JOIN betas USING (event_type, fold)),
met AS (SELECT a.*, {', '.join(f'g.{f} AS p_{f}' for f in FEATURES)} FROM asks a JOIN test g ON g.event_type = a.event_type AND g.i = a.j),
plain AS (SELECT avg(abs(y - ({dot('c', ['1', *FEATURES])}))) AS mae FROM met),
worse AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, avg(abs(y - ({dot('c', ['1', *[f'p_{g}' if g == f else g for g in FEATURES]])}))) AS mae FROM met" for f in FEATURES)})
SELECT CAST(row_number() OVER (ORDER BY worse.mae DESC, feature) AS INTEGER) AS rank, feature, {r('worse.mae - plain.mae')} AS importance FROM worse, plain""",
    "residual_draws": f"""
WITH {forecasts()},
idx AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n, y - roll24 AS e FROM fc WHERE split = 'train'),
asks AS (SELECT f.event_type, f.ts, f.roll24, b.sample_id, n, CAST(floor(CAST('0x' || substr(md5(f.event_type || '|' || CAST(epoch(f.ts) AS BIGINT) || '|' || b.sample_id), 1, 12) AS BIGINT)
    / 281474976710656.0::DOUBLE * n) AS BIGINT) AS i
    FROM fc f JOIN (SELECT event_type, max(n) AS n FROM idx GROUP BY 1) USING (event_type), (SELECT unnest(range(50))::INTEGER AS sample_id) b WHERE f.split = 'test')
SELECT a.event_type, a.ts, a.sample_id, {r('a.roll24 + x.e')} AS value FROM asks a JOIN idx x ON x.event_type = a.event_type AND x.i = a.i""",
    "difference_order": f"""
WITH RECURSIVE {FLOWS}, {_unit_root_sql()}
SELECT split_part(key, '/', 1) AS event_type, split_part(key, '/', 2) AS kind, o.d AS d, o.lags AS lags, o.n AS n, {r('o.t_stat')} AS t_stat FROM orders""",
    "difference_rounds": f"""
WITH RECURSIVE {FLOWS}, {_unit_root_sql()},
made AS (SELECT s.*, CASE o.d WHEN 0 THEN y WHEN 1 THEN y - lag(y) OVER w ELSE y - 2 * lag(y) OVER w + lag(y, 2) OVER w END AS diff
    FROM src s JOIN orders USING (key) WINDOW w AS (PARTITION BY key ORDER BY i))
SELECT event_type, kind, ts, {r('diff', 5)} AS diff FROM made""",
    "window_ridge": f"""
WITH RECURSIVE {hourly()},
lists AS (SELECT event_type, list(y ORDER BY ts) AS vs, list(ts ORDER BY ts) AS times, count(*) AS n FROM dense GROUP BY 1),
w AS MATERIALIZED (SELECT event_type, t, vs[t - {SHORT - 1}:t] AS x, vs[t + 1] AS y, times[t + 1] AS ts,
    t - {SHORT} < CAST(trunc((n - {SHORT}) * CAST(0.7 AS DOUBLE)) AS BIGINT) AS train, t - {SHORT} >= CAST(trunc((n - {SHORT}) * CAST(0.9 AS DOUBLE)) AS BIGINT) AS test
    FROM lists, unnest(range({SHORT}, n)) u(t)),
cells AS (SELECT event_type, t, y, unnest(range(1, {SHORT + 1})) AS j, unnest(x) AS v FROM w WHERE train),
mx AS (SELECT event_type, j, avg(v) AS m, avg(y) AS my, count(*) AS n FROM cells GROUP BY 1, 2),
c AS MATERIALIZED (SELECT event_type, t, j, v - m AS v, y - my AS y, n FROM cells JOIN mx USING (event_type, j)),
gram AS (SELECT a.event_type, a.j AS i, b.j, sum(a.v * b.v) / any_value(a.n) + CASE WHEN a.j = b.j THEN {window_model.RIDGE} ELSE 0 END AS g
    FROM c a JOIN c b ON a.event_type = b.event_type AND a.t = b.t GROUP BY 1, 2, 3),
moment AS (SELECT event_type, j AS i, sum(v * y) / any_value(n) AS g FROM c GROUP BY 1, 2),
rows AS (SELECT g.event_type, g.i, list_append(list(g.g ORDER BY g.j), any_value(m.g)) AS row FROM gram g JOIN moment m ON m.event_type = g.event_type AND m.i = g.i GROUP BY 1, 2),
mat AS (SELECT event_type, list(row ORDER BY i) AS m FROM rows GROUP BY 1),
{solved('mat', 'event_type')},
beta AS (SELECT event_type, list_transform(m, lambda row: row[len(row)]) AS b FROM solved),
centre AS (SELECT event_type, list(m ORDER BY j) AS mx, any_value(my) AS my FROM mx GROUP BY 1)
SELECT w.event_type, ts, {r('my + list_dot_product(b, list_transform(x, lambda v, j: v - mx[j]))')} AS y_pred
FROM w JOIN beta ON beta.event_type = w.event_type JOIN centre ON centre.event_type = w.event_type WHERE test""",
    # The ridge in its dual form: weights are a mix of the training windows.
    "window_forecast": f"""
WITH RECURSIVE {hourly()}, {splits('dense', 'sp')},
b AS (SELECT event_type, min(y) AS lo, max(y) AS hi, count(*) AS n FROM sp WHERE split = 'train' GROUP BY 1),
lists AS (SELECT event_type, list((y - lo) / (hi - lo) ORDER BY position) AS vs, list(ts ORDER BY position) AS times,
    list(split ORDER BY position) AS parts, any_value(n) AS n FROM sp JOIN b USING (event_type) GROUP BY 1),
every AS (SELECT event_type, n, t, times[t + 1] AS ts, parts[t + 1] AS split, vs[t - 334:t + 1] AS x, vs[t + 2:t + 25] AS yy
    FROM lists, unnest(range(335, len(vs))) u(t)),
w AS MATERIALIZED (SELECT * FROM every WHERE t <= n - 25),
mx AS (SELECT event_type, list(a ORDER BY j) AS mx FROM (SELECT event_type, j, avg(x[j]) AS a FROM w, unnest(range(1, 337)) u(j) GROUP BY 1, 2) GROUP BY 1),
my AS (SELECT event_type, list(a ORDER BY j) AS my FROM (SELECT event_type, j, avg(yy[j]) AS a FROM w, unnest(range(1, 25)) u(j) GROUP BY 1, 2) GROUP BY 1),
c AS MATERIALIZED (SELECT event_type, t, list_transform(x, lambda v, j: v - mx[j]) AS xc, list_transform(yy, lambda v, j: v - my[j]) AS yc
    FROM w JOIN mx USING (event_type) JOIN my USING (event_type)),
sizes AS (SELECT event_type, count(*) AS n FROM c GROUP BY 1),
rows AS (SELECT p.event_type, p.t, list_concat(list(list_dot_product(p.xc, q.xc) + CASE WHEN p.t = q.t THEN {window_model.RIDGE} * s.n ELSE 0 END ORDER BY q.t),
    any_value(p.yc)) AS row FROM c p JOIN c q ON p.event_type = q.event_type JOIN sizes s ON s.event_type = p.event_type GROUP BY 1, 2),
mat AS (SELECT event_type, list(row ORDER BY t) AS m FROM rows GROUP BY 1),
{solved('mat', 'event_type')},
alpha AS (SELECT s.event_type, c.t, c.xc, s.m[c.t - 334][len(s.m) + 1:] AS a FROM solved s JOIN c USING (event_type)),
test AS (SELECT e.event_type, ts, list_transform(x, lambda v, j: v - mx[j]) AS xc, my FROM every e JOIN mx USING (event_type) JOIN my USING (event_type) WHERE split = 'test'),
made AS (SELECT t.event_type, t.ts, h, any_value(my[h]) + sum(list_dot_product(t.xc, p.xc) * p.a[h]) AS v
    FROM test t JOIN alpha p ON p.event_type = t.event_type, unnest(range(1, 25)) u(h) GROUP BY 1, 2, 3),
wide AS (SELECT event_type, ts, max(v) FILTER (WHERE h = 1) AS s1, max(v) FILTER (WHERE h = 24) AS s24, avg(v) AS s FROM made GROUP BY 1, 2),
out AS (SELECT event_type, ts, s1 * (hi - lo) + lo AS step_1, s24 * (hi - lo) + lo AS step_24, s * (hi - lo) + lo AS mean FROM wide JOIN b USING (event_type))
SELECT {TYPED}, {shown(['step_1', 'step_24', 'mean'])} FROM out""",
    "seasonal_arma": f"""
WITH RECURSIVE {hourly()},
hours AS (SELECT g.event_type, g.ts, coalesce(h.total, 0) AS y, coalesce(h.n, 0) AS n FROM grid g LEFT JOIN hourly h ON g.event_type = h.event_type AND g.ts = h.ts),
coarse AS (SELECT event_type, time_bucket(INTERVAL '3 hours', ts) AS ts, avg(y) AS y, avg(n) AS n, {CYCLE} FROM hours GROUP BY 1, 2),
{splits('coarse', 'sp')},
ranked AS (SELECT list(f ORDER BY r DESC, f) AS f FROM (
    {' UNION ALL '.join(f"SELECT '{c}' AS f, abs(corr({c}, y)) AS r FROM sp WHERE split = 'train'" for c in CANDIDATES)})),
src AS (SELECT event_type, ts, position AS i, split = 'train' AS fit, y,
    {', '.join(f"CASE f[{j}] {' '.join(f"WHEN '{c}' THEN {c}" for c in CANDIDATES)} END AS x{j}" for j in (1, 2))} FROM sp, ranked),
{arma_sql('event_type', EXOG_SHAPE, EXOG_ORDERS)}
SELECT {TYPED}, {r('y_pred')} AS y_pred FROM made WHERE NOT fit AND y_pred IS NOT NULL""",
    "arma_orders": f"""
WITH RECURSIVE {coarse_sql('event_type')}, {arma_sql('event_type', PLAIN_SHAPE, arma.grid_of(PLAIN_SHAPE))}
SELECT k AS event_type, p::INTEGER AS p, q::INTEGER AS q, seasonal_p::INTEGER AS seasonal_p, seasonal_q::INTEGER AS seasonal_q, n, {r('aic', 5)} AS aic FROM best""",
    "arma_horizon": f"""
WITH RECURSIVE {coarse_sql('event_type')}, {arma_sql('event_type', PLAIN_SHAPE, arma.grid_of(PLAIN_SHAPE))},
ends AS (SELECT k, max(ts) AS ts, list(y ORDER BY i)[-9:] AS ys, list(w ORDER BY i)[-8:] AS ws, list(e ORDER BY i)[-8:] AS es, any_value(c) AS c
    FROM rows JOIN best ON k = event_type WHERE fit GROUP BY 1),
ahead(k, h, ts, ys, ws, es, c, y_pred) AS (
    SELECT k, 0, ts, ys, ws, es, c, NULL::DOUBLE FROM ends
    UNION ALL
    SELECT k, h + 1, ts + INTERVAL 3 HOURS, list_append(ys[2:], v + ys[9] + ys[2] - ys[1]), list_append(ws[2:], v), list_append(es[2:], 0), c, v + ys[9] + ys[2] - ys[1]
    FROM (SELECT *, c[1] + c[2] * ws[8] + c[3] * ws[7] + c[4] * ws[1] + c[5] * es[8] AS v FROM ahead WHERE h < {HORIZON})
),
f AS (SELECT k AS event_type, ts, h AS horizon, y_pred FROM ahead WHERE h > 0),
{splits('dense', 'hs')}
SELECT h.event_type, h.ts, f.horizon, {r('f.y_pred')} AS y_pred FROM hs h ASOF LEFT JOIN f ON h.event_type = f.event_type AND h.ts >= f.ts WHERE h.split = 'test'""",
    "seasonal_ar": f"""
WITH RECURSIVE {coarse_sql('user_id')}, {arma_sql('user_id', AR_SHAPE, arma.grid_of(AR_SHAPE))}
SELECT user_id, {scores('y', 'y_pred').replace('1e6', '1e5')} FROM made WHERE NOT fit AND y_pred IS NOT NULL GROUP BY 1""",
}
