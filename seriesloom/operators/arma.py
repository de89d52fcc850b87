"""Seasonal autoregressions with moving-average terms and exogenous columns, one per series.

The series is differenced (plain and seasonal); exogenous columns are differenced alike. Moving-average terms are
fitted in two stages: a long autoregression gives estimates of the shocks, and the differenced series is
then regressed on its own past, on past shocks and on the exogenous columns. Both stages read chunks of
consecutive rows and send one sum of products per pair of terms; all orders of the grid are solved on one
such matrix per series, and the least AIC wins. Forecasts run one step ahead over given rows, or over a horizon
from the end of a series, each step on the forecasts before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from itertools import product
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators.chunks import join_per_key, row_window
from seriesloom.operators.decompose import difference_weights
from seriesloom.operators.lagged import chunk_size, number_rows, over_chunks
from seriesloom.session import cut_lineage

# Season of a 3-hour series, largest orders tried.
SEASON = 8
MAX_ORDER = 3
STEP = timedelta(hours=3)

FIT = "p int, q int, seasonal_p int, seasonal_q int, n long, aic double, coefficients array<double>"


class Shape(NamedTuple):
    """What is regressed on what. ``coefficients`` of a fit are in the order of ``terms``."""

    column: str
    exog: tuple[str, ...] = ()
    d: int = 1
    seasonal_d: int = 1
    m: int = SEASON
    max_p: int = MAX_ORDER
    max_q: int = MAX_ORDER
    max_seasonal_p: int = 1
    max_seasonal_q: int = 1
    long_order: int = 0  # lags of the first stage; 0: one season and the largest order

    @property
    def weights(self) -> dict[int, int]:
        return difference_weights(self.d, self.seasonal_d, self.m)

    @property
    def shocks(self) -> bool:
        return self.max_q > 0 or self.max_seasonal_q > 0

    @property
    def long(self) -> int:
        return (self.long_order or self.m + max(self.max_p, self.max_q)) if self.shocks else 0

    @property
    def past(self) -> int:
        """The deepest lag of the second stage."""
        return max(self.max_p, self.max_q, self.m if self.max_seasonal_p or self.max_seasonal_q else 0)

    @property
    def reach(self) -> int:
        """Rows before a row that its regression reads."""
        return max(self.weights) + self.long + self.past

    @property
    def terms(self) -> list[str]:
        own = [f"ar{k}" for k in range(1, self.max_p + 1)] + ["seasonal_ar"] * self.max_seasonal_p
        shocks = [f"ma{k}" for k in range(1, self.max_q + 1)] + ["seasonal_ma"] * self.max_seasonal_q
        return ["one", *own, *shocks, *self.exog]

    def used(self, p: int, q: int, seasonal_p: int, seasonal_q: int) -> list[int]:
        """Places of the terms of an order."""
        gone = {f"ar{k}" for k in range(p + 1, self.max_p + 1)} | {f"ma{k}" for k in range(q + 1, self.max_q + 1)}
        gone |= set() if seasonal_p else {"seasonal_ar"}
        gone |= set() if seasonal_q else {"seasonal_ma"}
        return [i for i, name in enumerate(self.terms) if name not in gone]


def back(x: np.ndarray, k: int) -> np.ndarray:
    """The values k rows earlier; NaN before the first."""
    if k == 0:
        return x
    out = np.full(len(x), np.nan)
    out[k:] = x[: len(x) - k]
    return out


def differenced(x: np.ndarray, weights: dict[int, int]) -> np.ndarray:
    return sum(w * back(x, k) for k, w in weights.items())


def long_terms(shape: Shape, change: np.ndarray, exog: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.ones(len(change)), *[back(change, k) for k in range(1, shape.long + 1)], *exog], 1)


def all_terms(shape: Shape, change: np.ndarray, shock: np.ndarray, exog: list[np.ndarray]) -> np.ndarray:
    own = [back(change, k) for k in range(1, shape.max_p + 1)] + [back(change, shape.m)] * shape.max_seasonal_p
    shocks = [back(shock, k) for k in range(1, shape.max_q + 1)] + [back(shock, shape.m)] * shape.max_seasonal_q
    return np.stack([np.ones(len(change)), *own, *shocks, *exog], 1)


def parts(shape: Shape, values: np.ndarray, told: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Level, change, shock and exogenous changes of the rows of a chunk."""
    values = values - np.asarray(told["centre"], float)
    level, *exog = values.T
    change, exog = differenced(level, shape.weights), [differenced(x, shape.weights) for x in exog]
    shock = np.zeros(len(change))
    if shape.shocks:
        shock = change - long_terms(shape, change, exog) @ np.asarray(told["long"], float)
    return level, change, shock, exog


def products(rows: np.ndarray, home: int) -> dict[str, np.ndarray]:
    """Sums of products of all pairs of columns, over the rows from ``home`` on that are complete."""
    rows = rows[home:]
    rows = rows[~np.isnan(rows).any(1)]
    i, j = np.triu_indices(rows.shape[1])
    return {"i": i, "j": j, "value": (rows.T @ rows)[i, j], "n": np.full(len(i), len(rows))}


def _matrices(sums: DataFrame, keys: Sequence[str], solve, out: str, extra: DataFrame | None = None) -> DataFrame:
    """One symmetric matrix per series, solved: ``solve`` takes it and the number of rows."""
    total = sums.groupBy(*keys, "i", "j").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    schema = T.StructType([*[sums.schema[k] for k in keys], *T.StructType.fromDDL(out).fields])

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        size = int(part["j"].max()) + 1
        gram = np.zeros((size, size))
        gram[part["i"], part["j"]] = gram[part["j"], part["i"]] = part["value"]
        row = dict(zip(keys, key, strict=False)) | solve(gram, int(part["n"].iloc[0]))
        return pd.DataFrame([row])[schema.fieldNames()]

    names = [*keys, "_one"]
    return total.withColumn("_one", F.lit(1)).groupBy(*names).applyInPandas(run, schema)


def least_squares(gram: np.ndarray, used: list[int]) -> tuple[np.ndarray, float]:
    """Coefficients of the used terms for the last one, and the squares left."""
    normal, moment = gram[np.ix_(used, used)], gram[used, -1]
    try:
        beta = np.linalg.solve(normal, moment)
    except np.linalg.LinAlgError:
        beta = np.linalg.lstsq(normal, moment, rcond=None)[0]
    return beta, gram[-1, -1] - beta @ moment


def best_order(shape: Shape, gram: np.ndarray, n: int, orders: Sequence[tuple[int, int, int, int]]) -> dict:
    """The order with the least AIC; of equal ones the first."""
    best = None
    for order in orders:
        used = shape.used(*order)
        beta, left = least_squares(gram, used)
        left = max(left, 1e-12 * max(gram[-1, -1], 1e-300))
        aic = n * np.log(left / max(n, 1)) + 2 * (len(used) + 1)
        if best is None or aic < best["aic"] - 1e-9:
            full = np.zeros(len(shape.terms))
            full[used] = beta
            names = dict(zip(("p", "q", "seasonal_p", "seasonal_q"), order, strict=True))
            best = {**names, "n": n, "aic": float(aic), "coefficients": full.tolist()}
    return best


def grid_of(shape: Shape) -> list[tuple[int, int, int, int]]:
    return list(product(*[range(n + 1) for n in (shape.max_p, shape.max_q, shape.max_seasonal_p, shape.max_seasonal_q)]))


def _numbered(df: DataFrame, keys: Sequence[str], shape: Shape, ts: str, step: timedelta, chunk_steps: int | None) -> DataFrame:
    columns = [shape.column, *shape.exog]
    return number_rows(df.dropna(subset=columns), keys, columns, ts, step, chunk_steps)


def fit_arma(
    df: DataFrame,
    keys: Sequence[str],
    shape: Shape,
    orders: Sequence[tuple[int, int, int, int]] | None = None,
    ts: str = "ts",
    step: timedelta = STEP,
    chunk_steps: int | None = None,
) -> DataFrame:
    """(keys, p, q, seasonal_p, seasonal_q, n, aic, coefficients, long, centre): the best order of each series.

    ``orders``: (p, q, seasonal p, seasonal q) to choose from; all up to the shape's largest ones if None. All
    are fitted on the same rows, those with every term of the shape. Rows with a NULL are left out; lags count
    rows. A series with fewer rows than terms gets the least-norm solution. Runs jobs when called.
    """
    columns = [shape.column, *shape.exog]
    rows = cut_lineage(_numbered(df, keys, shape, ts, step, chunk_steps).drop(ts))
    told = rows.groupBy(*keys).agg(F.array(*[F.avg(c) for c in columns]).alias("centre"))
    size = chunk_size(shape.reach, chunk_steps)
    out = "i int, j int, value double, n long"
    if shape.shocks:

        def first(values: np.ndarray, at: int, home: int, told: pd.Series) -> dict[str, np.ndarray]:
            _, change, _, exog = parts(shape._replace(max_q=0, max_seasonal_q=0), values, told)
            return products(np.column_stack([long_terms(shape, change, exog), change]), home)

        def solve(gram: np.ndarray, n: int) -> dict:
            return {"long": least_squares(gram, list(range(len(gram) - 1)))[0].tolist()}

        sums = over_chunks(rows, keys, columns, first, out, shape.reach, size, told)
        long = _matrices(sums, keys, solve, "long array<double>")
    else:
        long = told.select(*keys, F.array().cast("array<double>").alias("long"))
    one = F.lit(1).alias("_one")
    told = cut_lineage(told.select("*", one).join(long.select("*", one), [*keys, "_one"]).drop("_one"))

    def second(values: np.ndarray, at: int, home: int, told: pd.Series) -> dict[str, np.ndarray]:
        _, change, shock, exog = parts(shape, values, told)
        return products(np.column_stack([all_terms(shape, change, shock, exog), change]), home)

    grid = list(orders) if orders is not None else grid_of(shape)
    sums = over_chunks(rows, keys, columns, second, out, shape.reach, size, told)
    best = _matrices(sums, keys, lambda gram, n: best_order(shape, gram, n, grid), FIT)
    return best.select("*", one).join(told.select("*", one), [*keys, "_one"]).drop("_one")


def forecast_next(
    df: DataFrame,
    fits: DataFrame,
    keys: Sequence[str],
    shape: Shape,
    ts: str = "ts",
    step: timedelta = STEP,
    chunk_steps: int | None = None,
) -> DataFrame:
    """(keys, ts, y_pred): each row from the rows before it, on the level of the series; rows with too little past are left out."""
    us = F.unix_micros(F.col(ts).cast("timestamp")).alias("_us")  # whole numbers below 2**53
    columns = [shape.column, *shape.exog]
    rows = _numbered(df, keys, shape, ts, step, chunk_steps).select(*keys, "position", us, *columns)

    def run(values: np.ndarray, at: int, home: int, told: pd.Series) -> dict[str, np.ndarray]:
        level, change, shock, exog = parts(shape, values[:, 1:], told)
        made = all_terms(shape, change, shock, exog) @ np.asarray(told["coefficients"], float)
        made = made + (level - change) + told["centre"][0]
        good = ~np.isnan(made)
        good[:home] = False
        return {"_us": values[good, 0].astype(np.int64), "y_pred": made[good]}

    told = fits.select(*keys, "coefficients", "long", "centre")
    made = over_chunks(rows, keys, ["_us", *columns], run, "_us long, y_pred double", shape.reach, chunk_size(shape.reach, chunk_steps), told)
    return made.select(*keys, F.timestamp_micros("_us").cast(df.schema[ts].dataType).alias(ts), "y_pred")


def last_state(
    df: DataFrame, fits: DataFrame, keys: Sequence[str], shape: Shape, ts: str = "ts", step: timedelta = STEP, chunk_steps: int | None = None
) -> DataFrame:
    """(keys, ts, state): the last time of each series and its last rows of (position, level, change, shock, exog), by position."""
    keep = max(shape.reach, 1)
    columns = [shape.column, *shape.exog]
    rows = _numbered(df, keys, shape, ts, step, chunk_steps)
    ends = rows.where(F.col("position") >= F.col("n_rows") - keep - shape.reach)
    first = F.greatest(F.col("n_rows") - keep - shape.reach, F.lit(0))
    ends = ends.withColumn("position", F.col("position") - first).select(*keys, ts, "position", "n_rows", *columns)

    def run(values: np.ndarray, at: int, home: int, told: pd.Series) -> dict[str, np.ndarray]:
        level, change, shock, exog = parts(shape, values, told)
        place = np.arange(len(values))
        tail = place >= len(values) - keep
        return {"place": place[tail], "level": level[tail], "change": change[tail], "shock": shock[tail], "exog": list((values[:, 1:] - np.asarray(told["centre"], float)[1:])[tail])}

    told = fits.select(*keys, "long", "centre")
    # All these rows lie in one chunk.
    out = "place long, level double, change double, shock double, exog array<double>"
    made = over_chunks(ends, keys, columns, run, out, 0, 2 * keep + shape.reach + 1, told)
    state = made.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "level", "change", "shock", "exog"))).alias("state"))
    last = ends.groupBy(*keys).agg(F.max(ts).alias(ts))
    one = F.lit(1).alias("_one")
    return state.select("*", one).join(last.select("*", one), [*keys, "_one"]).drop("_one")


def _weighted(weights: Sequence[tuple[Column, Column]]) -> Column:
    return sum((w * x for w, x in weights), F.lit(0.0))


def forecast_horizon(
    df: DataFrame,
    fits: DataFrame,
    keys: Sequence[str],
    shape: Shape,
    horizon: int,
    future: DataFrame | None = None,
    ts: str = "ts",
    step: timedelta = STEP,
    chunk_steps: int | None = None,
) -> DataFrame:
    """(keys, ts, horizon, y_pred): ``horizon`` steps after the last row of each series, one after the other.

    A step reads the forecasts before it where it would read values; shocks to come are 0. Both differences are
    undone step by step. With exogenous columns ``future`` (keys, ts, exog) must have the next ``horizon`` rows of each
    series; a series with fewer is forecast as far as they go. The steps of a series are one fold over an array.
    """
    state = last_state(df, fits, keys, shape, ts, step, chunk_steps)
    one = F.lit(1).alias("_one")
    names = [*keys, "_one"]
    rows = state.select("*", one).join(fits.select(*keys, "coefficients", "centre", one), names)
    weights, reach = shape.weights, max(shape.weights)
    place = {name: i for i, name in enumerate(shape.terms)}
    if shape.exog:
        ahead = join_per_key(future.select(*keys, ts, *shape.exog), state.select(*keys, F.col(ts).alias("_last")), keys, ts)
        known = ahead.where(F.col(ts) > F.col("_last")).dropna(subset=list(shape.exog))
        coming = known.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct(ts, F.array(*shape.exog).alias("x")))), 1, horizon).alias("_coming"))
        rows = rows.join(coming.select("*", one), names)
        past = F.transform(F.slice("state", -reach, reach), lambda s: s["exog"]) if reach else F.array().cast("array<array<double>>")
        centre = F.slice("centre", 2, len(shape.exog))
        new = F.transform("_coming", lambda r: F.zip_with(r["x"], centre, lambda x, c: x - c))
        rows = rows.withColumn("_path", F.concat(past, new))
        change = lambda h, j: _weighted([(F.lit(float(w)), F.col("_path")[h + F.lit(reach - k)][j]) for k, w in weights.items()])
        added = lambda h: _weighted([(F.col("coefficients")[place[x]], change(h, j)) for j, x in enumerate(shape.exog)])
        count = F.size("_coming")
        steps = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), added))
        rows = rows.withColumn("_steps", steps).where(count > 0)
    else:
        rows = rows.withColumn("_steps", F.array_repeat(F.lit(0.0), horizon))
    take = lambda field, n: F.transform(F.slice("state", -n, n), lambda s: s[field]) if n else F.array().cast("array<double>")
    rows = rows.withColumns({"_y": take("level", reach), "_w": take("change", shape.past), "_e": take("shock", shape.past)})
    begin = F.struct(F.col("_y").alias("y"), F.col("_w").alias("w"), F.col("_e").alias("e"), F.array().cast("array<double>").alias("out"))
    push = lambda a, x, n: F.slice(F.concat(a, F.array(x)), -n, n) if n else a

    def next_step(s: Column, x: Column) -> Column:
        read = {f"ar{k}": ("w", k) for k in range(1, shape.max_p + 1)} | {f"ma{k}": ("e", k) for k in range(1, shape.max_q + 1)}
        read |= {"seasonal_ar": ("w", shape.m), "seasonal_ma": ("e", shape.m)}
        own = [(F.col("coefficients")[i], F.element_at(s[read[t][0]], -read[t][1])) for t, i in place.items() if t in read]
        change = F.col("coefficients")[0] + _weighted(own) + x
        level = change + _weighted([(F.lit(float(-w)), F.element_at(s["y"], -k)) for k, w in weights.items() if k])
        return F.struct(
            push(s["y"], level, reach).alias("y"),
            push(s["w"], change, shape.past).alias("w"),
            push(s["e"], F.lit(0.0), shape.past).alias("e"),
            F.concat(s["out"], F.array(level)).alias("out"),
        )

    path = F.aggregate("_steps", begin, next_step, lambda s: s["out"])
    enough = F.size("state") >= max(shape.reach, 1)
    out = rows.where(enough).select(*keys, F.col(ts).alias("_last"), F.col("centre")[0].alias("_centre"), F.posexplode(path).alias("_h", "_v"))
    ahead = F.unix_micros(F.col("_last").cast("timestamp")) + (F.col("_h") + 1) * F.lit(round(step.total_seconds() * 1e6))
    return out.select(*keys, F.timestamp_micros(ahead).cast(df.schema[ts].dataType).alias(ts), (F.col("_h") + 1).alias("horizon"), (F.col("_v") + F.col("_centre")).alias("y_pred"))


# 5% point of the unit-root statistic with a constant, most rounds of differencing, most lagged changes.
UNIT_ROOT_5 = -2.86
MAX_D = 2
MAX_LAGS = 3


def unit_root(gram: np.ndarray, n: int, max_lags: int) -> tuple[int, float | None]:
    """Lag count by AIC, and the t statistic of the level: none where nothing changes, infinite where every fit is exact.

    ``gram`` holds the products of: one, the level before, ``max_lags`` earlier changes, the change.
    """
    best = None
    if gram[-1, -1] <= 0:
        return 0, None
    for lags in range(max_lags + 1):
        used = list(range(2 + lags))
        normal, moment = gram[np.ix_(used, used)], gram[used, -1]
        try:
            beta, inverse = np.linalg.solve(normal, moment), np.linalg.inv(normal)
        except np.linalg.LinAlgError:
            continue
        left = gram[-1, -1] - beta @ moment
        if n <= len(used) or left <= 1e-12 * gram[-1, -1] or inverse[1, 1] <= 0:
            continue
        aic = n * np.log(left / n) + 2 * len(used)
        if best is None or aic < best[0] - 1e-9:
            best = (aic, lags, float(beta[1] / np.sqrt(left / (n - len(used)) * inverse[1, 1])))
    return best[1:] if best else (0, np.inf)


def difference_order(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    max_d: int = MAX_D,
    max_lags: int = MAX_LAGS,
    critical: float = UNIT_ROOT_5,
    ts: str = "ts",
    step: timedelta = STEP,
    chunk_steps: int | None = None,
) -> DataFrame:
    """(keys, d, lags, n, t_stat): how often each series must be differenced until a unit root is rejected.

    The augmented test regresses the change on a constant, the level before and up to ``max_lags`` earlier changes;
    AIC chooses their number. The test of 0, 1, ... ``max_d`` differences reads the same chunks at once, and a series
    stops at the first one that rejects, or whose changes do not vary (no statistic), else at ``max_d``. Rows with a
    NULL are left out.
    """
    shape = Shape(column, (), 0, 0)
    rows = cut_lineage(_numbered(df, keys, shape, ts, step, chunk_steps).drop(ts))
    told = rows.groupBy(*keys).agg(F.avg(column).alias("centre"))
    reach = max_d + 1 + max_lags

    def run(values: np.ndarray, at: int, home: int, told: pd.Series) -> dict[str, np.ndarray]:
        level, parts = values[:, 0] - told["centre"], []
        for d in range(max_d + 1):
            change = level - back(level, 1)
            terms = [np.ones(len(level)), back(level, 1), *[back(change, k) for k in range(1, max_lags + 1)], change]
            parts.append(products(np.column_stack(terms), home) | {"d": np.full((max_lags + 3) * (max_lags + 4) // 2, d)})
            level = change
        return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}

    sums = over_chunks(rows, keys, [column], run, "d int, i int, j int, value double, n long", reach, chunk_size(reach, chunk_steps), told)

    def solve(gram: np.ndarray, n: int) -> dict:
        lags, t = unit_root(gram, n, max_lags)
        return {"n": n, "lags": lags, "t_stat": t}

    tests = _matrices(sums, [*keys, "d"], solve, "n long, lags int, t_stat double")
    stops = F.col("t_stat").isNull() | (F.col("t_stat") < critical) | (F.col("d") == max_d)
    first = tests.where(stops).groupBy(*keys).agg(F.min_by(F.struct("d", "lags", "n", "t_stat"), "d").alias("_t"))
    return first.select(*keys, "_t.*")


def difference_rounds(
    df: DataFrame,
    orders: DataFrame,
    keys: Sequence[str],
    column: str,
    max_d: int = MAX_D,
    ts: str = "ts",
    step: timedelta = STEP,
    out: str = "diff",
    chunk_steps: int | None = None,
) -> DataFrame:
    """Add the series differenced as often as its row of ``orders`` says, NULL at its start."""

    def build(spec) -> dict[str, Column]:
        def once(d: int) -> Column:
            return _weighted([(F.lit(float(w)), F.lag(column, k).over(spec) if k else F.col(column)) for k, w in difference_weights(d, 0, 1).items()])

        return {f"_d{d}": once(d) for d in range(max_d + 1)}

    rows = row_window(join_per_key(df, orders.select(*keys, F.col("d").alias("_d")), keys, ts), keys, ts, step, max_d, 0, build, chunk_steps)
    chosen = F.coalesce(*[F.when(F.col("_d") == d, F.col(f"_d{d}")) for d in range(max_d + 1)])
    return rows.withColumn(out, chosen).select(*df.columns, out)
