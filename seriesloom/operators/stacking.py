"""Learning from forecasts: out-of-fold base forecasts, meta-weights that may not be negative, and what a column is worth.

Folds are blocks of time. The base model of a fold is a regression on all rows outside it; its sums of products are the
series' sums less the fold's, so one pass over the rows gives the models of all folds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import timedelta
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators.chunks import HOUR, join_per_key, with_position
from seriesloom.operators.lagged import no_rows
from seriesloom.operators.scale import inverse_target, minmax_fit, scale_target
from seriesloom.operators.split import VALIDATION_END

FOLDS = 5
ALL = -1  # the fold of rows that no base model was fitted on


def blocked_folds(
    df: DataFrame, keys: Sequence[str], folds: int = FOLDS, end: float = VALIDATION_END, ts: str = "ts", step: timedelta = HOUR
) -> DataFrame:
    """Add ``fold``: 0, 1, ... by even blocks of time up to a share of the series, and ALL for the rows after it."""
    rows = with_position(df, keys, ts, step)
    cut = (F.col("n_rows") * F.lit(float(end))).cast("bigint")
    fold = F.when(F.col("position") < cut, F.floor(F.col("position") * folds / F.when(cut > 0, cut))).otherwise(F.lit(ALL))
    return rows.withColumn("fold", fold.cast("int")).drop("position", "n_rows")


def _upper(names: Sequence[Column]) -> list[Column]:
    return [names[i] * names[j] for i in range(len(names)) for j in range(i, len(names))]


def fit_folds(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, ts: str = "ts") -> DataFrame:
    """(keys, fold, n, centre, coefficients): a regression per fold on the rows of all other folds.

    The one of fold ALL is fitted on the rows of every fold. Rows with a NULL, and rows of fold ALL, are not learnt
    from. ``coefficients`` are those of one and of the features less ``centre``, the means of the series.
    """
    columns = [*features, target]
    known = df.where(F.col("fold") != ALL).dropna(subset=columns).select(*keys, ts, "fold", *columns)
    means = known.groupBy(*keys).agg(F.array(*[F.avg(c) for c in columns]).alias("centre"))
    rows = join_per_key(known, means, keys, ts)
    terms = [F.lit(1.0), *[F.col(c) - F.col("centre")[i] for i, c in enumerate(columns)]]
    sums = rows.groupBy(*keys, "fold").agg(
        F.array(*[F.sum(p) for p in _upper(terms)]).alias("products"), F.any_value("centre").alias("centre")
    )
    out = "fold int, n long, centre array<double>, coefficients array<double>"
    schema = T.StructType([*[df.schema[k] for k in keys], *T.StructType.fromDDL(out).fields])
    size = len(terms)
    upper = np.triu_indices(size)

    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        own = {int(f): np.asarray(p, float) for f, p in zip(part["fold"], part["products"], strict=True)}
        total, made = sum(own.values()), []
        for fold in [ALL, *sorted(own)]:
            gram = np.zeros((size, size))
            gram[upper] = total - own[fold] if fold != ALL else total
            gram = gram + gram.T - np.diag(np.diag(gram))
            if gram[0, 0] < size:
                continue
            beta = np.linalg.lstsq(gram[:-1, :-1], gram[:-1, -1], rcond=None)[0]
            row = dict(zip(keys, key, strict=False))
            made.append(row | {"fold": fold, "n": int(gram[0, 0]), "centre": part["centre"].iloc[0], "coefficients": beta})
        return pd.DataFrame(made)[schema.fieldNames()] if made else no_rows(schema)

    names = [*keys, "_one"]
    return sums.withColumn("_one", F.lit(1)).groupBy(*names).applyInPandas(solve, schema)


def fold_forecasts(df: DataFrame, models: DataFrame, keys: Sequence[str], features: Sequence[str], ts: str = "ts", out: str = "base") -> DataFrame:
    """Add the forecast of the model of each row's own fold, which has not seen the row's target."""
    rows = join_per_key(df, models.select(*keys, "fold", "centre", "coefficients"), [*keys, "fold"], ts)
    made = [F.col("coefficients")[i + 1] * (F.col(f) - F.col("centre")[i]) for i, f in enumerate(features)]
    made = sum(made, F.col("coefficients")[0] + F.col("centre")[len(features)])
    return rows.withColumn(out, made).select(*df.columns, out)


def nonnegative(gram: np.ndarray, moment: np.ndarray) -> np.ndarray:
    """The weights, none below 0, with the least squares left, from sums of products, by an active set.

    Weights enter one at a time, that with the steepest gain first; those that a step would take below 0 leave.
    """
    n = len(moment)
    beta, free = np.zeros(n), np.zeros(n, bool)
    scale = max(float(np.abs(moment).max(initial=0.0)), 1e-300)
    for _ in range(3 * n + 10):
        gain = np.where(free, -np.inf, moment - gram @ beta)
        enter = int(np.argmax(gain))
        if gain[enter] <= 1e-12 * scale:
            break
        free[enter] = True
        while True:
            wanted = np.zeros(n)
            wanted[free] = np.linalg.lstsq(gram[np.ix_(free, free)], moment[free], rcond=None)[0]
            below = free & (wanted <= 0)
            if not below.any():
                beta = wanted
                break
            step = np.min(beta[below] / np.where(beta[below] > wanted[below], beta[below] - wanted[below], 1.0))
            beta = beta + step * (wanted - beta)
            free &= ~(below & (beta <= 1e-15 * max(1.0, float(np.abs(beta).max()))))
            beta[~free] = 0.0
            if not free.any():
                break
    return beta


def fit_nonnegative(df: DataFrame, keys: Sequence[str], y: str, models: Sequence[str], fit_on: Column) -> DataFrame:
    """(keys, n, intercept, w_model...): least-squares weights of the models, none below 0, with an intercept."""
    known = df.where(fit_on).dropna(subset=[y, *models])
    names = [*models, y]
    pairs = [F.covar_pop(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in names]).alias("_means"), F.array(*pairs).alias("_products")
    )
    out = ", ".join(f"{c} double" for c in ("intercept", *[f"w_{m}" for m in models]))
    schema = T.StructType([*[sums.schema[k] for k in keys], *T.StructType.fromDDL(f"n long, {out}").fields])
    upper = np.triu_indices(len(names))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for means, products in zip(batch["_means"], batch["_products"], strict=True):
                gram = np.zeros((len(names), len(names)))
                gram[upper] = products
                gram = gram + gram.T - np.diag(np.diag(gram))
                weights = nonnegative(gram[:-1, :-1], gram[:-1, -1])
                found.append([means[-1] - weights @ means[:-1], *weights])
            fits = pd.DataFrame(found, columns=["intercept", *[f"w_{m}" for m in models]], dtype=float)
            yield pd.concat([batch[[*keys, "n"]].reset_index(drop=True), fits], axis=1)[schema.fieldNames()]

    return sums.mapInPandas(solve, schema)


def nonnegative_meta(
    df: DataFrame, keys: Sequence[str], y: str, models: Sequence[str], ts: str = "ts", split: str = "split", out: str = "meta"
) -> DataFrame:
    """Add the mix of the models by weights learnt on the validation rows, all on the scale of the training target.

    Intercept and weights are learnt on scaled values, so they must meet scaled forecasts, and the mix goes back to the
    level of the series: with forecasts on another scale the intercept is wrong.
    """
    bounds = minmax_fit(df, keys, [y], F.col(split) == "train")
    names = {f"_s_{c}": F.col(c) for c in (y, *models)}
    small = scale_target(df.withColumns(names), bounds, keys, list(names), y, ts)
    scaled = [f"_s_{m}" for m in models]
    weights = fit_nonnegative(small, keys, f"_s_{y}", scaled, F.col(split) == "validation")
    rows = join_per_key(small, weights, keys, ts)
    mixed = rows.withColumn(out, sum((F.col(f"w_{m}") * F.col(m) for m in scaled), F.col("intercept")))
    return inverse_target(mixed, bounds, keys, [out], y, ts).select(*df.columns, out)


# Steps of the permutations; the first that shares no factor with a series' length is used.
STRIDES = (7919, 104729, 1299709)
OFFSET = 17


def permuted(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], ts: str = "ts", step: timedelta = HOUR
) -> DataFrame:
    """Add ``permuted_c`` for each column: the values of other rows of the series, each used once.

    Row p takes from row (p * stride + offset) mod n, so every run and every partitioning gives the same values.
    """
    rows = with_position(df, keys, ts, step)
    n = F.col("n_rows")
    stride = F.coalesce(*[F.when(n % s != 0, F.lit(s)) for s in STRIDES], F.lit(1))
    asks = rows.withColumn("_from", (F.col("position") * stride + OFFSET) % n)
    gives = rows.select(*keys, F.col("position").alias("_from"), *[F.col(c).alias(f"permuted_{c}") for c in columns])
    met = asks.join(gives, [*keys, "_from"], "left")
    return met.select(*df.columns, *[f"permuted_{c}" for c in columns])


def permutation_importance(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    y: str,
    predict: Callable[[DataFrame], DataFrame],
    ts: str = "ts",
    step: timedelta = HOUR,
) -> DataFrame:
    """(rank, feature, importance): by how much the mean absolute error grows when a column's values change places.

    ``predict`` adds ``y_pred``. All columns are scored in one pass over the rows; ties go by name.
    """
    rows = permuted(df, keys, features, ts, step)
    swap = lambda f: rows.select(*[F.col(f"permuted_{c}").alias(c) if c == f else F.col(c) for c in df.columns], F.lit(f).alias("_swapped"))
    every = reduce(DataFrame.unionByName, [swap(f) for f in features], rows.select(*df.columns, F.lit("").alias("_swapped")))
    errors = predict(every).groupBy("_swapped").agg(F.avg(F.abs(F.col(y) - F.col("y_pred"))).alias("mae"))
    # A row per column: few rows, whatever the data.
    wide = errors.agg(F.max(F.when(F.col("_swapped") == "", F.col("mae"))).alias("_plain"), F.collect_list(F.struct("_swapped", "mae")).alias("_all"))
    cells = F.transform(
        F.filter("_all", lambda e: e["_swapped"] != ""), lambda e: F.struct((F.col("_plain") - e["mae"]).alias("order"), e["_swapped"].alias("feature"))
    )
    ranked = wide.select(F.posexplode(F.array_sort(cells)).alias("_i", "_c"))
    return ranked.select((F.col("_i") + 1).alias("rank"), F.col("_c.feature").alias("feature"), (-F.col("_c.order")).alias("importance"))
