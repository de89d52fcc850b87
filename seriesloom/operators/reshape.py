"""Wide and long forms of sensor and prediction tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_values(df: DataFrame, column: str) -> list:
    """The distinct values of a pivot column, which become column names of the wide table."""
    return sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())


def pivot_wide(
    df: DataFrame,
    ids: Sequence[str],
    column: str,
    measures: Sequence[str],
    values: Sequence | None = None,
) -> DataFrame:
    """One row per ``ids``, one column ``measure_value`` per measure and pivot value.

    Expects one row per (ids, column); see ``clean.dedupe_first``. Without ``values`` all values of
    the data become columns; where they are many, ``pivot_map`` needs no columns for them.
    """
    values = pivot_values(df, column) if values is None else values
    cells = [
        F.max(F.when(F.col(column) == F.lit(v), F.col(m))).alias(f"{m}_{v}".strip())
        for m in measures
        for v in values
    ]
    return df.groupBy(*ids).agg(*cells)


def pivot_map(df: DataFrame, ids: Sequence[str], column: str, measures: Sequence[str]) -> DataFrame:
    """One row per ``ids``, and per measure a map from pivot value to the measure, however many values.

    Expects one row per (ids, column). NULL pivot values and NULL measures have no entry.
    """
    entry = lambda m: F.when(F.col(column).isNotNull() & F.col(m).isNotNull(), F.struct(F.col(column), F.col(m)))
    return df.groupBy(*ids).agg(*[F.map_from_entries(F.collect_list(entry(m))).alias(m) for m in measures])


def melt(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "model", value: str = "value"
) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def residuals(df: DataFrame, actual: str, models: Sequence[str]) -> DataFrame:
    """Replace each model column by prediction minus actual."""
    return df.withColumns({m: F.col(m) - F.col(actual) for m in models})


def residuals_long(
    df: DataFrame, ids: Sequence[str], actual: str, models: Sequence[str]
) -> DataFrame:
    """Residuals as (ids, model, error)."""
    return melt(residuals(df, actual, models).select(*ids, *models), ids, models, "model", "error")


def predictions_long(
    df: DataFrame, ids: Sequence[str], actual: str, models: Sequence[str]
) -> DataFrame:
    """(ids, y_true, model, y_pred)."""
    return melt(
        df.select(*ids, F.col(actual).alias("y_true"), *models), [*ids, "y_true"], models, "model", "y_pred"
    )


def assemble_predictions(
    actual: DataFrame, predictions: Mapping[str, DataFrame], ids: Sequence[str], value: str = "y_pred"
) -> DataFrame:
    """One column per model on the times that every model and the actual series cover.

    A union and one aggregate: one shuffle however many models there are.
    """
    target = [c for c in actual.columns if c not in ids]
    if len(target) != 1:
        raise ValueError("actual needs the id columns and one value column")
    parts = [actual.select(*ids, F.lit(None).cast("string").alias("_model"), F.col(target[0]).alias("_v"))]
    parts += [
        p.select(*ids, F.lit(m).alias("_model"), F.col(value).alias("_v")) for m, p in predictions.items()
    ]
    stacked = reduce(DataFrame.unionByName, parts)
    of_actual = F.col("_model").isNull()
    cells = [F.max(F.when(of_actual, F.col("_v"))).alias(target[0])]
    cells += [F.max(F.when(F.col("_model") == m, F.col("_v"))).alias(m) for m in predictions]
    seen = F.count_if(of_actual) > 0
    for m in predictions:
        seen = seen & (F.count_if(F.col("_model") == m) > 0)
    return stacked.groupBy(*ids).agg(*cells, seen.alias("_seen")).where("_seen").drop("_seen")
