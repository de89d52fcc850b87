"""Projections, filters and cleaning of raw sensor tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.columns import as_col, python_strip


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop named columns; a name that is not there is an error."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"no such columns: {absent}")
    return df.drop(*columns)


def combine_columns(df: DataFrame, out: str, parts: Sequence[str]) -> DataFrame:
    """Replace ``parts`` by their sum; the sum is NULL where any part is NULL."""
    total: Column = as_col(parts[0])
    for part in parts[1:]:
        total = total + F.col(part)
    return df.withColumn(out, total).drop(*[p for p in parts if p != out])


def strip(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, python_strip(column))


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row of each key in the given order.

    An aggregate, not a ranking window: copies of one key are reduced before the shuffle, so a
    key that holds a large share of the rows does not land in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*[_pick(c, keys) for c in df.columns])


def _pick(column: str, keys: Sequence[str]) -> Column:
    return F.col(column) if column in keys else F.col("_first").getField(column).alias(column)


def drop_null(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.dropna("any", subset=list(subset))


def drop_null_any(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def features_target(
    df: DataFrame, target: str, ids: Sequence[str] = (), known_before: bool = False
) -> tuple[list[str], str]:
    """Names of the feature columns and the target.

    With ``known_before`` only lag, rolling and calendar columns are kept: columns that are
    known before the hour they describe.
    """
    names = [c for c in df.columns if c != target and c not in ids]
    if known_before:
        marks = ("_lag_", "_roll_mean_", "_roll_std_")
        ends = ("_sin", "_cos")
        names = [c for c in names if any(m in c for m in marks) or c.endswith(ends) or c == "is_holiday"]
    return names, target


def select_features(df: DataFrame, features: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    return df.select(*ids, *features)


def time_slice(
    df: DataFrame, start: datetime | Column, end: datetime | Column, ts: str = "ts"
) -> DataFrame:
    """Rows between two times, both included."""
    low = start if isinstance(start, Column) else F.lit(start).cast("timestamp_ntz")
    high = end if isinstance(end, Column) else F.lit(end).cast("timestamp_ntz")
    return df.where(F.col(ts).between(low, high))


def nth_row(df: DataFrame, n: int, position: str = "position") -> DataFrame:
    """Row number ``n`` (from 0) of every series; see ``chunks.with_position``."""
    return df.where(F.col(position) == n)
