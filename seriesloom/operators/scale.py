"""Min-max scaling with bounds kept as a table, one row per series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.chunks import join_per_key


def minmax_fit(df: DataFrame, keys: Sequence[str], columns: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    """Bounds ``lo_c`` / ``hi_c`` per series; NULLs are ignored.

    ``fit_on`` chooses the rows that count, e.g. ``F.col("split") == "train"``. A series without
    such rows keeps NULL bounds.
    """
    used = {c: F.when(fit_on, F.col(c)) if fit_on is not None else F.col(c) for c in columns}
    aggs = []
    for c, value in used.items():
        aggs += [F.min(value).alias(f"lo_{c}"), F.max(value).alias(f"hi_{c}")]
    return df.groupBy(*keys).agg(*aggs)


def scaled(value: str | Column, lo: str | Column, hi: str | Column) -> Column:
    """Position inside the bounds; a column of one value is scaled to 0 at that value."""
    value, lo, hi = (F.col(c) if isinstance(c, str) else c for c in (value, lo, hi))
    width = hi - lo
    return F.when(width == 0, value - lo).otherwise((value - lo) / F.when(width != 0, width))


def unscaled(value: str | Column, lo: str | Column, hi: str | Column) -> Column:
    value, lo, hi = (F.col(c) if isinstance(c, str) else c for c in (value, lo, hi))
    width = hi - lo
    return value * F.when(width == 0, F.lit(1.0)).otherwise(width) + lo


def _with_bounds(df: DataFrame, bounds: DataFrame, keys: Sequence[str], columns: Sequence[str], spread) -> DataFrame:
    needed = bounds.select(*keys, *[f"{side}_{c}" for c in columns for side in ("lo", "hi")])
    return join_per_key(df, needed, keys, spread, "left")


def minmax_transform(
    df: DataFrame, bounds: DataFrame, keys: Sequence[str], columns: Sequence[str], ts: str = "ts"
) -> DataFrame:
    rows = _with_bounds(df, bounds, keys, columns, ts)
    return rows.withColumns({c: scaled(c, f"lo_{c}", f"hi_{c}") for c in columns}).select(*df.columns)


def minmax_inverse(
    df: DataFrame, bounds: DataFrame, keys: Sequence[str], columns: Sequence[str], ts: str = "ts"
) -> DataFrame:
    rows = _with_bounds(df, bounds, keys, columns, ts)
    return rows.withColumns({c: unscaled(c, f"lo_{c}", f"hi_{c}") for c in columns}).select(*df.columns)


def _as_target(
    df: DataFrame, bounds: DataFrame, keys: Sequence[str], columns: Sequence[str], target: str, ts: str, formula
) -> DataFrame:
    rows = _with_bounds(df, bounds, keys, [target], ts)
    changed: Mapping[str, Column] = {c: formula(c, f"lo_{target}", f"hi_{target}") for c in columns}
    return rows.withColumns(dict(changed)).select(*df.columns)


def scale_target(
    df: DataFrame, bounds: DataFrame, keys: Sequence[str], columns: Sequence[str], target: str, ts: str = "ts"
) -> DataFrame:
    """Scale prediction columns with the bounds of the target they predict."""
    return _as_target(df, bounds, keys, columns, target, ts, scaled)


def inverse_target(
    df: DataFrame, bounds: DataFrame, keys: Sequence[str], columns: Sequence[str], target: str, ts: str = "ts"
) -> DataFrame:
    return _as_target(df, bounds, keys, columns, target, ts, unscaled)
