"""Calendar, lag and rolling features of series on a regular grid."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from seriesloom.functions.columns import CALENDAR_PERIODS, cyclical
from seriesloom.operators.chunks import HOUR, grid_window

# The lags and rolling widths, in hours, used by default.
LAGS = (1, 2, 3, 24, 48, 168)
WIDTHS = (6, 12, 24)


def holiday_flag(df: DataFrame, calendar: DataFrame, ts: str = "ts", day: str = "day") -> DataFrame:
    """Add ``is_holiday``: 1 where the UTC day is in ``calendar``, else 0."""
    days = calendar.select(F.col(day).cast("date").alias("_day")).distinct().withColumn("_hit", F.lit(1))
    return (
        df.withColumn("_day", F.to_date(ts))
        .join(days, "_day", "left")
        .withColumn("is_holiday", F.coalesce("_hit", F.lit(0)))
        .drop("_day", "_hit")
    )


def add_cyclical(df: DataFrame, ts: str = "ts", parts: Sequence[str] = tuple(CALENDAR_PERIODS)) -> DataFrame:
    """Add ``part_sin`` and ``part_cos`` for the given calendar parts."""
    columns = {}
    for part in parts:
        columns[f"{part}_sin"], columns[f"{part}_cos"] = cyclical(ts, part)
    return df.withColumns(columns)


def full_frame(spec: WindowSpec, column: str, start: int, end: int, fold) -> Column:
    """``fold`` over rows ``start`` to ``end``, NULL unless every row of the frame has a value."""
    frame = spec.rowsBetween(start, end)
    return F.when(F.count(column).over(frame) == end - start + 1, fold(column).over(frame))


def lag_columns(spec: WindowSpec, column: str, lags: Sequence[int]) -> dict[str, Column]:
    return {f"{column}_lag_{k}": F.lag(column, k).over(spec) for k in lags}


def mean_of(values: Sequence[Column]) -> Column:
    """Mean of the columns of a row, NULL where one of them is NULL."""
    return sum(values, F.lit(0.0)) / F.lit(float(len(values)))


def deviation_of(values: Sequence[Column], mean: Column) -> Column:
    """Sample deviation of the columns of a row around their ``mean``, NULL where one of them is NULL."""
    return F.sqrt(sum(((v - mean) * (v - mean) for v in values), F.lit(0.0)) / F.lit(float(len(values) - 1)))


def roll_columns(spec: WindowSpec, column: str, widths: Sequence[int]) -> dict[str, Column]:
    out = {}
    for w in widths:
        out[f"{column}_roll_mean_{w}"] = full_frame(spec, column, -w, -1, F.avg)
        out[f"{column}_roll_std_{w}"] = full_frame(spec, column, -w, -1, F.stddev_samp)
    return out


def lag_roll_features(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    lags: Sequence[int] = LAGS,
    widths: Sequence[int] = WIDTHS,
    ts: str = "ts",
    step: timedelta = HOUR,
    chunk_steps: int | None = None,
) -> DataFrame:
    """Lags and rolling mean / sample deviation of the rows before the current one.

    All columns of all sources share one shuffle and one sort.
    """

    def build(spec: WindowSpec) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for c in columns:
            out |= lag_columns(spec, c, lags) | roll_columns(spec, c, widths)
        return out

    reach = max([*lags, *widths])
    return grid_window(df, keys, ts, step, reach, 0, build, chunk_steps)


def lags(df: DataFrame, keys: Sequence[str], columns: Sequence[str], by: Sequence[int] = LAGS, **more) -> DataFrame:
    return lag_roll_features(df, keys, columns, by, (), **more)


def rolling(df: DataFrame, keys: Sequence[str], columns: Sequence[str], widths: Sequence[int] = WIDTHS, **more) -> DataFrame:
    return lag_roll_features(df, keys, columns, (), widths, **more)
