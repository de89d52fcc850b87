"""Dataset profiles and volatility of a series."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.columns import first_at_max
from seriesloom.operators.chunks import HOUR, bounded_window, join_per_key, row_window, slot
from seriesloom.operators.features import full_frame
from seriesloom.operators.quantiles import QUARTILES, exact_quantiles

# Rows of the row-based volatility, and the span shown around its peak.
WEEK_ROWS = 24 * 7
BEFORE_PEAK = timedelta(days=3)
AFTER_PEAK = timedelta(days=4)


def describe_long(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per column."""
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(by), list(columns), "column", "_x"
    )
    group = [*by, "column"]
    moments = long.groupBy(*group).agg(
        F.count("_x").alias("count"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std")
    )
    return moments.join(exact_quantiles(long, group, "_x", QUARTILES).drop("n"), group, "left")


def dataset_profile(df: DataFrame, ts: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """Rows, columns, cells, NULLs, all-NULL columns, first and last time, hours between them."""
    values = [c for c in df.columns if c not in by]
    nulls = sum((F.count_if(F.col(c).isNull()) for c in values), F.lit(0))
    blank = sum((F.when(F.count(c) == 0, 1).otherwise(0) for c in values), F.lit(0))
    hours = (F.unix_seconds(F.max(ts).cast("timestamp")) - F.unix_seconds(F.min(ts).cast("timestamp"))) / 3600
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(values)).alias("n_columns"),
        (F.count(F.lit(1)) * len(values)).alias("n_cells"),
        nulls.alias("n_nulls"),
        blank.alias("n_blank_columns"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        hours.alias("hours"),
    )


def volatility_rows(
    df: DataFrame, keys: Sequence[str], column: str, rows: int = WEEK_ROWS, ts: str = "ts", step: timedelta = HOUR,
    chunk_steps: int | None = None, regular: bool = False,
) -> DataFrame:
    """Deviation of the current and the ``rows - 1`` earlier rows, NULL until all have a value."""

    def build(spec):
        return {"volatility": full_frame(spec, column, 1 - rows, 0, F.stddev_samp)}

    return row_window(df, keys, ts, step, rows - 1, 0, build, chunk_steps, regular)


def volatility_time(
    df: DataFrame, keys: Sequence[str], column: str, days: int = 7, ts: str = "ts", step: timedelta = HOUR,
    chunk_steps: int | None = None,
) -> DataFrame:
    """Deviation of the values in the ``days`` up to each time, the far end left out.

    Needs two values; the series may have gaps. ``step`` only sets the unit of ``chunk_steps``:
    choose it near the spacing of the rows.
    """
    reach = days * 86_400_000_000 - 1

    def build(spec):
        frame = spec.orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-reach, 0)
        return {"volatility": F.stddev_samp(column).over(frame)}

    steps = int(timedelta(days=days) / step) + 1
    return bounded_window(df, keys, ts, slot(ts, step), steps, 0, build, chunk_steps)


def argmax_time(df: DataFrame, keys: Sequence[str], column: str, ts: str = "ts", out: str = "peak") -> DataFrame:
    """The first time at which ``column`` is largest."""
    return df.groupBy(*keys).agg(first_at_max(ts, column, ts).alias(out))


def volatile_week(df: DataFrame, keys: Sequence[str], volatility: str = "volatility", ts: str = "ts") -> DataFrame:
    """Rows from three days before to four days after the volatility peak of each series."""
    peaks = argmax_time(df, keys, volatility, ts)
    rows = join_per_key(df, peaks, keys, ts)
    start, end = F.col("peak") - F.lit(BEFORE_PEAK), F.col("peak") + F.lit(AFTER_PEAK)
    return rows.where(F.col(ts).between(start, end)).select(*df.columns)
