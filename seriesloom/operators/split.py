"""Chronological splits by row position."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.chunks import HOUR, with_position

# Shares of the series at which training and validation end.
TRAIN_END = 0.7
VALIDATION_END = 0.9


def _cut(share: float):
    """First position past a share of the series: the binary-float product, cut towards zero."""
    return (F.col("n_rows") * F.lit(float(share))).cast("bigint")


def split_label(at: Column, n: Column, train_end: float = TRAIN_END, validation_end: float = VALIDATION_END) -> Column:
    """train / validation / test from a position and a length."""
    cut = lambda share: (n * F.lit(float(share))).cast("bigint")
    return F.when(at < cut(train_end), "train").when(at < cut(validation_end), "validation").otherwise("test")


def chrono_split(
    df: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    train_end: float = TRAIN_END,
    validation_end: float = VALIDATION_END,
    step: timedelta = HOUR,
    chunk_steps: int | None = None,
) -> DataFrame:
    """Add ``position``, ``n_rows``, ``split`` (train / validation / test) and ``split_position``."""
    rows = with_position(df, keys, ts, step, chunk_steps=chunk_steps)
    at = F.col("position")
    first, second = _cut(train_end), _cut(validation_end)
    return rows.withColumn(
        "split", F.when(at < first, "train").when(at < second, "validation").otherwise("test")
    ).withColumn("split_position", at - F.when(at < first, 0).when(at < second, first).otherwise(second))


def recent_slice(
    df: DataFrame,
    keys: Sequence[str],
    n: int,
    end_share: float = TRAIN_END,
    ts: str = "ts",
    step: timedelta = HOUR,
) -> DataFrame:
    """The last ``n`` rows before a share of the series, fewer where the series is short."""
    end = _cut(end_share)
    rows = with_position(df, keys, ts, step)
    start = F.greatest(F.lit(0), end - F.lit(n))
    return rows.where((F.col("position") >= start) & (F.col("position") < end)).drop("position", "n_rows")


def eval_points(df: DataFrame, skip: int) -> DataFrame:
    """Test rows with at least ``skip`` test rows before them."""
    return df.where((F.col("split") == "test") & (F.col("split_position") >= skip))


def split_counts(
    df: DataFrame, keys: Sequence[str], train_end: float = TRAIN_END, validation_end: float = VALIDATION_END
) -> DataFrame:
    """(keys, split, n) of series not split yet: the sizes follow from the number of rows alone."""
    n_rows = F.col("n_rows")
    first, second = ((n_rows * F.lit(float(s))).cast("bigint") for s in (train_end, validation_end))
    sizes = {"train": first, "validation": second - first, "test": n_rows - second}
    parts = F.array(*[F.struct(F.lit(name).alias("split"), size.alias("n")) for name, size in sizes.items()])
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select(*keys, F.inline(parts)).where(F.col("n") > 0)
