"""Trend, season, periodicity and differencing."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.chunks import HOUR, bounded_window, join_per_key, row_window, with_position
from seriesloom.operators.features import full_frame
from seriesloom.operators.lagged import centred, correlation_of_sums, lagged_sums, number_rows

# Season of a daily series, and width of the short moving average.
YEARLY_PERIOD = 365
TREND_WIDTH = 25


def seasonal_decompose(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    period: int = YEARLY_PERIOD,
    ts: str = "ts",
    step: timedelta = timedelta(days=1),
    chunk_steps: int | None = None,
) -> DataFrame:
    """Additive decomposition by row position: adds ``trend``, ``seasonal`` and ``resid``.

    The trend is a centred moving average (half end weights for an even period), NULL in the
    first and last half period. The season is the mean detrended value of each phase, less the
    mean over phases. A series shorter than two periods gets NULLs.
    """
    half = period // 2
    numbered = with_position(df.dropna(subset=[column]), keys, ts, step, chunk_steps=chunk_steps)

    def build(spec):
        if period % 2:
            return {"trend": full_frame(spec, column, -half, half, F.avg)}
        total = full_frame(spec, column, -half, half, F.sum)
        ends = F.lag(column, half).over(spec) + F.lead(column, half).over(spec)
        return {"trend": (total - ends / 2) / period}

    rows = bounded_window(numbered, keys, "position", F.col("position"), half, half, build, chunk_steps)
    rows = rows.withColumn("trend", F.when(F.col("n_rows") >= 2 * period, F.col("trend"))).withColumn(
        "_phase", (F.col("position") % period).cast("int")
    )
    phases = rows.groupBy(*keys, "_phase").agg(F.avg(F.col(column) - F.col("trend")).alias("_mean"))
    season = phases.select(
        *keys, "_phase", (F.col("_mean") - F.avg("_mean").over(Window.partitionBy(*keys))).alias("seasonal")
    )
    out = join_per_key(rows, season, [*keys, "_phase"], ts)
    return out.withColumn("resid", F.col(column) - F.col("trend") - F.col("seasonal")).select(
        *df.columns, "trend", "seasonal", "resid"
    )


def trend_split(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    width: int = TREND_WIDTH,
    ts: str = "ts",
    step: timedelta = HOUR,
    chunk_steps: int | None = None,
    regular: bool = False,
) -> DataFrame:
    """Add ``trend`` (centred moving average over the rows there are) and ``seasonal`` (the rest)."""
    back, ahead = (width - 1) // 2, width // 2

    def build(spec):
        return {"trend": F.avg(column).over(spec.rowsBetween(-back, ahead))}

    out = row_window(df, keys, ts, step, back, ahead, build, chunk_steps, regular)
    return out.withColumn("seasonal", F.col(column) - F.col("trend"))


def autocorrelation(
    df: DataFrame, keys: Sequence[str], column: str, max_lag: int, ts: str = "ts", step: timedelta = HOUR,
    chunk_steps: int | None = None, regular: bool = False,
) -> DataFrame:
    """(keys, acf): the correlation of the series with itself at lags 1 to ``max_lag``.

    Lags are rows of the series; a lag counts the rows that are known at both ends. Chunks are correlated by
    a fast transform, so the cost hardly depends on ``max_lag``, and their sums are added per lag. ``regular`` as in
    ``lagged.number_rows``.
    """
    rows = centred(number_rows(df, keys, [column], ts, step, chunk_steps, regular), keys, [column], ts)
    sums = lagged_sums(rows, keys, [column], max_lag, [(0, 0)], chunk_steps).where(F.col("lag") > 0)
    cells = sums.select(*keys, F.struct("lag", correlation_of_sums().alias("r")).alias("_cell"))
    return cells.groupBy(*keys).agg(F.array_sort(F.collect_list("_cell")).alias("acf"))


def dominant_periods(
    df: DataFrame, keys: Sequence[str], column: str, max_lag: int, factor: float = 1.0, **more
) -> DataFrame:
    """(keys, rank, lag, r, weight): the int(factor * ln(max_lag)) best lags, softmax-weighted."""
    top = max(1, int(factor * math.log(max_lag)))
    best = F.slice(
        F.sort_array(
            F.transform(
                F.filter("acf", lambda c: c["r"].isNotNull()),
                lambda c: F.struct((-c["r"]).alias("order"), c["lag"].alias("lag"), c["r"].alias("r")),
            )
        ),
        1,
        top,
    )
    ranked = autocorrelation(df, keys, column, max_lag, **more).withColumn("_best", best)
    total = F.aggregate("_best", F.lit(0.0), lambda s, c: s + F.exp(c["r"] - F.col("_best")[0]["r"]))
    return (
        ranked.where(F.size("_best") > 0)
        .withColumn("_total", total)
        .withColumn("_top", F.col("_best")[0]["r"])
        .select(*keys, "_total", "_top", F.posexplode("_best").alias("rank", "_c"))
        .select(
            *keys,
            (F.col("rank") + 1).alias("rank"),
            F.col("_c.lag").alias("lag"),
            F.col("_c.r").alias("r"),
            (F.exp(F.col("_c.r") - F.col("_top")) / F.col("_total")).alias("weight"),
        )
    )


def delay_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    weights: DataFrame,
    ts: str = "ts",
    step: timedelta = HOUR,
    out: str = "delayed",
    chunk_steps: int | None = None,
    regular: bool = False,
) -> DataFrame:
    """Weighted sum of earlier values; ``weights`` is (keys, lag, weight), a few lags a series of any size.

    Each row sends its value to the positions that look back at it, so the work is that of the lags
    a series has, not of all lags up to the largest. NULL where a wanted earlier value is missing.
    """
    sent = weights.select(*keys, F.struct(F.col("lag").cast("bigint").alias("lag"), "weight").alias("_to"))
    by_key = sent.groupBy(*keys).agg(F.collect_list("_to").alias("_sends"))
    others = [c for c in df.columns if c not in (*keys, ts)]
    rows = join_per_key(number_rows(df, keys, others, ts, step, chunk_steps, regular), by_key, keys, ts)
    own = F.array(F.struct(F.lit(0).cast("bigint").alias("lag"), F.lit(None).cast("double").alias("weight")))
    sends = F.when(F.col("_sends").isNotNull(), F.concat(own, F.col("_sends"))).otherwise(own)
    each = rows.withColumn("_to", F.explode(sends))
    home = F.col("_to.lag") == 0
    met = (
        each.withColumn("_at", F.col("position") + F.col("_to.lag"))
        .groupBy(*keys, "_at")
        .agg(
            F.any_value(F.when(home, F.struct(*df.columns)), ignoreNulls=True).alias("_row"),
            F.max(F.when(home, F.size("_sends"))).alias("_wanted"),  # NULL beyond the last row
            F.sum(F.when(~home, F.col("_to.weight") * F.col(column))).alias("_sum"),
            F.count(F.when(~home, F.col(column))).alias("_met"),
        )
    )
    complete = F.when(F.col("_met") == F.col("_wanted"), F.col("_sum"))
    return met.where(F.col("_row").isNotNull()).select(*[F.col("_row").getField(c).alias(c) for c in df.columns], complete.alias(out))


def difference_weights(d: int, seasonal_d: int, m: int) -> dict[int, int]:
    """Lag -> weight of the difference operator (1 - B)^d (1 - B^m)^D, zero weights left out."""
    weights = {0: 1}
    for lag in [1] * d + [m] * seasonal_d:
        shifted = {k + lag: -w for k, w in weights.items()}
        weights = {k: weights.get(k, 0) + shifted.get(k, 0) for k in {*weights, *shifted}}
    return {k: w for k, w in sorted(weights.items()) if w}


def difference(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    d: int = 0,
    seasonal_d: int = 1,
    m: int = 8,
    ts: str = "ts",
    step: timedelta = timedelta(hours=3),
    out: str = "diff",
    chunk_steps: int | None = None,
    regular: bool = False,
) -> DataFrame:
    """Add the regular and seasonal difference by row position, NULL at its start."""
    weights = difference_weights(d, seasonal_d, m)

    def build(spec):
        total: Column = F.lit(0.0)
        for k, w in weights.items():
            total = total + (F.col(column) if k == 0 else F.lag(column, k).over(spec)) * F.lit(float(w))
        return {out: total}

    return row_window(df, keys, ts, step, max(weights), 0, build, chunk_steps, regular)
