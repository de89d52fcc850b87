"""Daily buy/sell simulation and the profit and risk figures of its results."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.columns import first_at_max, first_at_min, ratio
from seriesloom.operators.chunks import DAY, bounded_window, join_per_key, running_totals, with_position
from seriesloom.operators.features import full_frame
from seriesloom.operators.quantiles import QUARTILES, exact_quantiles

# Days in a year for annual ratios, hours of a full day, rows of a rolling ratio.
YEAR = 365
FULL_DAY = 24
SHARPE_ROWS = 30


def daily_pnl(
    df: DataFrame,
    keys: Sequence[str],
    actual: str,
    strategies: Mapping[str, tuple[str, str]],
    ts: str = "ts",
    rows_per_day: int = FULL_DAY,
) -> DataFrame:
    """(keys, day, one column per strategy).

    A strategy is (buy column, sell column): it buys at the smallest value of the first and
    sells at the largest value of the second, and is paid in actual prices. The two hours may
    come in any order. (actual, actual) is the best possible day. Days with fewer than
    ``rows_per_day`` rows are left out.
    """
    profit = {
        name: first_at_max(actual, sell, ts) - first_at_min(actual, buy, ts)
        for name, (buy, sell) in strategies.items()
    }
    return (
        df.groupBy(*keys, F.to_date(ts).alias("day"))
        .agg(F.count(F.lit(1)).alias("_rows"), *[p.alias(name) for name, p in profit.items()])
        .where(F.col("_rows") >= rows_per_day)
        .drop("_rows")
    )


def pnl_long(pnl: DataFrame, keys: Sequence[str], strategies: Sequence[str]) -> DataFrame:
    return pnl.unpivot([*keys, "day"], list(strategies), "strategy", "pnl")


def equity_curve(pnl: DataFrame, keys: Sequence[str], day: str = "day", step: timedelta = DAY) -> DataFrame:
    """Add ``equity`` (cumulative profit) and ``running_max``."""
    return running_totals(pnl, [*keys, "strategy"], day, "pnl", step=step)


def drawdown(curve: DataFrame) -> DataFrame:
    """Add the relative distance from the running maximum; NULL while that maximum is 0."""
    return curve.withColumn("drawdown", ratio(F.col("equity") - F.col("running_max"), "running_max"))


def pnl_summary(pnl: DataFrame, keys: Sequence[str], day: str = "day", step: timedelta = DAY) -> DataFrame:
    """Profit, deviation, annual Sharpe and Sortino ratios, worst drawdown and closing equity.

    A strategy whose profit never varies gets 0 for the three risk figures. Without a
    deviation of losing days the Sortino ratio is infinite.
    """
    curve = drawdown(equity_curve(pnl, keys, day, step))
    loss = F.stddev_samp(F.when(F.col("pnl") < 0, F.col("pnl")))
    stats = curve.groupBy(*keys, "strategy").agg(
        F.count("pnl").alias("days"),
        F.sum("pnl").alias("total_profit"),
        F.avg("pnl").alias("_mean"),
        F.stddev_samp("pnl").alias("std_profit"),
        loss.alias("_loss"),
        F.min("drawdown").alias("_worst"),
        F.max_by("equity", F.when(F.col("equity").isNotNull(), F.col(day))).alias("final_equity"),
    )
    year = F.lit(math.sqrt(YEAR))
    flat = F.col("std_profit") == 0
    sharpe = F.col("_mean") / F.when(~flat, F.col("std_profit")) * year
    sortino = F.when(F.col("_loss") > 0, F.col("_mean") / F.when(F.col("_loss") > 0, F.col("_loss")) * year)
    worst = F.coalesce(F.col("_worst") * 100, F.lit(0.0))

    def unless_flat(c: Column) -> Column:
        return F.when(flat, F.lit(0.0)).otherwise(c)

    return stats.select(
        *keys,
        "strategy",
        "days",
        "total_profit",
        "std_profit",
        unless_flat(sharpe).alias("sharpe"),
        unless_flat(F.coalesce(sortino, F.lit(float("inf")))).alias("sortino"),
        unless_flat(worst).alias("max_drawdown"),
        "final_equity",
    )


def rolling_sharpe(
    pnl: DataFrame,
    keys: Sequence[str],
    rows: int = SHARPE_ROWS,
    leave_out: Sequence[str] = ("oracle",),
    day: str = "day",
    step: timedelta = DAY,
    chunk_steps: int | None = None,
) -> DataFrame:
    """Add the annual Sharpe ratio of the last ``rows`` days, NULL until there are that many."""
    series = [*keys, "strategy"]
    kept = pnl.where(~F.col("strategy").isin(list(leave_out))) if leave_out else pnl
    numbered = with_position(kept, series, day, step, chunk_steps=chunk_steps)

    def build(spec):
        mean = full_frame(spec, "pnl", 1 - rows, 0, F.avg)
        spread = full_frame(spec, "pnl", 1 - rows, 0, F.stddev_samp)
        return {"rolling_sharpe": ratio(mean, spread) * F.lit(math.sqrt(YEAR))}

    out = bounded_window(numbered, series, "position", F.col("position"), rows - 1, 0, build, chunk_steps)
    return out.drop("position", "n_rows")


def pnl_quartiles(pnl: DataFrame, by: Sequence[str] = ("strategy",)) -> DataFrame:
    return exact_quantiles(pnl, by, "pnl", QUARTILES)


def _positive(c: Column) -> Column:
    return F.when(c > 0, c)


def profit_density(pnl: DataFrame, by: Sequence[str] = ("strategy",), value: str = "pnl", points: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density per group on an even grid, Scott bandwidth.

    The grid spans the data plus ``cut`` bandwidths on each side. Equal values are counted first;
    a task then adds up the kernels of a batch of values in numpy and sends one row per group and
    grid point, so no row is multiplied by the grid.
    """
    clean = pnl.select(*by, F.col(value).cast("double").alias("_v")).where(F.col(value).isNotNull())
    n = F.count("_v")
    stats = clean.groupBy(*by).agg(
        n.alias("_n"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
        _positive(F.stddev_samp("_v") * F.pow(n.cast("double"), F.lit(-0.2))).alias("_h"),
    )
    start = F.col("_lo") - cut * F.col("_h")
    width = F.col("_hi") - F.col("_lo") + 2 * cut * F.col("_h")
    spread = stats.where(F.col("_h").isNotNull()).select(*by, start.alias("_start"), width.alias("_width"), "_h", "_n")
    values = clean.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_times"))
    rows = join_per_key(values, spread, by, "_v", "inner")
    schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("_sums", T.ArrayType(T.DoubleType()))])

    def kernels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps, sums = np.arange(points) / (points - 1), {}
        for batch in batches:
            for key, part in batch.groupby(list(by), dropna=False) if by else [((), batch)]:
                x = part["_start"].iloc[0] + part["_width"].iloc[0] * steps
                for i in range(0, len(part), 4096):
                    v, times = (part[c].to_numpy(float)[i : i + 4096] for c in ("_v", "_times"))
                    z = (x[:, None] - v) / part["_h"].iloc[0]
                    sums[key] = sums.get(key, 0) + np.exp(-z * z / 2) @ times
        for key, total in sums.items():
            yield pd.DataFrame([[*key, total.tolist()]], columns=[*by, "_sums"])

    partial = rows.mapInPandas(kernels, schema).select(*by, F.posexplode("_sums").alias("grid_id", "_k"))
    sums = join_per_key(partial.groupBy(*by, "grid_id").agg(F.sum("_k").alias("_k")), spread, by, "grid_id", "inner")
    x = F.col("_start") + F.col("_width") * F.col("grid_id") / F.lit(float(points - 1))
    density = F.col("_k") / (F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi)))
    return sums.select(*by, "grid_id", x.alias("x"), density.alias("density"))
