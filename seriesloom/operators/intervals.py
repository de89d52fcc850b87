"""Interval and distribution metrics.

Samples of one point are an array column, so per-point work is row-local and needs no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.columns import as_col


def covered(y: str | Column, lo: str | Column, hi: str | Column) -> Column:
    """1 where the actual is inside the bounds, else 0; an absent bound covers nothing."""
    y = as_col(y)
    return F.coalesce((y >= as_col(lo)) & (y <= as_col(hi)), F.lit(False)).cast("double")


def interval_metrics(df: DataFrame, by: Sequence[str], y: str, lo: str, hi: str) -> DataFrame:
    """Coverage in percent (picp) and mean width (mpiw)."""
    scored = df.where(F.col(y).isNotNull())
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg(covered(y, lo, hi)) * 100).alias("picp"),
        F.avg(F.col(hi) - F.col(lo)).alias("mpiw"),
    )


def calibration(
    df: DataFrame, y: str, bands: Mapping[str, tuple[str, str, float]], by: Sequence[str] = ()
) -> DataFrame:
    """(by, model, nominal, observed) for bands given as name -> (lower, upper, nominal share)."""
    names = list(bands)
    wide = df.where(F.col(y).isNotNull()).groupBy(*by).agg(
        *[F.avg(covered(y, bands[m][0], bands[m][1])).alias(f"o{i}") for i, m in enumerate(names)]
    )
    cells = [
        F.struct(
            F.lit(m).alias("model"), F.lit(float(bands[m][2])).alias("nominal"), F.col(f"o{i}").alias("observed")
        )
        for i, m in enumerate(names)
    ]
    return wide.select(*by, F.inline(F.array(*cells)))


def samples_array(df: DataFrame, ids: Sequence[str], value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Gather a long sample table into one array per point. A point has a fixed, small number of
    samples, so a group is bounded."""
    return df.groupBy(*ids).agg(
        F.collect_list(value).alias("samples"), *[F.first(c).alias(c) for c in keep]
    )


def crps_of(y: str | Column, samples: str | Column) -> Column:
    """Ensemble CRPS of one point from the sorted samples: O(m log m), no sample pairs."""
    y, xs = as_col(y), F.sort_array(as_col(samples))
    m = F.size(xs).cast("double")
    spread = F.aggregate(
        F.zip_with(xs, F.sequence(F.lit(1), F.size(xs)), lambda x, i: x * (2 * i - m - 1)),
        F.lit(0.0),
        lambda s, v: s + v,
    )
    miss = F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.abs(x - y))
    return F.when(F.size(xs) > 0, miss / m - spread / (m * m))


def crps(df: DataFrame, by: Sequence[str], y: str = "y_true", samples: str = "samples") -> DataFrame:
    """Mean CRPS per group; NULL where no point has samples."""
    return df.groupBy(*by).agg(F.avg(crps_of(y, samples)).alias("crps"))


def array_quantile(samples: str | Column, p: float) -> Column:
    """Quantile of an array with linear interpolation."""
    xs = F.sort_array(as_col(samples))
    rank = F.lit(float(p)) * (F.size(xs) - 1)
    low = F.get(xs, F.floor(rank).cast("int"))
    high = F.get(xs, F.ceil(rank).cast("int"))
    return low + (high - low) * (rank - F.floor(rank))


def sample_bounds(df: DataFrame, low: float = 0.05, high: float = 0.95, samples: str = "samples") -> DataFrame:
    return df.withColumn("lower", array_quantile(samples, low)).withColumn("upper", array_quantile(samples, high))


def _mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs)


def uncertainty_split(
    df: DataFrame, means: str = "means", sigmas: str = "sigmas", data_range: str | Column = "data_range"
) -> DataFrame:
    """Split the uncertainty of each point's repeated passes.

    ``means`` are the passes' means in data units, ``sigmas`` their deviations in scaled units.
    Adds ``mean``, ``epistemic``, ``aleatoric`` and ``total``.
    """
    mu = _mean(F.col(means))
    deviation = F.sqrt(_mean(F.transform(means, lambda x: (x - F.col("mean")) * (x - F.col("mean")))))
    noise = F.sqrt(_mean(F.transform(sigmas, lambda s: s * s))) * as_col(data_range)
    return (
        df.withColumn("mean", mu)
        .withColumns({"epistemic": deviation, "aleatoric": noise})
        .withColumn("total", F.sqrt(F.col("epistemic") ** 2 + F.col("aleatoric") ** 2))
    )


# Half-width of a 95% normal interval, and the density grid around the actual.
Z95 = 1.96
GRID_HALF_WIDTH = 30.0
GRID_POINTS = 1000


def gauss_interval(df: DataFrame, mu: str = "mean", sigma: str = "total") -> DataFrame:
    reach = F.lit(Z95) * F.col(sigma)
    return df.withColumn("lower", F.col(mu) - reach).withColumn("upper", F.col(mu) + reach)


def normal_pdf(x: Column, mu: Column, sigma: Column) -> Column:
    z = (x - mu) / F.when(sigma != 0, sigma)
    return F.exp(-z * z / 2) / (F.when(sigma != 0, sigma) * F.lit(math.sqrt(2 * math.pi)))


def gauss_density(
    df: DataFrame, y: str, mu: str = "mean", sigma: str = "total", points: int = GRID_POINTS
) -> DataFrame:
    """The density of each point on an even grid around its actual, with the interval flag."""
    step = 2 * GRID_HALF_WIDTH / (points - 1)
    grid = gauss_interval(df, mu, sigma).withColumn("grid_id", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("x")
    return (
        grid.withColumn("x", F.col(y) - GRID_HALF_WIDTH + F.col("grid_id") * step)
        .withColumn("pdf", normal_pdf(x, F.col(mu), F.col(sigma)))
        .withColumn("inside", (x >= F.col("lower")) & (x <= F.col("upper")))
    )
