"""Exact quantiles with linear interpolation for groups of any size.

Spark's ``percentile`` holds the distinct values of a group in one buffer. Here equal values are
counted first and counted again by buckets of nearly equal values. Running sums over the buckets
tell which ones hold a wanted rank; only their values are ranked one by one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.chunks import known

QUARTILES = {"min": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "max": 1.0}
# Buckets part values by size: so many for each doubling. They steer how work is divided only.
BUCKETS = 1024
FAR = 1100 * BUCKETS


def _bucket(x: Column) -> Column:
    """A whole number that never falls as ``x`` grows."""
    size = F.floor(F.least(F.log2(F.abs(x)), F.lit(1030.0)) * BUCKETS) + FAR  # infinite and NaN come last
    return F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0).cast("bigint"))


def quantile_map(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], n: str = "n"
) -> DataFrame:
    """(keys, n, _at): a map from each wanted share to its quantile. NULL values and groups with a
    NULL key are left out."""
    counts = (
        known(df, [*keys, value])
        .groupBy(*keys, F.col(value).cast("double").alias("_x"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bucket", _bucket(F.col("_x")))
    )
    counts = known(counts, ["_bucket"])
    by_key = Window.partitionBy(*keys)
    below = by_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        counts.groupBy(*keys, "_bucket")
        .agg(F.sum("_n").alias("_size"))
        .select(
            *keys,
            "_bucket",
            "_size",
            F.coalesce(F.sum("_size").over(below), F.lit(0)).alias("_start"),
            F.sum("_size").over(by_key).alias("_total"),
        )
    )
    # Each wanted share lies between two ranks; a value answers for the ranks it covers.
    shares = F.lit([float(p) for p in dict.fromkeys(probs.values())])

    def covered(first: Column, upto: Column) -> Column:
        def covers(p: Column) -> Column:
            at = p * (F.col("_total") - 1)
            return (F.floor(at) < upto) & (F.ceil(at) >= first)

        return F.filter(shares, covers)

    held = covered(F.col("_start"), F.col("_start") + F.col("_size"))
    wanted = starts.where(F.size(held) > 0).drop("_size")
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(wanted, [*keys, "_bucket"]).withColumn("_upto", F.col("_start") + F.sum("_n").over(inside))
    rank = F.col("_p") * (F.col("_total") - 1)
    first = F.col("_upto") - F.col("_n")
    hits = ranked.withColumn("_p", F.explode(covered(first, F.col("_upto"))))
    low = F.when((F.floor(rank) >= first) & (F.floor(rank) < F.col("_upto")), F.col("_x"))
    high = F.when((F.ceil(rank) >= first) & (F.ceil(rank) < F.col("_upto")), F.col("_x"))
    between = F.col("_low") + (F.col("_high") - F.col("_low")) * (rank - F.floor(rank))
    points = hits.groupBy(*keys, "_total", "_p").agg(F.max(low).alias("_low"), F.max(high).alias("_high"))
    return points.groupBy(*keys).agg(
        F.max("_total").alias(n),
        F.map_from_entries(F.collect_list(F.struct("_p", between.alias("_v")))).alias("_at"),
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float] = QUARTILES,
    n: str = "n",
) -> DataFrame:
    """(keys, n, one column per entry of ``probs``), NULL values left out."""
    columns = [F.element_at("_at", F.lit(float(p))).alias(name) for name, p in probs.items()]
    return quantile_map(df, keys, value, probs, n).select(*keys, n, *columns)


def quantile_curve(df: DataFrame, keys: Sequence[str], value: str, points: int, out: str = "curve") -> DataFrame:
    """(keys, out): the quantiles at ``points`` + 1 even shares as one array."""
    shares = {str(i): i / points for i in range(points + 1)}
    values = F.transform(F.array_sort(F.map_entries("_at")), lambda e: e["value"])
    return quantile_map(df, keys, value, shares, "_n").select(*keys, values.alias(out))
