"""From a table of predictions to the metric, profit and report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators import intervals, metrics, profile, reshape, strategy
from seriesloom.sources import files


def evaluate(
    results: DataFrame,
    actual: str,
    models: Sequence[str],
    bands: Mapping[str, tuple[str, str, float]],
    strategies: Mapping[str, tuple[str, str]],
    keys: Sequence[str] = (),
    ts: str = "ts",
    samples: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """All tables of an evaluation, by name.

    ``results`` has one row per time with the actual, one column per model, the bounds of every
    band and, optionally, an array of samples for some bands (``samples``: band -> column).
    """
    ids = [*keys, ts]
    points = metrics.scoreboard(reshape.predictions_long(results, ids, actual, models), [*keys, "model"])
    pnl = strategy.daily_pnl(results, keys, actual, strategies, ts)
    long_pnl = strategy.pnl_long(pnl, keys, list(strategies))
    errors = reshape.residuals_long(results, ids, actual, models)
    flat = results.drop(*(samples or {}).values())
    volatile = profile.volatility_rows(flat, keys, actual, ts=ts)
    return {
        "point_metrics": points,
        "interval_metrics": interval_table(results, actual, bands, keys, samples or {}),
        "daily_pnl": pnl,
        "strategy_metrics": strategy.pnl_summary(long_pnl, keys),
        "error_quartiles": metrics.error_quartiles(errors, [*keys, "model"]),
        "error_correlation": metrics.error_corr(reshape.residuals(results, actual, models), models, keys),
        "calibration": intervals.calibration(results, actual, bands, keys),
        "volatile_week": profile.volatile_week(volatile, keys, ts=ts),
        "results": volatile,
    }


def interval_table(
    results: DataFrame,
    actual: str,
    bands: Mapping[str, tuple[str, str, float]],
    keys: Sequence[str] = (),
    samples: Mapping[str, str] | None = None,
) -> DataFrame:
    """(keys, model, n, picp, mpiw, crps) for every band, in one pass over the rows."""
    samples = samples or {}
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("model"),
                F.col(lo).alias("_lo"),
                F.col(hi).alias("_hi"),
                (intervals.crps_of(actual, samples[name]) if name in samples else F.lit(None).cast("double")).alias("_crps"),
            )
            for name, (lo, hi, _) in bands.items()
        ]
    )
    long = results.where(F.col(actual).isNotNull()).select(*keys, F.col(actual).alias("_y"), F.inline(rows))
    return long.groupBy(*keys, "model").agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg(intervals.covered("_y", "_lo", "_hi")) * 100).alias("picp"),
        F.avg(F.col("_hi") - F.col("_lo")).alias("mpiw"),
        F.avg("_crps").alias("crps"),
    )


def write_reports(tables: Mapping[str, DataFrame], folder: str) -> None:
    for name, table in tables.items():
        files.write_report(table, f"{folder}/{name}")
