"""Point-forecast metrics on long predictions (keys, model, y_true, y_pred)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.columns import pearson, ratio
from seriesloom.operators.chunks import join_per_key
from seriesloom.operators.quantiles import QUARTILES, exact_quantiles

Y, P = "y_true", "y_pred"


def mae(y: str = Y, p: str = P) -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)))


def rmse(y: str = Y, p: str = P) -> Column:
    error = F.col(y) - F.col(p)
    return F.sqrt(F.avg(error * error))


def smape(y: str = Y, p: str = P) -> Column:
    """In percent; a row whose actual and forecast are both 0 does not count."""
    return F.avg(ratio(2 * F.abs(F.col(p) - F.col(y)), F.abs(y) + F.abs(p))) * 100


def scoreboard(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """mae, rmse, smape and the number of scored points per group, in one aggregate."""
    scored = predictions.where(F.col(Y).isNotNull() & F.col(P).isNotNull())
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), mae().alias("mae"), rmse().alias("rmse"), smape().alias("smape")
    )


def lookup_metric(table: DataFrame, old: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Carry columns of an older metric table into a new one."""
    return table.join(old.select(*on, *columns), list(on), "left")


def latency_tradeoff(scores: DataFrame, latency: DataFrame) -> DataFrame:
    """(model, n, mae, ms_per_prediction); see ``forecast.score_models`` for measured latencies."""
    return lookup_metric(scores.select("model", "n", "mae"), latency, ["model"], ["ms_per_prediction"])


def error_corr(residuals: DataFrame, models: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of the error columns of every pair of models, as (by, a, b, r).

    The sums for all pairs come from one aggregate over the rows.
    """
    pairs = list(combinations(models, 2))
    wide = residuals.groupBy(*by).agg(*[pearson(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(m).alias("a"), F.lit(m).alias("b"), F.lit(1.0).alias("r")) for m in models]
    for i, (a, b) in enumerate(pairs):
        cells += [
            F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"r{i}").alias("r"))
            for x, y in ((a, b), (b, a))
        ]
    return wide.select(*by, F.inline(F.array(*cells)))


def error_quartiles(errors: DataFrame, by: Sequence[str] = ("model",), value: str = "error") -> DataFrame:
    """n, min, quartiles and max per group."""
    return exact_quantiles(errors, by, value, QUARTILES)


# Fixed value: whiskers reach the furthest value within this many quartile ranges of the box.
WHISKER = 1.5


def box_stats(errors: DataFrame, by: Sequence[str], value: str = "error") -> DataFrame:
    """Quartiles, whisker ends and the number of points outside them, per group."""
    box = exact_quantiles(errors, by, value, {k: QUARTILES[k] for k in ("p25", "p50", "p75")})
    rows = join_per_key(errors.select(*by, value), box, by, value)
    reach = (F.col("p75") - F.col("p25")) * F.lit(WHISKER)
    inside = F.col(value).between(F.col("p25") - reach, F.col("p75") + reach)
    boxes = rows.groupBy(*by).agg(
        F.max("n").alias("n"),
        *[F.max(c).alias(c) for c in ("p25", "p50", "p75")],
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )
    return boxes.where(F.col("n").isNotNull())


def error_by_hour(errors: DataFrame, ts: str = "ts", value: str = "error") -> DataFrame:
    return box_stats(errors.withColumn("hour", F.hour(ts)), ["hour", "model"], value)
