"""Forecast jobs that are plain relational work: naive forecasts, bands, samples and blends."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from seriesloom.functions.columns import epoch_seconds, hash_unit, pearson
from seriesloom.operators.chunks import HOUR, join_per_key, row_window, with_position
from seriesloom.operators.quantiles import exact_quantiles, quantile_curve
from seriesloom.operators.reshape import assemble_predictions
from seriesloom.operators.scale import inverse_target, minmax_fit, scale_target
from seriesloom.session import cut_lineage
from seriesloom.sources.files import small_table

# Seasons of a 3-hour series per day, training share, interval quantiles.
DAY_OF_3H = 8
ORIGIN = 0.7
BANDS = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
SAMPLES = 50
RESIDUAL_POINTS = 100


def seasonal_naive(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    m: int = DAY_OF_3H,
    origin: float = ORIGIN,
    ts: str = "ts",
    step: timedelta = timedelta(hours=3),
) -> DataFrame:
    """(keys, ts, horizon, y_pred): from ``origin`` on, repeat the last season before it."""
    rows = with_position(df.select(*keys, ts, column), keys, ts, step)
    start = (F.col("n_rows") * F.lit(float(origin))).cast("bigint")
    placed = rows.withColumn("_ahead", F.col("position") - start)
    phased = placed.withColumn("_phase", F.pmod(F.col("_ahead"), F.lit(m)))
    season = phased.where(F.col("_ahead").between(-m, -1)).select(*keys, "_phase", F.col(column).alias("y_pred"))
    future = phased.where(F.col("_ahead") >= 0).select(*keys, ts, "_phase", (F.col("_ahead") + 1).alias("horizon"))
    return join_per_key(future, season, [*keys, "_phase"], ts, "left").select(*keys, ts, "horizon", "y_pred")


def quantile_bands(
    df: DataFrame,
    keys: Sequence[str],
    y: str,
    pred: str,
    ts: str = "ts",
    probs: Mapping[str, float] = BANDS,
    split: str = "split",
) -> DataFrame:
    """Test rows with one column per band: the forecast plus the quantile of the validation
    residuals of the same series and hour. The bands cannot cross."""
    hours = df.withColumn("_hour", F.hour(ts))
    residual = hours.where(F.col(split) == "validation").select(
        *keys, "_hour", (F.col(y) - F.col(pred)).alias("_error")
    )
    shifts = exact_quantiles(residual, [*keys, "_hour"], "_error", {f"_q_{k}": p for k, p in probs.items()}).drop("n")
    test = join_per_key(hours.where(F.col(split) == "test"), shifts, [*keys, "_hour"], ts, "left")
    return test.withColumns({k: F.col(pred) + F.col(f"_q_{k}") for k in probs}).drop(
        "_hour", *[f"_q_{k}" for k in probs]
    )


def residual_curve(
    df: DataFrame, keys: Sequence[str], y: str, pred: str, points: int = RESIDUAL_POINTS
) -> DataFrame:
    """(keys, curve): residual quantiles at ``points`` + 1 even shares, a bounded summary of the
    residual distribution of a series of any length."""
    residual = df.select(*keys, (F.col(y) - F.col(pred)).alias("_error"))
    return quantile_curve(residual, keys, "_error", points)


def curve_value(curve: Column, share: Column) -> Column:
    """Value of a quantile curve at a share in [0, 1), by linear interpolation."""
    at = share * (F.size(curve) - 1)
    low = F.get(curve, F.floor(at).cast("int"))
    high = F.get(curve, F.floor(at).cast("int") + 1)
    return low + (high - low) * (at - F.floor(at))


def predictive_samples(
    df: DataFrame,
    curves: DataFrame,
    keys: Sequence[str],
    pred: str,
    n: int = SAMPLES,
    ts: str = "ts",
) -> DataFrame:
    """Add ``samples``: ``n`` draws of forecast plus residual per point.

    The draw is a hash of series, time and sample number, so a repeated run gives the same
    samples whatever the partitioning.
    """
    rows = join_per_key(df, curves, keys, ts, "left")
    draw = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda b: F.col(pred) + curve_value(F.col("curve"), hash_unit(*keys, epoch_seconds(ts), b)),
    )
    return rows.withColumn("samples", draw).drop("curve")


# Fixed value: the smallest error a blend weight is taken from, so that a perfect model does
# not divide by zero.
LEAST_ERROR = 1e-9


def fit_blend(df: DataFrame, keys: Sequence[str], y: str, models: Sequence[str], split: str = "split") -> DataFrame:
    """(keys, w_model...): inverse-MAE weights from the validation rows, summing to 1."""
    known = df.where(F.col(split) == "validation")
    errors = known.groupBy(*keys).agg(*[F.avg(F.abs(F.col(y) - F.col(m))).alias(m) for m in models])
    inverse = {m: 1 / F.greatest(F.col(m), F.lit(LEAST_ERROR)) for m in models}
    total = sum(inverse.values(), F.lit(0.0))
    return errors.select(*keys, *[(inverse[m] / total).alias(f"w_{m}") for m in models])


def blend(
    df: DataFrame, weights: DataFrame, keys: Sequence[str], models: Sequence[str], ts: str = "ts", out: str = "blend"
) -> DataFrame:
    rows = join_per_key(df, weights, keys, ts, "left")
    mix = sum((F.col(f"w_{m}") * F.col(m) for m in models), F.lit(0.0))
    return rows.withColumn(out, mix).select(*df.columns, out)


def rescaled_blend(
    df: DataFrame, keys: Sequence[str], y: str, models: Sequence[str], ts: str = "ts", split: str = "split"
) -> DataFrame:
    """Blend on the [0, 1] scale of the training target and bring the result back.

    Weights and forecasts use one table of bounds, so they cannot be on different scales.
    """
    bounds = minmax_fit(df, keys, [y], F.col(split) == "train")
    shrunk = scale_target(
        df.withColumns({f"_s_{c}": F.col(c) for c in (y, *models)}), bounds, keys, [f"_s_{c}" for c in (y, *models)], y, ts
    )
    names = [f"_s_{m}" for m in models]
    mixed = blend(shrunk, fit_blend(shrunk, keys, f"_s_{y}", names, split), keys, names, ts)
    return inverse_target(mixed, bounds, keys, ["blend"], y, ts).select(*df.columns, "blend")


def stationarity_stat(
    df: DataFrame, keys: Sequence[str], column: str, ts: str = "ts", step: timedelta = HOUR,
    chunk_steps: int | None = None, regular: bool = False,
) -> DataFrame:
    """(keys, n, slope, t_stat): Dickey-Fuller statistic without augmentation, with constant."""
    rows = row_window(
        df.select(*keys, ts, column), keys, ts, step, 1, 0,
        lambda spec: {"_before": F.lag(column, 1).over(spec)}, chunk_steps, regular,
    ).withColumn("_change", F.col(column) - F.col("_before"))
    fits = rows.groupBy(*keys).agg(
        F.regr_count("_change", "_before").alias("n"),
        F.regr_sxx("_change", "_before").alias("_sxx"),
        F.regr_syy("_change", "_before").alias("_syy"),
        F.regr_sxy("_change", "_before").alias("_sxy"),
    )
    fits = fits.withColumn("slope", F.col("_sxy") / F.when(F.col("_sxx") > 0, F.col("_sxx")))
    left = F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.when(F.col("_sxx") > 0, F.col("_sxx"))
    error = F.sqrt(left / F.when(F.col("n") > 2, F.col("n") - 2) / F.when(F.col("_sxx") > 0, F.col("_sxx")))
    return fits.select(*keys, "n", "slope", (F.col("slope") / F.when(error > 0, error)).alias("t_stat"))


def rank_features(
    df: DataFrame, features: Sequence[str], target: str, n: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    """The ``n`` features with the largest absolute correlation with the target; ties by name."""
    wide = df.groupBy(*by).agg(*[F.abs(pearson(f, target)).alias(f) for f in features])
    entries = F.array(*[F.struct((-F.coalesce(F.col(f), F.lit(0.0))).alias("order"), F.lit(f).alias("feature")) for f in features])
    return wide.select(*by, F.posexplode(F.slice(F.sort_array(entries), 1, n)).alias("rank", "_c")).select(
        *by,
        (F.col("rank") + 1).alias("rank"),
        F.col("_c.feature").alias("feature"),
        (-F.col("_c.order")).alias("importance"),
    )


def score_models(
    rows: DataFrame,
    registry: Mapping[str, Callable[[DataFrame], DataFrame]],
    ids: Sequence[str],
    actual: str,
    timed: bool = False,
) -> tuple[DataFrame, DataFrame | None]:
    """Run every model over the same rows.

    A model is a function from the rows to a table with the ids and ``y_pred``. Returns the
    wide prediction table and, with ``timed``, (model, n, ms_per_prediction). A timed model runs once: its
    forecasts are written to the shared folder, counted on the way, and the table is made of what was written.
    """
    if not timed:
        outputs = {name: model(rows) for name, model in registry.items()}
        return assemble_predictions(rows.select(*ids, actual), outputs, ids), None
    spark, outputs, measured = rows.sparkSession, {}, []
    for name, model in registry.items():
        seen = Observation(name)
        begin = time.perf_counter()
        counted = model(rows).select(*ids, "y_pred").observe(seen, F.count(F.lit(1)).alias("n"))
        outputs[name] = cut_lineage(counted)
        spent = time.perf_counter() - begin
        n = seen.get["n"]
        measured.append((name, n, spent * 1000 / max(n, 1)))
    table = assemble_predictions(rows.select(*ids, actual), outputs, ids)
    return table, small_table(spark, measured, "model string, n long, ms_per_prediction double")


def residual_index(
    df: DataFrame, keys: Sequence[str], y: str, pred: str, ts: str = "ts", step: timedelta = HOUR, chunk_steps: int | None = None
) -> DataFrame:
    """(keys, position, n_rows, residual): the known residuals of each series, numbered from 0 in time order."""
    residual = df.select(*keys, ts, (F.col(y) - F.col(pred)).alias("residual")).dropna(subset=["residual"])
    return with_position(residual, keys, ts, step, chunk_steps=chunk_steps).drop(ts)


def residual_draws(
    df: DataFrame, index: DataFrame, keys: Sequence[str], pred: str, n: int = SAMPLES, ts: str = "ts"
) -> DataFrame:
    """(keys, ts, sample_id, value): ``n`` draws a row, each the forecast plus one residual of the series.

    A draw is a place in the index, from a hash of series, time and sample number, looked up by a join: the work is
    spread by place, and a repeated run draws the same. Series without residuals get no rows.
    """
    sizes = index.groupBy(*keys).agg(F.max("n_rows").alias("_size"))
    rows = join_per_key(df.select(*keys, ts, F.col(pred).alias("_pred")), sizes, keys, ts, "inner")
    asks = rows.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    unit = hash_unit(*keys, epoch_seconds(ts), "sample_id")
    asks = asks.withColumn("position", F.floor(unit * F.col("_size")).cast("bigint"))
    met = asks.join(index.select(*keys, "position", "residual"), [*keys, "position"])
    return met.select(*keys, ts, "sample_id", (F.col("_pred") + F.col("residual")).alias("value"))
