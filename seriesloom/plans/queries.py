"""Registered queries: one per operator, each over the whole of the tables it reads."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.columns import exact_cents, rounded
from seriesloom.operators import (
    clean,
    decompose,
    features,
    forecast,
    grid,
    impute,
    intervals,
    metrics,
    models,
    profile,
    reshape,
    scale,
    split,
    strategy,
    windows,
)
from seriesloom.operators.chunks import grid_window, with_position
from seriesloom.plans import panels
from seriesloom.plans.panels import MODELS, TYPES, USERS
from seriesloom.plans.preprocess import feature_rows, spread_places
from seriesloom.session import scratch_path, use_utc
from seriesloom.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Fixed value: the holidays of the calendar input.
HOLIDAYS = (date(2024, 1, 1), date(2024, 1, 6), date(2024, 1, 15))

KT = [*TYPES, "ts"]
STRATEGIES = {"oracle": ("y", "y"), "naive": ("naive24", "naive24"), "risk_aware": ("hi", "lo")}
BANDS = {"normal": ("lo", "hi", 0.95), "half": ("lo_half", "hi_half", 0.5)}
STEP_3H = timedelta(hours=3)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _out(df: DataFrame, exact: Sequence[str], measured: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """The result columns; measured values are rounded, so that sums in another order agree."""
    return df.select(*exact, *[rounded(c, digits).alias(c) for c in measured])


def _calendar(spark: SparkSession) -> DataFrame:
    return files.small_table(spark, [(d,) for d in HOLIDAYS], "day date")


def _test(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "test")


# --- flagship -------------------------------------------------------------------------------


@query
def lag24_scoreboard(spark, folder):
    """Score the value 24 hours earlier against the last tenth of every series."""
    rows = features.lags(panels.hourly_dense(spark, folder), TYPES, ["y"], [24])
    test = _test(split.chrono_split(rows.dropna(subset=["y_lag_24"]), TYPES))
    scored = test.select(*TYPES, F.col("y").alias("y_true"), F.col("y_lag_24").alias("y_pred"))
    return _out(metrics.scoreboard(scored, TYPES), [*TYPES, "n"], ["mae", "rmse", "smape"])


# --- sources and sinks ----------------------------------------------------------------------


@query
def src_csv_roundtrip(spark, folder):
    path = scratch_path(use_utc(spark), "report")
    files.write_report(panels.hourly_mean(spark, folder), path)
    back = files.read_report(spark, path, "event_type string, ts string, y double, n bigint", ts="ts")
    return _out(back, [*KT, "n"], ["y"])


@query
def src_parquet_roundtrip(spark, folder):
    path = scratch_path(use_utc(spark), "table")
    files.write_parquet(panels.hourly_dense(spark, folder), path, partition_by=TYPES)
    return _out(files.read_parquet(spark, path), KT, ["y"])


@query
def ts_normalize(spark, folder):
    events = files.read_table(use_utc(spark), folder, "events", ["event_id", "ts"])
    offset = F.when(F.col("event_id") % 2 == 0, "+01:00").otherwise("+02:00")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), offset)
    return files.normalize_time(events.select("event_id", text.alias("local")), "local").select("event_id", "ts")


# --- projections and cleaning ---------------------------------------------------------------


@query
def proj_drop(spark, folder):
    events = files.read_parquet(use_utc(spark), f"{folder}/events.parquet")
    return clean.drop_columns(events, ["props", "user_id"])


@query
def proj_combine(spark, folder):
    items = files.read_table(
        spark, folder, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    )
    total = clean.combine_columns(items, "combined", ["l_quantity", "l_extendedprice"])
    return _out(total, ["l_orderkey", "l_linenumber", "l_partkey"], ["combined"], 2)


@query
def str_strip(spark, folder):
    events = files.read_table(spark, folder, "events", ["event_type", "value"])
    padded = events.withColumn("event_type", F.concat(F.lit(" \t"), "event_type", F.lit("\n ")))
    out = clean.strip(padded, "event_type").groupBy("event_type")
    return _out(out.agg(F.count(F.lit(1)).alias("n"), exact_cents("value").alias("total")), ["event_type", "n"], ["total"], 2)


@query
def dedupe_first(spark, folder):
    events = files.read_table(use_utc(spark), folder, "events", ["event_id", "ts", "event_type", "value"])
    hours = events.withColumn("hour", F.window("ts", "1 hour").getField("start"))
    return clean.dedupe_first(hours, ["event_type", "hour"], ["ts", "event_id"])


@query
def drop_null_subset(spark, folder):
    lagged = features.lags(panels.hourly_gappy(spark, folder).drop("n"), TYPES, ["y"], [168])
    return _out(clean.drop_null(lagged, ["y_lag_168"]), KT, ["y", "y_lag_168"])


@query
def drop_null_any(spark, folder):
    lagged = features.lags(panels.hourly_gappy(spark, folder).drop("n"), TYPES, ["y"], [1, 2, 3, 24])
    names = [f"y_lag_{k}" for k in (1, 2, 3, 24)]
    return _out(clean.drop_null_any(lagged), KT, ["y", *names])


# --- reshaping ------------------------------------------------------------------------------


@query
def pivot_wide(spark, folder):
    long = panels.hourly_mean(spark, folder)
    wide = reshape.pivot_wide(long, ["ts"], "event_type", ["y", "n"])
    counts = [c for c in wide.columns if c.startswith("n_")]
    return _out(wide, ["ts", *counts], [c for c in wide.columns if c.startswith("y_")])


@query
def pivot_map(spark, folder):
    """The same without a column per type: what each hour's map holds, as text."""
    wide = reshape.pivot_map(panels.hourly_mean(spark, folder), ["ts"], "event_type", ["n"])
    entries = F.array_sort(F.transform(F.map_entries("n"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return wide.select("ts", F.array_join(entries, ",").alias("counts"))


@query
def residuals_long(spark, folder):
    test = _test(panels.split_forecasts(spark, folder))
    return _out(reshape.residuals_long(test, KT, "y", MODELS), [*KT, "model"], ["error"])


@query
def pred_table(spark, folder):
    """Forecasts that cover different spans, brought together on the times all of them have."""
    dense = panels.hourly_dense(spark, folder)

    def lagged(k):
        return lambda rows: features.lags(rows, TYPES, ["y"], [k]).select(*KT, F.col(f"y_lag_{k}").alias("y_pred")).dropna()

    def rolled(rows):
        name = "y_roll_mean_72"
        return features.rolling(rows, TYPES, ["y"], [72]).select(*KT, F.col(name).alias("y_pred")).dropna()

    table, _ = forecast.score_models(
        dense, {"naive1": lagged(1), "naive24": lagged(24), "roll72": rolled}, KT, "y"
    )
    return _out(table, KT, ["y", "naive1", "naive24", "roll72"])


@query
def scoreboard(spark, folder):
    """Point metrics per model over the test rows of the per-user panel."""
    test = _test(panels.split_forecasts(spark, folder, USERS))
    long = reshape.predictions_long(test, [*USERS, "ts"], "y", MODELS)
    return _out(metrics.scoreboard(long), ["model", "n"], ["mae", "rmse", "smape"])


# --- joins and grids ------------------------------------------------------------------------


@query
def join_outer_time(spark, folder):
    ordered = panels.daily_orders(spark, folder).withColumnRenamed("y", "ordered")
    shipped = panels.daily_ship(spark, folder).groupBy("ts").agg(F.sum("y").alias("shipped"))
    return _out(grid.outer_join_time(ordered, shipped, ["ts"]), ["ts"], ["ordered", "shipped"], 7)


@query
def hourly_grid(spark, folder):
    return _out(panels.hourly_gappy(spark, folder), [*KT, "n"], ["y"])


@query
def asof_upsample(spark, folder):
    gappy = panels.hourly_gappy(spark, folder)
    coarse = grid.resample_mean(gappy, TYPES, ["y"], "3 hours")
    return _out(grid.asof_fill(gappy, coarse, TYPES, ["y"]), KT, ["y"])


@query
def resample_3h(spark, folder):
    return _out(grid.resample_mean(panels.hourly_gappy(spark, folder), TYPES, ["y"], "3 hours"), KT, ["y"])


@query
def resample_daily(spark, folder):
    return _out(grid.resample_mean(panels.hourly_gappy(spark, folder, USERS), USERS, ["y"], "1 day"), [*USERS, "ts"], ["y"])


# --- features -------------------------------------------------------------------------------


@query
def holiday_flag(spark, folder):
    return features.holiday_flag(panels.hourly_dense(spark, folder), _calendar(spark)).select(*KT, "is_holiday")


@query
def cyclical_features(spark, folder):
    parts = [f"{p}_{f}" for p in ("hour", "day_of_week", "month") for f in ("sin", "cos")]
    return _out(features.add_cyclical(panels.hourly_dense(spark, folder)), KT, parts)


@query
def lag_features(spark, folder):
    lagged = features.lags(panels.hourly_gappy(spark, folder).drop("n"), TYPES, ["y"])
    return _out(lagged, KT, ["y", *[f"y_lag_{k}" for k in features.LAGS]])


@query
def roll_mean(spark, folder):
    rolled = features.rolling(panels.hourly_totals(spark, folder), TYPES, ["y"])
    return _out(rolled, KT, [f"y_roll_mean_{w}" for w in features.WIDTHS])


@query
def roll_std(spark, folder):
    rolled = features.rolling(panels.hourly_dense(spark, folder), TYPES, ["y"])
    return _out(rolled, KT, [f"y_roll_std_{w}" for w in features.WIDTHS])


def feature_table(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """Calendar, lag and rolling features of ``hourly_dense``, complete rows only."""
    rows = features.lag_roll_features(panels.hourly_dense(spark, folder), TYPES, ["y"])
    rows = features.add_cyclical(rows, parts=("hour", "day_of_week")).dropna(subset=["y_lag_168"])
    names, _ = clean.features_target(rows, "y", KT, known_before=True)
    return rows, names


@query
def top_features(spark, folder):
    rows, names = feature_table(spark, folder)
    return _out(forecast.rank_features(rows, names, "y"), ["rank", "feature"], ["importance"])


def _array_sum(column: str, field: str | None = None):
    return F.aggregate(column, F.lit(0.0), lambda s, r: s + (r[field] if field else r))


@query
def sequence_windows(spark, folder):
    rows = windows.sequence_windows(panels.hourly_dense(spark, folder), TYPES, ["y"], "y", 72, regular=True)
    first, last = F.col("seq")[0]["y"], F.col("seq")[71]["y"]
    shown = rows.withColumns({"first": first, "last": last, "total": _array_sum("seq", "y"), "n": F.size("seq")})
    return _out(shown, [*KT, "n"], ["y", "first", "last", "total"])


@query
def nth_window(spark, folder):
    """Window 200 of each series; only the rows it is made of become an array."""
    rows = with_position(panels.hourly_dense(spark, folder), TYPES, "ts")
    needed = rows.where(F.col("position").between(200, 272)).withColumn("position", F.col("position") - 72)
    picked = clean.nth_row(windows.sequence_windows(needed, TYPES, ["y"], "y", 72, carry=["position"], regular=True), 200)
    return _out(picked.withColumn("total", _array_sum("seq", "y")), [*KT, "position"], ["y", "total"])


@query
def encdec_windows(spark, folder):
    rows = windows.encdec_windows(panels.hourly_dense(spark, folder), TYPES, ["y"], "y", 336, 24, regular=True)
    shown = rows.withColumns(
        {
            "n_encoder": F.size("encoder"),
            "n_decoder": F.size("decoder"),
            "n_target": F.size("target"),
            "decoder_first": F.col("decoder")[0]["y"],
            "decoder_known_last": F.col("decoder")[167]["y"],
            "decoder_pad": F.col("decoder")[168]["y"],
            "encoder_total": _array_sum("encoder", "y"),
            "target_first": F.col("target")[0],
            "target_total": _array_sum("target"),
        }
    )
    measured = ["decoder_first", "decoder_known_last", "decoder_pad", "encoder_total", "target_first", "target_total"]
    return _out(shown, [*KT, "n_encoder", "n_decoder", "n_target"], measured)


@query
def window_counts(spark, folder):
    return windows.window_counts(panels.hourly_dense(spark, folder, USERS), USERS, 336, 24, 32)


@query
def processed_features(spark, folder):
    """Raw tables to features: purchases are the priced series, all event types the places."""
    means = panels.hourly_mean(spark, folder)
    main = means.where(F.col("event_type") == "purchase").select("ts", F.col("y").alias("price"), F.col("n").cast("double").alias("load"))
    padded = means.withColumn("event_type", F.concat(F.lit(" "), "event_type"))
    copies = padded.withColumn("_line", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("y", F.col("y") * F.col("_line"))
    wide = spread_places(copies.drop("n"), "event_type", ["_line"])
    rows = feature_rows(main, wide, _calendar(spark), target="load", lagged=("price", "load"))
    measured = [c for c in rows.columns if c not in ("ts", "is_holiday") and "_roll_" not in c]
    return _out(rows, ["ts", "is_holiday"], [*measured, "load_roll_mean_6", "load_roll_std_24"])


# --- splits, scaling, imputation ------------------------------------------------------------


@query
def chrono_split(spark, folder):
    rows = split.chrono_split(panels.hourly_dense(spark, folder), TYPES)
    return rows.select(*KT, "position", "n_rows", "split", "split_position")


@query
def recent_slice(spark, folder):
    coarse = grid.resample_mean(panels.hourly_dense(spark, folder), TYPES, ["y"], "3 hours")
    return _out(split.recent_slice(coarse, TYPES, 100, step=STEP_3H), KT, ["y"])


@query
def eval_points(spark, folder):
    rows = split.eval_points(split.chrono_split(panels.hourly_dense(spark, folder), TYPES), 24)
    return rows.select(*KT, "split_position")


@query
def split_counts(spark, folder):
    return split.split_counts(panels.hourly_dense(spark, folder, USERS), USERS)


def _split_gappy(spark, folder):
    return split.chrono_split(panels.hourly_gappy(spark, folder), TYPES)


@query
def minmax_bounds(spark, folder):
    fit = scale.minmax_fit(_split_gappy(spark, folder), TYPES, ["y", "n"], F.col("split") == "train")
    return _out(fit, [*TYPES, "lo_n", "hi_n"], ["lo_y", "hi_y"])


@query
def minmax_scale(spark, folder):
    rows = _split_gappy(spark, folder).withColumn("n", F.col("n").cast("double"))
    bounds = scale.minmax_fit(rows, TYPES, ["y", "n"], F.col("split") == "train")
    return _out(scale.minmax_transform(rows, bounds, TYPES, ["y", "n"]), KT, ["y", "n"])


@query
def minmax_roundtrip(spark, folder):
    rows = panels.split_forecasts(spark, folder)
    bounds = scale.minmax_fit(rows, TYPES, ["y"], F.col("split") == "train")
    names = ["y", *MODELS]
    small = scale.scale_target(rows, bounds, TYPES, names, "y")
    kept = small.withColumns({f"scaled_{c}": F.col(c) for c in names})
    return _out(scale.inverse_target(kept, bounds, TYPES, names, "y"), KT, [*names, *[f"scaled_{c}" for c in names]])


@query
def knn_impute(spark, folder):
    rows = features.lags(panels.hourly_gappy(spark, folder).drop("n"), TYPES, ["y"], [1, 24])
    rows = features.add_cyclical(rows, parts=("hour",))
    names = ["y", "y_lag_1", "y_lag_24", "hour_sin", "hour_cos"]
    return _out(impute.knn_impute(rows, TYPES, names), KT, ["y", "y_lag_1", "y_lag_24"])


# --- metrics --------------------------------------------------------------------------------


@query
def interval_metrics(spark, folder):
    test = _test(panels.split_forecasts(spark, folder, USERS))
    return _out(intervals.interval_metrics(test, USERS, "y", "lo", "hi"), [*USERS, "n"], ["picp", "mpiw"])


def _sampled(spark, folder):
    rows = panels.split_forecasts(spark, folder)
    curves = forecast.residual_curve(rows.where(F.col("split") == "train"), TYPES, "y", "roll24")
    return forecast.predictive_samples(_test(rows), curves, TYPES, "roll24")


@query
def mc_samples(spark, folder):
    long = _sampled(spark, folder).select(*KT, F.posexplode("samples").alias("sample_id", "value"))
    return _out(long, [*KT, "sample_id"], ["value"])


@query
def crps(spark, folder):
    return _out(intervals.crps(_sampled(spark, folder), TYPES, "y"), TYPES, ["crps"])


@query
def mc_bounds(spark, folder):
    return _out(intervals.sample_bounds(_sampled(spark, folder)), KT, ["lower", "upper"])


@query
def calibration(spark, folder):
    test = _test(panels.split_forecasts(spark, folder, USERS))
    middle, reach = F.col("roll24"), (F.col("hi") - F.col("lo")) / (2 * intervals.Z95) * 0.6745
    banded = test.withColumns({"lo_half": middle - reach, "hi_half": middle + reach})
    return _out(intervals.calibration(banded, "y", BANDS), ["model"], ["nominal", "observed"])


@query
def error_corr(spark, folder):
    test = reshape.residuals(_test(panels.split_forecasts(spark, folder, USERS)), "y", MODELS)
    return _out(metrics.error_corr(test, MODELS), ["a", "b"], ["r"])


@query
def error_quartiles(spark, folder):
    test = _test(panels.split_forecasts(spark, folder, USERS))
    errors = reshape.residuals_long(test, [*USERS, "ts"], "y", MODELS)
    return _out(metrics.error_quartiles(errors), ["model", "n"], ["min", "p25", "p50", "p75", "max"])


@query
def error_by_hour(spark, folder):
    errors = reshape.residuals_long(panels.split_forecasts(spark, folder), KT, "y", MODELS)
    measured = ["p25", "p50", "p75", "whisker_low", "whisker_high"]
    return _out(metrics.error_by_hour(errors), ["hour", "model", "n", "outliers"], measured)


@query
def tradeoff_table(spark, folder):
    """Error and measured latency of three forecasters, each run once over the test rows."""
    test = _test(panels.split_forecasts(spark, folder))
    registry = {m: (lambda rows, m=m: rows.select(*KT, F.col(m).alias("y_pred"))) for m in MODELS}
    table, latency = forecast.score_models(test, registry, KT, "y", timed=True)
    scores = metrics.scoreboard(reshape.predictions_long(table, KT, "y", MODELS))
    out = metrics.latency_tradeoff(scores, latency).withColumn("timed", F.col("ms_per_prediction") > 0)
    return _out(out, ["model", "n", "timed"], ["mae"])


@query
def uncertainty_split(spark, folder):
    """The three forecasts of a point are its passes; the rolling deviation is their noise."""
    rows = panels.split_forecasts(spark, folder)
    bounds = scale.minmax_fit(rows, TYPES, ["y"], F.col("split") == "train")
    width = bounds.select(*TYPES, (F.col("hi_y") - F.col("lo_y")).alias("data_range"))
    test = scale.join_per_key(_test(rows), width, TYPES, "ts")
    sigma = (F.col("hi") - F.col("lo")) / (2 * intervals.Z95) / F.col("data_range")
    passes = test.withColumns(
        {"means": F.array(*MODELS), "sigmas": F.array(sigma, sigma * 0.5, sigma * 1.5)}
    )
    return _out(intervals.uncertainty_split(passes), KT, ["mean", "epistemic", "aleatoric", "total"])


def _gauss_cases(spark, folder):
    """Mean and deviation of every test row."""
    rows = _test(panels.split_forecasts(spark, folder))
    deviation = (F.col("hi") - F.col("roll24")) / intervals.Z95
    return rows.select(*KT, "split_position", "y", F.col("roll24").alias("mean"), deviation.alias("total"))


@query
def gauss_interval(spark, folder):
    return _out(intervals.gauss_interval(_gauss_cases(spark, folder)), KT, ["mean", "lower", "upper"])


@query
def gauss_density(spark, folder):
    """The density around test sample 10 of each series."""
    grid_rows = intervals.gauss_density(_gauss_cases(spark, folder).where(F.col("split_position") == 10), "y")
    return _out(grid_rows, [*KT, "grid_id", "inside"], ["x", "pdf", "lower", "upper"])


@query
def describe_long(spark, folder):
    items = files.read_table(spark, folder, "lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    out = profile.describe_long(items, items.columns)
    return _out(out, ["column", "count"], ["mean", "std", "min", "p25", "p50", "p75", "max"], 4)


@query
def dataset_profile(spark, folder):
    out = profile.dataset_profile(panels.hourly_gappy(spark, folder), by=TYPES)
    return _out(out, [c for c in out.columns if c != "hours"], ["hours"])


# --- volatility -----------------------------------------------------------------------------


@query
def volatility_rows(spark, folder):
    return _out(profile.volatility_rows(panels.hourly_dense(spark, folder), TYPES, "y", regular=True), KT, ["volatility"])


@query
def volatility_time(spark, folder):
    return _out(profile.volatility_time(panels.hourly_mean(spark, folder), TYPES, "y"), KT, ["volatility"])


@query
def volatile_week(spark, folder):
    rows = profile.volatility_rows(panels.hourly_dense(spark, folder), TYPES, "y", regular=True)
    return _out(profile.volatile_week(rows, TYPES), KT, ["y", "volatility"])


# --- strategies -----------------------------------------------------------------------------

SUPPLIER = ["l_suppkey"]


def ship_pnl(spark: SparkSession, folder: str) -> DataFrame:
    """(l_suppkey, strategy, day, pnl): signed daily revenue of a supplier per return flag;
    lines that are still open earn, closed ones pay."""
    names = ["l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate", "l_extendedprice", "l_discount"]
    items = files.read_table(use_utc(spark), folder, "lineitem", names)
    price = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(5,2)"))
    sign = F.when(F.col("l_linestatus") == "O", 1).otherwise(-1)
    return items.groupBy(
        "l_suppkey", F.col("l_returnflag").alias("strategy"), F.to_date("l_shipdate").alias("day")
    ).agg(F.sum(price * sign).cast("double").alias("pnl"))


@query
def daily_pnl(spark, folder):
    """Daily profit per user; the bounds are the extremes of the 24 hours before."""
    dense = panels.hourly_dense(spark, folder, USERS)

    def build(spec):
        day_before = spec.rowsBetween(-24, -1)
        return {
            "naive24": F.lag("y", 24).over(spec),
            "lo": F.min("y").over(day_before),
            "hi": F.max("y").over(day_before),
        }

    rows = grid_window(dense, USERS, "ts", timedelta(hours=1), 24, 0, build).dropna(subset=["naive24"])
    return _out(strategy.daily_pnl(rows, USERS, "y", STRATEGIES), [*USERS, "day"], list(STRATEGIES), 2)


@query
def pnl_summary(spark, folder):
    out = strategy.pnl_summary(ship_pnl(spark, folder), SUPPLIER)
    ratios = ["sharpe", "sortino", "max_drawdown"]
    money = {c: rounded(c, d) for c, d in (("total_profit", 4), ("std_profit", 3), ("final_equity", 4))}
    return out.withColumns(money | {c: rounded(c) for c in ratios})


@query
def trading_summary(spark, folder):
    """Profit and risk of the simulated strategies, per event type."""
    pnl = strategy.daily_pnl(panels.split_forecasts(spark, folder), TYPES, "y", STRATEGIES)
    out = strategy.pnl_summary(strategy.pnl_long(pnl, TYPES, list(STRATEGIES)), TYPES)
    measured = ["total_profit", "std_profit", "sharpe", "sortino", "max_drawdown", "final_equity"]
    return _out(out, [*TYPES, "strategy", "days"], measured)


@query
def equity_curve(spark, folder):
    curve = strategy.equity_curve(ship_pnl(spark, folder), SUPPLIER)
    return _out(curve, [*SUPPLIER, "strategy", "day"], ["equity", "running_max"], 4)


@query
def drawdown(spark, folder):
    curve = strategy.drawdown(strategy.equity_curve(ship_pnl(spark, folder), SUPPLIER))
    return _out(curve, [*SUPPLIER, "strategy", "day"], ["drawdown"])


@query
def rolling_sharpe(spark, folder):
    rolled = strategy.rolling_sharpe(ship_pnl(spark, folder), SUPPLIER, leave_out=("R",))
    return _out(rolled, [*SUPPLIER, "strategy", "day"], ["rolling_sharpe"])


@query
def pnl_quartiles(spark, folder):
    return _out(strategy.pnl_quartiles(ship_pnl(spark, folder)), ["strategy", "n"], ["min", "p25", "p50", "p75", "max"])


@query
def pnl_density(spark, folder):
    density = strategy.profit_density(ship_pnl(spark, folder))
    density = density.withColumn("density", F.col("density") * 1e6)
    return _out(_out(density, ["strategy", "grid_id", "density"], ["x"], 3), ["strategy", "grid_id", "x"], ["density"])


# --- decomposition --------------------------------------------------------------------------


@query
def decompose_daily(spark, folder):
    rows = decompose.seasonal_decompose(panels.daily_orders(spark, folder), (), "y")
    return _out(rows, ["ts"], ["trend", "seasonal", "resid"], 4)


@query
def decompose_hourly(spark, folder):
    dense = panels.hourly_dense(spark, folder)
    rows = decompose.seasonal_decompose(dense, TYPES, "y", period=24, step=timedelta(hours=1))
    return _out(rows, KT, ["trend", "seasonal", "resid"])


@query
def trend_split(spark, folder):
    return _out(decompose.trend_split(panels.hourly_dense(spark, folder), TYPES, "y", regular=True), KT, ["trend", "seasonal"])


MAX_LAG = 336


def _periods(spark, folder):
    return decompose.dominant_periods(panels.hourly_dense(spark, folder), TYPES, "y", MAX_LAG, regular=True)


@query
def acf_topk(spark, folder):
    return _out(_periods(spark, folder), [*TYPES, "rank", "lag"], ["r", "weight"])


@query
def delay_aggregate(spark, folder):
    dense = panels.hourly_dense(spark, folder)
    weights = _periods(spark, folder).select(*TYPES, "lag", "weight")
    return _out(decompose.delay_aggregate(dense, TYPES, "y", weights, regular=True), KT, ["delayed"])


@query
def seasonal_diff(spark, folder):
    coarse = grid.resample_mean(panels.hourly_dense(spark, folder), TYPES, ["y"], "3 hours")
    return _out(decompose.difference(coarse, TYPES, "y", d=1, seasonal_d=1, m=8, regular=True), KT, ["diff"])


# --- forecast jobs --------------------------------------------------------------------------


@query
def quantile_bands(spark, folder):
    rows = forecast.quantile_bands(panels.split_forecasts(spark, folder), TYPES, "y", "roll24")
    return _out(rows, KT, ["p10", "p50", "p90"])


@query
def seasonal_naive(spark, folder):
    """A 3-hour forecast from 70% of the series on, carried to the hours it covers."""
    dense = panels.hourly_dense(spark, folder)
    coarse = grid.resample_mean(dense, TYPES, ["y"], "3 hours")
    predicted = forecast.seasonal_naive(coarse, TYPES, "y")
    hours = split.chrono_split(dense, TYPES).where(F.col("split") == "test").select(*KT)
    return _out(grid.asof_fill(hours, predicted, TYPES, ["y_pred", "horizon"]), [*KT, "horizon"], ["y_pred"])


@query
def blend_inverse_mae(spark, folder):
    rows = panels.split_forecasts(spark, folder)
    mixed = forecast.blend(_test(rows), forecast.fit_blend(rows, TYPES, "y", MODELS), TYPES, MODELS)
    return _out(mixed, KT, ["blend"])


@query
def rescaled_meta(spark, folder):
    """Blend on the training scale, bring it back, and score it next to its parts."""
    rows = forecast.rescaled_blend(panels.split_forecasts(spark, folder, USERS), USERS, "y", MODELS)
    long = reshape.predictions_long(_test(rows), [*USERS, "ts"], "y", [*MODELS, "blend"])
    return _out(metrics.scoreboard(long), ["model", "n"], ["mae", "rmse", "smape"])


@query
def df_stat(spark, folder):
    out = forecast.stationarity_stat(panels.hourly_dense(spark, folder, USERS), USERS, "y", regular=True)
    return _out(out, [*USERS, "n"], ["slope", "t_stat"])


# --- fitted models (no SQL counterpart) -----------------------------------------------------


@query
def gbt_point(spark, folder):
    """Boosted trees, stopped by the validation rows, scored on the test rows."""
    rows, names = feature_table(spark, folder)
    rows = split.chrono_split(rows, TYPES)
    model = models.fit_point(rows, names, "y")
    return models.score(model, _test(rows), names, KT)


@query
def gbt_importance(spark, folder):
    rows, names = feature_table(spark, folder)
    model = models.fit_point(split.chrono_split(rows, TYPES), names, "y")
    return models.feature_importance(model, names, 10, spark)


@query
def stacked_linear(spark, folder):
    rows = models.fit_stack(panels.split_forecasts(spark, folder, USERS), USERS, "y", MODELS)
    long = reshape.predictions_long(_test(rows), [*USERS, "ts"], "y", [*MODELS, "stack"])
    return metrics.scoreboard(long)
