"""Series built from the event, order and line-item tables, the inputs of the registered queries.

Money-like sums go through decimals, so a panel is the same whatever order rows arrive in.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.columns import exact_cents, rounded
from seriesloom.operators.chunks import grid_window
from seriesloom.operators.features import deviation_of, lag_columns, mean_of
from seriesloom.operators.grid import to_grid
from seriesloom.operators.intervals import Z95
from seriesloom.operators.split import chrono_split
from seriesloom.session import use_utc
from seriesloom.sources.files import read_table

TYPES = ("event_type",)
USERS = ("user_id",)
MODELS = ("naive1", "naive24", "roll24")
DAY = timedelta(days=1)
DAY_STEPS = 24


def hourly(spark: SparkSession, folder: str, keys: Sequence[str] = TYPES) -> DataFrame:
    """(keys, ts, total, n): events summed per hour; hours without events are absent."""
    events = read_table(use_utc(spark), folder, "events", [*keys, "ts", "value"])
    hour = F.window("ts", "1 hour").getField("start").alias("ts")
    return events.groupBy(*keys, hour).agg(exact_cents("value").alias("total"), F.count(F.lit(1)).alias("n"))


def hourly_mean(spark: SparkSession, folder: str, keys: Sequence[str] = TYPES) -> DataFrame:
    return hourly(spark, folder, keys).select(*keys, "ts", (F.col("total") / F.col("n")).alias("y"), "n")


def hourly_gappy(spark: SparkSession, folder: str, keys: Sequence[str] = TYPES) -> DataFrame:
    """Hourly means on the full grid; hours without events are NULL."""
    return to_grid(hourly_mean(spark, folder, keys), keys, unique=True)


def hourly_totals(spark: SparkSession, folder: str, keys: Sequence[str] = TYPES) -> DataFrame:
    """Hourly sums on the full grid; hours without events are NULL."""
    sums = hourly(spark, folder, keys).select(*keys, "ts", F.col("total").alias("y"))
    return to_grid(sums, keys, unique=True)


def hourly_dense(spark: SparkSession, folder: str, keys: Sequence[str] = TYPES) -> DataFrame:
    """(keys, ts, y): hourly sums on the full grid; hours without events are 0."""
    return hourly_totals(spark, folder, keys).withColumn("y", F.coalesce("y", F.lit(0.0)))


def daily_orders(spark: SparkSession, folder: str) -> DataFrame:
    """(ts, y): order value per day, in thousands; one series without key columns."""
    orders = read_table(use_utc(spark), folder, "orders", ["o_orderdate", "o_totalprice"])
    return orders.groupBy(F.col("o_orderdate").alias("ts")).agg(
        (exact_cents("o_totalprice") / 1000).alias("y")
    )


def daily_ship(spark: SparkSession, folder: str) -> DataFrame:
    """(l_returnflag, ts, y): discounted revenue per ship day, in thousands."""
    items = read_table(
        use_utc(spark), folder, "lineitem", ["l_returnflag", "l_shipdate", "l_extendedprice", "l_discount"]
    )
    price = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(5,2)"))
    return items.groupBy("l_returnflag", F.col("l_shipdate").alias("ts")).agg(
        (F.sum(price).cast("double") / 1000).alias("y")
    )


def forecasts(
    spark: SparkSession, folder: str, keys: Sequence[str] = TYPES, keep_chunk: bool = False
) -> DataFrame:
    """(keys, ts, y, naive1, naive24, roll24, lo, hi): simple forecasts of ``hourly_dense``.

    The bounds are quoted to six decimals, so that equal bounds are equal in any order of sums.
    """

    def build(spec):
        return lag_columns(spec, "y", range(1, DAY_STEPS + 1))

    # A frame that moves by a row is added up anew for each; as lagged values it is one expression, for the rows that are kept.
    rows = grid_window(hourly_dense(spark, folder, keys), keys, "ts", timedelta(hours=1), DAY_STEPS, 0, build, keep_chunk=keep_chunk)
    day = [F.col(f"y_lag_{k}") for k in range(DAY_STEPS, 0, -1)]
    rows = rows.withColumns({"naive1": day[-1], "naive24": day[0], "roll24": mean_of(day)})
    reach = F.lit(Z95) * deviation_of(day, F.col("roll24"))
    rows = rows.withColumns({"lo": rounded(F.col("roll24") - reach), "hi": rounded(F.col("roll24") + reach)})
    return rows.drop(*[f"y_lag_{k}" for k in range(1, DAY_STEPS + 1)])


def split_forecasts(spark: SparkSession, folder: str, keys: Sequence[str] = TYPES) -> DataFrame:
    """Forecast rows with all forecasts known, labelled train / validation / test."""
    return chrono_split(forecasts(spark, folder, keys, keep_chunk=True).dropna(subset=["roll24"]), keys)
