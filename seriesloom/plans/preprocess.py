"""From raw sensor tables to a complete, regular feature table, as one lazy chain."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators import clean, features, grid, impute, reshape
from seriesloom.operators.chunks import HOUR

# Columns of the raw tables that are not used, and the two fuels that are added up.
UNUSED_ENERGY = (
    "generation hydro pumped storage aggregated",
    "forecast wind offshore eday ahead",
    "forecast solar day ahead",
    "forecast wind onshore day ahead",
    "total load forecast",
    "price day ahead",
    "generation fossil coal-derived gas",
    "generation fossil oil shale",
    "generation fossil peat",
    "generation geothermal",
    "generation marine",
    "generation wind offshore",
)
UNUSED_WEATHER = ("weather_id", "weather_main", "weather_description", "weather_icon", "temp_min", "temp_max")
FOSSIL_PARTS = ("generation fossil hard coal", "generation fossil brown coal/lignite")
TARGET = "price actual"
LAGGED = (TARGET, "total load actual")


def clean_energy(energy: DataFrame) -> DataFrame:
    narrow = clean.drop_columns(energy, UNUSED_ENERGY)
    return clean.combine_columns(narrow, "generation_fossil_total", FOSSIL_PARTS)


def spread_places(
    long: DataFrame, place: str, order: Sequence[str], ids: Sequence[str] = ("ts",), places: Sequence | None = None
) -> DataFrame:
    """One row per time, one column per measure and place; the first of repeated rows counts."""
    single = clean.dedupe_first(clean.strip(long, place), [*ids, place], order)
    measures = [c for c in long.columns if c not in {*ids, place, *order}]
    return reshape.pivot_wide(single, ids, place, measures, places)


def feature_rows(
    main: DataFrame,
    other: DataFrame,
    calendar: DataFrame,
    keys: Sequence[str] = (),
    target: str = TARGET,
    lagged: Sequence[str] = LAGGED,
    ts: str = "ts",
    step: timedelta = HOUR,
) -> DataFrame:
    """Join two wide tables on time, fill the grid, add features, and keep the rows whose target
    is known a week earlier."""
    joined = grid.outer_join_time(main, other, [*keys, ts])
    regular = grid.to_grid(joined, keys, ts, step)
    dated = features.add_cyclical(features.holiday_flag(regular, calendar, ts), ts)
    rows = features.lag_roll_features(dated, keys, lagged, ts=ts, step=step)
    return clean.drop_null(rows, [f"{target}_lag_168"])


def prepare(
    energy: DataFrame,
    weather: DataFrame,
    calendar: DataFrame,
    place: str = "city_name",
    order: Sequence[str] = ("_file", "_line"),
    places: Sequence | None = None,
    neighbours: int = impute.NEIGHBOURS,
    fit_on: Column | None = None,
) -> DataFrame:
    """The whole preparation of one energy series and its weather table.

    ``order`` gives the order of repeated weather rows (see ``sources.files.with_file_order``).
    ``fit_on`` limits scaling bounds and donors, e.g. to training times; by default all rows count.
    """
    wide = spread_places(clean.drop_columns(weather, UNUSED_WEATHER), place, order, places=places)
    rows = feature_rows(clean_energy(energy), wide, calendar)
    numbers = [c for c in rows.columns if c != "ts"]
    rows = rows.select("ts", *[F.col(f"`{c}`").cast("double").alias(c) for c in numbers])
    return impute.knn_impute(rows, (), numbers, neighbours, fit_on=fit_on)
