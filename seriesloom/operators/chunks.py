"""Helpers that keep per-series work spread out, however long one series is.

Three shapes cover every ordered operator:

* ``bounded_window`` - a frame reaching a known number of steps back or ahead. A series is cut
  into chunks of consecutive steps, the rows near a border are copied into the neighbouring
  chunk, and the window is partitioned by (series, chunk). ``row_window`` counts rows, so it is
  right for series with missing times; ``grid_window`` counts steps of a full grid, saves the
  numbering, and fails on a gap.
* ``with_position`` / ``running_totals`` / ``fill_gaps`` - prefixes. Each bucket is summarised,
  the summaries (one row per bucket) are accumulated per series, and the carry is joined back.
* ``join_per_key`` - a per-series table met with the rows of the series, salted so that one
  large series is met by many tasks.

Small tables are joined with left joins even where every row has a match: Spark can then send
the small side to the rows, never the rows to the small side.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seriesloom.functions.columns import as_col, epoch_seconds

CHUNK_STEPS = 8192
SALTS = 16
HOUR = timedelta(hours=1)
DAY = timedelta(days=1)


def seconds(step: timedelta) -> int:
    whole = int(step.total_seconds())
    if whole <= 0:
        raise ValueError("step must be at least one second")
    return whole


def slot(ts: str | Column, step: timedelta) -> Column:
    """Index of the step a time lies in, counted from the epoch."""
    return F.floor(epoch_seconds(ts) / F.lit(seconds(step)))


def shuffle_width(df: DataFrame) -> int:
    """Partitions for rows that grow after their shuffle, or weigh little in it: Spark would merge too many into one task."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bounded_window(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    steps: Column,
    before: int,
    after: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    chunk_steps: int | None = None,
    keep_chunk: bool = False,
) -> DataFrame:
    """Add window columns whose frames reach at most ``before`` steps back and ``after`` ahead.

    ``steps`` is an integer that grows by one per row of a gap-free series (or a coarse time
    index for range frames). ``build`` receives the window ordered by ``order``. With
    ``keep_chunk`` the result keeps ``_chunk``, which lets a following prefix operator work in
    the same partitions, without another shuffle.
    """
    size = chunk_steps or max(10 * (before + after), CHUNK_STEPS)
    home = F.floor(F.col("_step") / F.lit(size))
    first = F.floor((F.col("_step") - F.lit(after)) / F.lit(size))
    last = F.floor((F.col("_step") + F.lit(before)) / F.lit(size))
    spec = Window.partitionBy(*keys, "_chunk").orderBy(order)
    out = (
        df.drop("_chunk")
        .withColumn("_step", steps)
        .withColumn("_chunk", F.explode(F.sequence(first, last)))
        .repartition(shuffle_width(df), *keys, "_chunk")
        .withColumns(build(spec))
        .where(home == F.col("_chunk"))
        .drop("_step")
    )
    return out if keep_chunk else out.drop("_chunk")


def grid_window(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    step: timedelta,
    before: int,
    after: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    chunk_steps: int | None = None,
    keep_chunk: bool = False,
) -> DataFrame:
    """``bounded_window`` over a series that has one row for every step of its grid.

    A missing or repeated step is an error at run time; ``row_window`` takes such series.
    """

    def checked(spec: WindowSpec) -> dict[str, Column]:
        last = F.lag("_step", 1).over(spec)
        return build(spec) | {"_gap": F.coalesce(F.col("_step") - last != 1, F.lit(False))}

    message = F.concat(F.lit("series is not on a full grid at "), F.col(ts).cast("string"))
    whole = F.when(F.col("_gap"), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    out = bounded_window(df, keys, ts, slot(ts, step), before, after, checked, chunk_steps, keep_chunk)
    return out.where(whole).drop("_gap")


def row_window(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    step: timedelta,
    before: int,
    after: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    chunk_steps: int | None = None,
    regular: bool = False,
) -> DataFrame:
    """``bounded_window`` over rows in time order, whatever times are missing.

    Rows are numbered first, and chunks are cut by row number, so a frame of ``before`` rows finds
    them all. ``step`` only sets how much time one numbering task covers. With ``regular`` the series
    are said to have a row for every step: that saves the numbering, and a gap is an error.
    """
    if regular:
        return grid_window(df, keys, ts, step, before, after, build, chunk_steps)
    numbered = with_position(df, keys, ts, step, "_position", "_rows", chunk_steps)
    out = bounded_window(numbered, keys, "_position", F.col("_position"), before, after, build, chunk_steps)
    return out.drop("_position", "_rows")


def _bucket(ts: str, step: timedelta, chunk_steps: int | None) -> Column:
    return F.floor(epoch_seconds(ts) / F.lit(seconds(step) * (chunk_steps or CHUNK_STEPS)))


def known(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that belong to a series: those with all of ``columns``.

    An inner or outer join only lets Spark add this rule to one side. Said for both, the branches
    of a later self-join stay equal, and Spark runs what they share once.
    """
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    step: timedelta = HOUR,
    position: str = "position",
    total: str = "n_rows",
    chunk_steps: int | None = None,
) -> DataFrame:
    """Add the 0-based row position inside the series and the series length.

    The window that numbers rows covers one bucket of time; counts of earlier buckets are
    added from a table with one row per bucket. The ``_chunk`` left by ``bounded_window`` serves
    as the bucket when it is there.
    """
    rows = known(df, [*keys, ts])
    if "_chunk" in df.columns:
        rows = rows.withColumnRenamed("_chunk", "_bucket")
    else:
        rows = rows.withColumn("_bucket", _bucket(ts, step, chunk_steps))
    rows = rows.where(F.col("_bucket").isNotNull())
    by_key = Window.partitionBy(*keys)
    earlier = by_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        rows.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select(
            *keys,
            "_bucket",
            F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"),
            F.sum("_size").over(by_key).alias(total),
        )
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(ts)
    return (
        rows.join(sizes, [*keys, "_bucket"], "left")
        .withColumn(position, F.col("_start") + F.row_number().over(inside) - F.lit(1))
        .drop("_bucket", "_start")
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    total: str = "equity",
    peak: str = "running_max",
    step: timedelta = DAY,
    chunk_steps: int | None = None,
) -> DataFrame:
    """Cumulative sum of ``value`` and the running maximum of that sum."""
    inside = Window.partitionBy(*keys, "_bucket").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    rows = known(df, [*keys, ts]).withColumn("_bucket", _bucket(ts, step, chunk_steps))
    rows = rows.where(F.col("_bucket").isNotNull()).withColumn("_sum", F.sum(value).over(inside))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*keys, "_bucket")
        .agg(F.sum(value).alias("_bucket_sum"), F.max("_sum").alias("_bucket_peak"))
        .withColumn("_start", F.coalesce(F.sum("_bucket_sum").over(earlier), F.lit(0.0)))
        .withColumn("_start_peak", F.max(F.col("_start") + F.col("_bucket_peak")).over(earlier))
        .select(*keys, "_bucket", "_start", "_start_peak")
    )
    missing = F.col(value).isNull()
    return (
        rows.join(carry, [*keys, "_bucket"], "left")
        .withColumn("_total", F.col("_start") + F.col("_sum"))
        .withColumn("_peak", F.greatest(F.col("_start_peak"), F.max("_total").over(inside)))
        .withColumn(total, F.when(~missing, F.col("_total")))
        .withColumn(peak, F.when(~missing, F.col("_peak")))
        .drop("_bucket", "_sum", "_start", "_start_peak", "_total", "_peak")
    )


def fill_gaps(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    columns: Sequence[str],
    step: timedelta = HOUR,
    head: bool = True,
    chunk_steps: int | None = None,
) -> DataFrame:
    """Carry the last known value forward; with ``head`` the leading gap takes the first value."""
    rows = known(df, [*keys, ts]).withColumn("_bucket", _bucket(ts, step, chunk_steps))
    rows = rows.where(F.col("_bucket").isNotNull())
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    summary = rows.groupBy(*keys, "_bucket").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"_last_{c}") for c in columns],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"_first_{c}") for c in columns],
    )
    carry = summary.select(
        *keys,
        "_bucket",
        *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_carry_{c}") for c in columns],
        *[F.first(f"_first_{c}", ignorenulls=True).over(every).alias(f"_head_{c}") for c in columns],
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)

    def filled(c: str) -> Column:
        parts = [F.last(c, ignorenulls=True).over(inside), F.col(f"_carry_{c}")]
        return F.coalesce(*parts, F.col(f"_head_{c}")) if head else F.coalesce(*parts)

    return (
        rows.join(carry, [*keys, "_bucket"], "left")
        .withColumns({c: filled(c) for c in columns})
        .select(*df.columns)
    )


def join_per_key(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    spread: str | Column | Sequence[str],
    how: str = "left",
    salts: int = SALTS,
) -> DataFrame:
    """Join a table that has few rows per series onto the rows of the series.

    Both sides carry a salt taken from ``spread``, so the rows of one large series meet their
    copy of the table in ``salts`` places. Spark broadcasts the table itself when it is small.
    Rows with a NULL key find nothing: a left join keeps them, with NULLs.
    """
    parts = [as_col(c) for c in ([spread] if isinstance(spread, (str, Column)) else spread)]
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        df.withColumn("_salt", F.pmod(F.xxhash64(*parts), F.lit(salts)).cast("int"))
        .join(salted, [*keys, "_salt"], how)
        .drop("_salt")
    )
