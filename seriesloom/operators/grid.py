"""Regular time grids, resampling and joins on time."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.chunks import CHUNK_STEPS, HOUR, fill_gaps, join_per_key, known, seconds, shuffle_width


def _interval(n: Column, unit_seconds: int) -> Column:
    """``n`` steps as an interval; days and seconds apart, so that long spans do not overflow."""
    total = n * F.lit(unit_seconds)
    return F.make_dt_interval(
        days=F.floor(total / F.lit(86400)).cast("int"),
        secs=F.pmod(total, F.lit(86400)).cast("decimal(18,6)"),
    )


def _spans(df: DataFrame, keys: Sequence[str], ts: str, unit: int, shared: Sequence[str]) -> DataFrame:
    """(keys, _lo, _steps): first time of each series and whole steps from it to its last time."""
    touched = F.max(F.hash(*shared)) if shared else F.lit(0)
    span = df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"), touched.alias("_touched"))
    span = span.where(F.col("_touched").isNotNull())
    lo, hi = (F.unix_seconds(F.col(c).cast("timestamp")) for c in ("_lo", "_hi"))
    return span.select(*keys, "_lo", F.floor((hi - lo) / F.lit(unit)).alias("_steps"))


def grid_of(
    df: DataFrame, keys: Sequence[str], ts: str = "ts", step: timedelta = HOUR, shared: Sequence[str] = ()
) -> DataFrame:
    """Every step from the first to the last time of each series, counted from its first time.

    Expanded in two moves (chunks, spread out, then steps), so that no row carries the whole
    time axis of a long series. ``shared`` names the columns another branch of the plan reads from
    ``df``: reading them here too makes both branches the same, so the scan and the shuffle under
    them run once.
    """
    unit = seconds(step)
    chunks = _spans(df, keys, ts, unit, shared).withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.floor(F.col("_steps") / F.lit(CHUNK_STEPS))))
    )
    begin = F.col("_part") * F.lit(CHUNK_STEPS)
    end = F.least(F.col("_steps"), begin + F.lit(CHUNK_STEPS - 1))
    return (
        chunks.repartition(shuffle_width(df), *keys, "_part")
        .withColumn("_n", F.explode(F.sequence(begin, end)))
        .select(*keys, (F.col("_lo") + _interval(F.col("_n"), unit)).alias(ts))
    )


def to_grid(
    df: DataFrame, keys: Sequence[str], ts: str = "ts", step: timedelta = HOUR, unique: bool = False
) -> DataFrame:
    """Put each series on its full grid: gaps become NULL rows, off-grid rows go.

    Two rows with one time are an error at run time. Pass ``unique=True`` when the input comes
    from an aggregate over (keys, ts), to save the check.

    The given rows are dealt by series and bucket of CHUNK_STEPS steps, with a mark at the first
    step of every bucket; each then makes the steps up to the next one. Only given rows and marks
    are shuffled, and no full axis is joined.
    """
    values = [c for c in df.columns if c not in keys and c != ts]
    df = known(df, [*keys, ts])
    checked = df if unique else _one_per_time(df, keys, ts, values)
    unit = seconds(step)
    micros, width = unit * 1_000_000, unit * 1_000_000 * CHUNK_STEPS
    lo = F.unix_micros(F.col("_lo").cast("timestamp"))
    first = lambda bucket: F.greatest(lo, bucket * width + F.pmod(lo - bucket * width, F.lit(micros)))
    stop, bucket = lo + (F.col("_steps") + 1) * micros, F.col("_bucket")
    marks = (
        _spans(df, keys, ts, unit, values)
        .withColumn("_bucket", F.explode(F.sequence(F.floor(lo / width), F.floor((stop - micros) / width))))
        .withColumns({"_at": first(bucket), "_stop": F.least(stop, first(bucket + 1)), "_phase": F.pmod(lo, F.lit(micros))})
    )
    begin = F.col("_lo") + _interval(F.floor((F.col("_at") - lo) / micros), unit)
    marks = marks.select(
        *keys, begin.alias(ts), *[F.lit(None).cast(checked.schema[c].dataType).alias(c) for c in values], "_bucket", "_at", "_stop", "_phase"
    )
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    none = F.lit(None).cast("bigint")
    given = checked.select(*keys, F.col(ts).cast(marks.schema[ts].dataType).alias(ts), *values, F.floor(at / width), at, none, none)
    spec = Window.partitionBy(*keys, "_bucket").orderBy("_at", F.col("_phase").isNull())
    every = spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = marks.union(given).repartition(shuffle_width(df), *keys, "_bucket")
    rows = rows.withColumns({"_mark": F.col("_phase").isNotNull(), "_end": F.max("_stop").over(every), "_on": F.max("_phase").over(every)})
    rows = rows.where(F.pmod("_at", F.lit(micros)) == F.col("_on"))
    rows = rows.withColumn("_n", F.floor((F.coalesce(F.lead("_at", 1).over(spec), F.col("_end")) - F.col("_at")) / micros))
    rows = rows.withColumn("_n", F.when(F.col("_mark"), F.col("_n")).otherwise(F.greatest(F.col("_n"), F.lit(1))))
    rows = rows.where(F.col("_n") > 0).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    made = {ts: F.col(ts) + _interval(F.col("_i"), unit)} | {c: F.when(F.col("_i") == 0, F.col(c)) for c in values}
    return rows.select(*[made[c].alias(c) if c in made else F.col(c) for c in df.columns])


def _one_per_time(df: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str]) -> DataFrame:
    message = F.concat(F.lit("duplicate time in series: "), F.col(ts).cast("string"))
    single = F.when(F.col("_rows") > 1, F.raise_error(message)).otherwise(F.col(ts))
    return (
        df.groupBy(*keys, ts)
        .agg(*[F.first(c).alias(c) for c in values], F.count(F.lit(1)).alias("_rows"))
        .withColumn(ts, single)
        .drop("_rows")
    )


def resample_mean(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], width: str, ts: str = "ts"
) -> DataFrame:
    """Mean per bin of ``width``. Bins without rows, or without any value, do not appear."""
    bin_start = F.window(ts, width).getField("start").alias(ts)
    return df.groupBy(*keys, bin_start).agg(*[F.avg(c).alias(c) for c in columns]).dropna("any")


def outer_join_time(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of either side, by key and time."""
    return a.join(b, list(on), "full_outer")


def asof_fill(
    times: DataFrame,
    values: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    ts: str = "ts",
    step: timedelta = HOUR,
) -> DataFrame:
    """For each row of ``times`` the latest earlier-or-equal value; rows before the first value
    take the first value found at a wanted time."""
    wanted = times.select(*keys, ts).withColumn("_wanted", F.lit(True))
    known = values.select(*keys, ts, *columns)
    merged = wanted.join(known, [*keys, ts], "full_outer")
    forward = fill_gaps(merged, keys, ts, columns, step, head=False).where("_wanted").drop("_wanted")
    heads = forward.groupBy(*keys).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"_head_{c}") for c in columns]
    )
    filled = {c: F.coalesce(F.col(c), F.col(f"_head_{c}")) for c in columns}
    return join_per_key(forward, heads, keys, ts).withColumns(filled).select(*forward.columns)


def upsample(
    values: DataFrame, keys: Sequence[str], columns: Sequence[str], ts: str = "ts", step: timedelta = HOUR
) -> DataFrame:
    """Coarse values repeated onto a finer grid over the same span."""
    return asof_fill(grid_of(values, keys, ts, step), values, keys, columns, ts, step)
