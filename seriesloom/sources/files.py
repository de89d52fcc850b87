"""File sources and sinks. Readers turn NaN into NULL, so that aggregates skip missing values."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from seriesloom.functions.columns import blank_nan


def small_table(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType | str) -> DataFrame:
    """A few given rows as a table of known size, so that joins with it need no shuffle."""
    fields = T.StructType.fromDDL(schema).fields if isinstance(schema, str) else schema.fields
    cells = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*cells)))


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: blank_nan(c) for c in floats}) if floats else df


def with_file_order(df: DataFrame) -> DataFrame:
    """Add ``_file`` and ``_line``: the order rows have in their files, for first-row rules."""
    return df.withColumn("_file", F.col("_metadata.file_name")).withColumn(
        "_line", F.monotonically_increasing_id()
    )


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, ordered: bool = False) -> DataFrame:
    """Read headed CSV with a given schema; a missing path raises ``FileNotFoundError``."""
    try:
        df = spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem):
            raise FileNotFoundError(path) from problem
        raise
    return nan_to_null(with_file_order(df) if ordered else df)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def read_table(spark: SparkSession, folder: str, name: str, columns: Sequence[str]) -> DataFrame:
    """One table of a folder of Parquet tables, narrowed to the columns in use."""
    return nan_to_null(spark.read.parquet(f"{folder}/{name}.parquet").select(*columns))


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace the table at ``path``."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Replace the CSV report at ``path``; times are written as ISO text."""
    df.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(path, header=True)


def read_report(spark: SparkSession, path: str, schema: T.StructType | str, ts: str | None = None) -> DataFrame:
    """Read a CSV report back; ``ts`` names a text column to be parsed as time."""
    df = read_csv(spark, path, schema)
    return df.withColumn(ts, F.to_timestamp_ntz(ts)) if ts else df


def normalize_time(df: DataFrame, source: str, ts: str = "ts", keep: bool = False) -> DataFrame:
    """Parse text with a UTC offset into UTC wall-clock time (session zone must be UTC).

    The text column goes, unless ``keep``.
    """
    out = df.withColumn(ts, F.to_timestamp(source).cast("timestamp_ntz"))
    return out if keep or source == ts else out.drop(source)


# Mean and spread of the placeholder price, the spread of its forecast error,
# and mean and spread of the interval half-width unit.
PLACEHOLDER = {"price": (60.0, 15.0), "error": 2.24, "uncertainty": (2.7, 0.5)}


def synthetic_results(
    spark: SparkSession, n: int, start: datetime = datetime(2018, 1, 1), seed: int = 0
) -> DataFrame:
    """An hourly results table of normal noise, to try the strategy operators without data."""
    price, spread = PLACEHOLDER["price"]
    width, width_spread = PLACEHOLDER["uncertainty"]
    base = spark.range(n).select(
        (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"),
        (F.randn(seed) * spread + price).alias("actual"),
        (F.randn(seed + 1) * PLACEHOLDER["error"]).alias("_error"),
        (F.randn(seed + 2) * width_spread + width).alias("_width"),
    )
    pred = F.col("actual") + F.col("_error")
    return base.select(
        "ts",
        "actual",
        pred.alias("bayesian_pred"),
        (pred + 2 * F.col("_width")).alias("upper_bound"),
        (pred - 2 * F.col("_width")).alias("lower_bound"),
    )
