"""What several operators use: written stages, lookups that stand a hot key, connected components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.session import scratch_path

SALTS = 16


def stage(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that lost executors replay nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


KIND = "kind_"


def stage_kinds(df: DataFrame, name: str, kind: Column) -> tuple[DataFrame, str]:
    """``stage`` with the rows of each kind in a folder of their own; the rows, and the path for ``done_with``."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df = df.withColumn(KIND, kind)
    df.write.option("compression", "zstd").partitionBy(KIND).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def done_with(spark: SparkSession, path: str, kind: str) -> None:
    """Give back the disk of rows of ``stage_kinds`` that nothing reads any more: no rows take their place."""
    spark.range(0).write.mode("overwrite").parquet(f"{path}/{KIND}={kind}")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many ``_`` behind it as make it a new column of ``df`` (letter case does not count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def salt_of(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def salted_lookup(left: DataFrame, right: DataFrame, on: str, spread: Sequence[str]) -> DataFrame:
    """Left join on a key that may be hot on the left; ``right`` has one row per key at most.

    Rows of a key are dealt by a hash of ``spread`` to SALTS tasks, each with its copy of the right
    row. NULL keys find nothing and stay.
    """
    copies = right.withColumn("salt_", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return left.withColumn("salt_", salt_of(*spread)).join(copies, [on, "salt_"], "left").drop("salt_")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Smallest labels go over the edges, and labels follow their own labels, until nothing changes:
    about log(diameter) rounds. Each round is written to the shared folder. Repeated edges, loops and
    both directions are fine; rows with a NULL end are no edges.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    both = both.union(both.select("other", "node")).distinct()
    both = stage(both, "edges")
    labels = both.groupBy("node").agg(F.min("other").alias("other"))
    labels = stage(labels.select("node", F.least("node", "other").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        lower = stage(lower, "lower")
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = lower.join(jump, "component").select("node", "old", F.col("next").alias("component"))
        labels = stage(labels, "labels")
        if labels.where("component <> old").isEmpty():
            return labels.select("node", "component")
