"""Rendezvous hashing over weighted shards, with gapless places inside every shard.

Each shard draws a number for a key from md5(key:shard); the key goes to the shard with the best
draw. A draw depends on the key and the shard's name only, so one more shard takes exactly the keys
it wins and no key moves between the old ones. With weights, the draw u in (0, 1) is ranked by
-ln(u) / weight, smallest first, which gives a shard its share of the keys by weight.

Places: a shard's rows lie in 4096 hash bins. Rows are numbered inside a bin, and bins begin where the
earlier bins of the shard end, so that no task sees a whole shard.

Defined results: a NULL key is the key 'null'. Equal keys share a shard; their places follow the
remaining order columns, and rows equal in those are alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIGITS = 13  # hexadecimal digits of a draw: 52 bits, exact in a double
BIN_DIGITS = 3


def draw(key: Column, shard: int) -> Column:
    """A whole number below 16**DIGITS."""
    digest = F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")


def best_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the best draw; of equal draws the first shard's. Weight 0 gets nothing."""
    live = [(i, w) for i, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a weight over 0")
    if len({w for _, w in live}) == 1:  # then the largest draw has the smallest -ln(u) / weight
        ranks = [F.struct(draw(key, i).alias("rank"), F.lit(-i).alias("shard")) for i, _ in live]
    else:
        unit = lambda i: (draw(key, i) + F.lit(0.5)) / F.lit(float(16**DIGITS))
        ranks = [F.struct((F.ln(unit(i)) / F.lit(float(w))).alias("rank"), F.lit(-i).alias("shard")) for i, w in live]
    best = ranks[0] if len(ranks) == 1 else F.greatest(*ranks)
    return -best["shard"]


def assign(df: DataFrame, key: str, weights: Sequence[float], extra: Sequence[float] = ()) -> DataFrame:
    """Add ``shard``, and with ``extra`` the ``grown_shard`` after adding shards of those weights."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    out = df.withColumn("shard", best_shard(name, weights))
    return out.withColumn("grown_shard", best_shard(name, [*weights, *extra])) if extra else out


def place(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... in each shard, by bin of the key, key and ``order``."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    binned = df.withColumn("bin_", F.substring(F.md5(F.concat(F.lit("slot:"), name).cast("binary")), 1, BIN_DIGITS))
    sizes = binned.groupBy("shard", "bin_").agg(F.count("*").alias("rows_"))
    before = F.sum("rows_").over(W.partitionBy("shard").orderBy("bin_")) - F.col("rows_")
    starts = sizes.select("shard", "bin_", before.alias("start_"))
    inside = F.row_number().over(W.partitionBy("shard", "bin_").orderBy(key, *order)) - 1
    numbered = binned.withColumn("inside_", inside)
    out = numbered.join(starts, ["shard", "bin_"])
    return out.withColumn("slot", F.col("start_") + F.col("inside_")).select(*df.columns, "slot")
