"""Nearest-neighbour imputation, exact, without comparing every row with every row.

Donor rows are sorted along a curve that keeps near rows together (their scaled columns' bits, one after the
other; rows that miss the same columns lie together) and cut into blocks of a few thousand. Over the
blocks stands a tree of bounding boxes, FAN children to a node. A row with gaps goes down the tree: at each
level a box says how near and how far its donors can be, the farthest donor of a box with enough of them
bounds the k-th distance, and boxes beyond the bound are left out with all below them. The blocks that
remain are measured: first the nearest, which gives the true bound, then those within it. So a row meets the
boxes around it, not all boxes. Blocks are read by slices of rows, so no task holds more than one
block and one slice, whatever the size of a series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators.chunks import join_per_key
from seriesloom.operators.scale import minmax_fit, minmax_inverse, minmax_transform
from seriesloom.session import cut_lineage

NEIGHBOURS = 5
BLOCK_ROWS = 4096
SLICE_ROWS = 512
FAN = 64
CODE_BITS = 60  # of the sort code, shared among the columns


def knn_impute(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    k: int = NEIGHBOURS,
    ts: str = "ts",
    fit_on: Column | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Fill NULLs in ``columns`` with the mean of the ``k`` nearest rows of the series.

    Distance is taken over the columns both rows have, on min-max scaled values, and weighted
    up by the share of columns that count. A donor must have the wanted column. Fewer donors
    than ``k`` are averaged as they are; without any, the column mean is used; a column without
    values stays NULL. Ties go to the earlier row. Rows of one time are filled one by one. ``fit_on`` limits
    bounds, means and donors to the rows it selects. Runs jobs when called: it writes stages to the shared folder.
    """
    columns = list(columns)
    marked = df.withColumn("_fit", F.lit(True) if fit_on is None else F.coalesce(fit_on, F.lit(False)))
    bounds = minmax_fit(marked, keys, columns, F.col("_fit"))
    # Read many times below, so written once to the shared folder.
    scaled = minmax_transform(marked, bounds, keys, columns, ts).withColumn("_row", F.monotonically_increasing_id())
    scaled = cut_lineage(scaled)
    means = scaled.groupBy(*keys).agg(*[F.avg(F.when(F.col("_fit"), F.col(c))).alias(f"_mean_{c}") for c in columns])
    filled = _neighbour_values(scaled, keys, columns, k, ts, block_rows)
    rows = join_per_key(scaled.join(filled, "_row", "left"), means, keys, ts, "left")
    complete = rows.withColumns(
        {
            c: F.coalesce(F.col(c), F.try_element_at("_filled", F.lit(i)), F.col(f"_mean_{c}"))
            for i, c in enumerate(columns)
        }
    ).select(*df.columns)
    return minmax_inverse(complete, bounds, keys, columns, ts)


def _neighbour_values(
    scaled: DataFrame, keys: Sequence[str], columns: list[str], k: int, ts: str, block_rows: int
) -> DataFrame:
    """(_row, _filled): column number -> mean of the nearest donors, for rows with gaps."""
    known = [F.col(c).isNotNull() for c in columns]
    anything = known[0]
    everything = known[0]
    for c in known[1:]:
        anything, everything = anything | c, everything & c
    donors = into_blocks(scaled.where(F.col("_fit") & anything), keys, columns, ts, block_rows)
    gaps = scaled.where(~everything & anything).select(*keys, "_row", *columns)
    visits = search(gaps, box_tree(donors, keys, columns), keys, columns, k)
    cell = ["_row", "_wanted"]
    nearest = (
        visits.where(F.col("_donors") >= k)
        .groupBy(*keys, *cell)
        .agg(F.min_by(F.struct("_cell", "_sub"), F.struct("_least", "_cell", "_sub")).alias("_block"))
        .select(*keys, *cell, "_block._cell", "_block._sub")
    )
    reach = (
        _measure(nearest, gaps, donors, keys, columns, k, ts)
        .groupBy(*cell)
        .agg(F.max("_distance").alias("_reach"), F.count(F.lit(1)).alias("_found"))
        .where(F.col("_found") >= k)
        .drop("_found")
    )
    near = visits.join(reach, cell, "left").where(F.col("_reach").isNull() | within("_least", "_reach"))
    found = _measure(near.select(*keys, *cell, "_cell", "_sub"), gaps, donors, keys, columns, k, ts)
    best = Window.partitionBy(*cell).orderBy("_distance", "_donor_ts", "_donor")
    return (
        found.withColumn("_rank", F.row_number().over(best))
        .where(F.col("_rank") <= k)
        .groupBy(*cell)
        .agg(F.avg("_value").alias("_value"))
        .groupBy("_row")
        .agg(F.map_from_entries(F.collect_list(F.struct("_wanted", "_value"))).alias("_filled"))
    )


def within(least: str, bound: str) -> Column:
    """A hair of slack keeps boxes whose bound equals the reach up to rounding."""
    return F.col(least) <= F.col(bound) * (1 + 1e-9) + 1e-12


def sort_code(columns: Sequence[str]) -> Column:
    """The bits of the scaled columns, the first bit of each column, then the second of each, and so on."""
    used = columns[:CODE_BITS]
    bits = min(16, CODE_BITS // len(used))
    top = (1 << bits) - 1
    cells = [F.coalesce(F.greatest(F.least(F.floor(F.col(c) * (top + 1)), F.lit(top)), F.lit(0)), F.lit(0)).cast("long") for c in used]
    code = F.lit(0).cast("long")
    for b in range(bits):
        for i, cell in enumerate(cells):
            bit = F.shiftright(cell, b).bitwiseAND(F.lit(1).cast("long"))
            code = code.bitwiseOR(F.shiftleft(bit, b * len(used) + len(used) - 1 - i))
    return code


def into_blocks(rows: DataFrame, keys: Sequence[str], columns: list[str], ts: str, block_rows: int) -> DataFrame:
    """Add ``_cell`` and ``_sub``: blocks of at most ``block_rows`` rows of a series that are near each other.

    Rows are dealt to ranges of (series, missing columns, sort code) and written; blocks are counted inside a range.
    """
    missing = F.concat(*[F.when(F.col(c).isNull(), "-").otherwise("+") for c in columns])
    coded = rows.select(*keys, ts, "_row", *columns, missing.alias("_has"), sort_code(columns).alias("_code"))
    order = [*keys, "_has", "_code", ts, "_row"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(coded.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy(*keys, "_has", "_range").orderBy("_code", ts, "_row")) - 1
    cell = F.concat_ws("/", "_has", F.lpad(F.col("_range").cast("string"), 9, "0"))
    sub = F.floor(inside / F.lit(block_rows)).cast("bigint")
    return cut_lineage(ranged.withColumn("_sub", sub).withColumn("_cell", cell).drop("_has", "_range", "_code"))


def _merged(columns: Sequence[str], cells: Sequence[tuple[Column, Column, Column, Column]]) -> Column:
    names = ("lo", "hi", "n", "always")
    return F.array(*[F.struct(*[c.alias(n) for c, n in zip(cell, names, strict=True)]) for cell in cells]).alias("_box")


def box_tree(donors: DataFrame, keys: Sequence[str], columns: list[str]) -> list[DataFrame]:
    """Boxes of the blocks and of the nodes above them, from the blocks up to one node a series.

    A box has for each column the least and the greatest value, how many donors have it, and whether all have.
    Blocks also name their (_cell, _sub). Nodes are numbered along the curve: the parent of node i is i / FAN.
    """
    of_rows = [(F.min(c), F.max(c), F.count(c), F.count(c) == F.count(F.lit(1))) for c in columns]
    boxes = donors.groupBy(*keys, "_cell", "_sub").agg(_merged(columns, of_rows))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_cell", "_sub")) - 1
    levels = [cut_lineage(boxes.withColumn("_node", number.cast("bigint")))]
    most = levels[0].agg(F.max("_node")).first()[0] or 0
    while most > 0:
        part = lambda i, f: F.col("_box")[i][f]
        of_boxes = [
            (F.min(part(i, "lo")), F.max(part(i, "hi")), F.sum(part(i, "n")), F.bool_and(part(i, "always"))) for i in range(len(columns))
        ]
        parent = F.floor(F.col("_node") / F.lit(FAN)).alias("_node")
        levels.append(cut_lineage(levels[-1].groupBy(*keys, parent).agg(_merged(columns, of_boxes))))
        most //= FAN
    return levels


def box_distances(columns: list[str]) -> tuple[Column, Column]:
    """The least, and the greatest, squared distance a donor of ``_box`` can have from the row; no greatest (NULL)
    where a donor may share no column with the row."""
    least, far, farthest = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    shared, always = F.lit(0), F.lit(0)
    for i, c in enumerate(columns):
        box, x = F.col("_box")[i], F.col(c)
        out = F.greatest(box["lo"] - x, x - box["hi"], F.lit(0.0))
        away = F.greatest(F.abs(x - box["lo"]), F.abs(x - box["hi"]))
        some, all_have = x.isNotNull() & (box["n"] > 0), x.isNotNull() & box["always"]
        least = least + F.when(all_have, out * out).otherwise(F.lit(0.0))
        far = far + F.when(some, away * away).otherwise(F.lit(0.0))
        farthest = F.greatest(farthest, F.when(some, away * away).otherwise(F.lit(0.0)))
        shared, always = shared + F.when(some, 1).otherwise(0), always + F.when(all_have, 1).otherwise(0)
    size = F.lit(float(len(columns)))
    most = F.when(always == shared, far * size / F.when(shared > 0, shared)).otherwise(farthest * size)
    return F.coalesce(least * size / F.when(shared > 0, shared), F.lit(0.0)), F.when(always > 0, most)


def search(gaps: DataFrame, levels: list[DataFrame], keys: Sequence[str], columns: list[str], k: int) -> DataFrame:
    """(keys, _row, _wanted, _cell, _sub, _least, _donors): the blocks that may hold one of the ``k`` nearest donors of a gap.

    ``_least`` is the least squared distance such a donor can have, ``_donors`` how many the block has.
    """
    wanted = F.array(*[F.when(F.col(c).isNull(), F.lit(i)) for i, c in enumerate(columns)])
    here = gaps.withColumn("_wanted", F.explode(F.array_compact(wanted)))
    here = here.withColumns({"_at": F.lit(0).cast("bigint"), "_bound": F.lit(math.inf)})
    least, most = box_distances(columns)
    one = Window.partitionBy("_row", "_wanted")
    for level in reversed(levels):
        boxes = level.withColumn("_at", F.lit(0).cast("bigint") if level is levels[-1] else F.floor(F.col("_node") / F.lit(FAN)))
        met = join_per_key(here, boxes, [*keys, "_at"], "_row", "inner").withColumn("_donors", F.get("_box", F.col("_wanted"))["n"])
        met = met.where(F.col("_donors") > 0).withColumns({"_least": least, "_most": F.when(F.col("_donors") >= k, most)})
        met = met.withColumn("_bound", F.least("_bound", F.coalesce(F.min("_most").over(one), F.lit(math.inf))))
        here = cut_lineage(met.where(within("_least", "_bound")).drop("_box", "_most", "_at")).withColumnRenamed("_node", "_at")
        if level is not levels[0]:
            here = here.drop("_least", "_donors")
    return here.select(*keys, "_row", "_wanted", "_cell", "_sub", "_least", "_donors")


def _measure(
    visits: DataFrame, gaps: DataFrame, donors: DataFrame, keys: Sequence[str], columns: list[str], k: int, ts: str
) -> DataFrame:
    """(_row, _wanted, _distance, _donor_ts, _donor, _value): the ``k`` nearest donors inside each
    visited block."""
    block = [*keys, "_cell", "_sub"]
    asked = visits.groupBy(*block, "_row").agg(F.collect_set("_wanted").alias("_wanted"))
    slices = asked.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / F.lit(SLICE_ROWS)).alias("_slices"))
    readers = (
        join_per_key(asked, slices, block, "_row")
        .withColumn("_slice", F.pmod(F.xxhash64("_row"), F.col("_slices")))
        .drop("_slices")
        .join(gaps.drop(*keys), "_row")
    )
    copies = (
        donors.join(slices, block)
        .withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_slices") - 1)))
        .drop("_slices")
    )
    schema = T.StructType(
        [
            T.StructField("_row", T.LongType()),
            T.StructField("_wanted", T.IntegerType()),
            T.StructField("_distance", T.DoubleType()),
            T.StructField("_donor_ts", donors.schema[ts].dataType),
            T.StructField("_donor", T.LongType()),
            T.StructField("_value", T.DoubleType()),
        ]
    )
    group = [*block, "_slice"]

    def nearest(readers: pd.DataFrame, donors: pd.DataFrame) -> pd.DataFrame:
        if readers.empty or donors.empty:
            return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in schema})
        donors = donors.rename(columns=lambda c: c.removeprefix("_of_")).sort_values([ts, "_row"])
        found = block_neighbours(readers[columns].to_numpy(float), readers["_wanted"], donors[columns].to_numpy(float), k)
        row, wanted, donor, distance = found
        out = readers.iloc[row][["_row"]].reset_index(drop=True)
        out["_wanted"] = wanted
        out["_distance"] = distance
        out["_donor_ts"] = donors[ts].to_numpy()[donor]
        out["_donor"] = donors["_row"].to_numpy()[donor]
        out["_value"] = donors[columns].to_numpy(float)[donor, wanted]
        return out[schema.fieldNames()]

    renamed = copies.select([F.col(c).alias(f"_of_{c}") for c in copies.columns])
    return (
        readers.groupBy(*group)
        .cogroup(renamed.groupBy(*[f"_of_{c}" for c in group]))
        .applyInPandas(nearest, schema)
    )


def block_neighbours(rows: np.ndarray, wanted, donors: np.ndarray, k: int):
    """For each (row, wanted column) the ``k`` nearest donors; of equal ones the first in order."""
    total = np.zeros((len(rows), len(donors)))
    shared = np.zeros_like(total)
    for c in range(rows.shape[1]):
        miss = rows[:, c][:, None] - donors[:, c][None, :]
        both = ~np.isnan(miss)
        total += np.where(both, miss * miss, 0.0)
        shared += both
    distance = np.where(shared > 0, total * rows.shape[1] / np.where(shared > 0, shared, 1), np.inf)
    asked = [np.asarray(a, int) for a in wanted]
    asker = np.repeat(np.arange(len(asked)), [len(a) for a in asked])
    column = np.concatenate(asked) if asked else np.zeros(0, int)
    parts = []
    for c in np.unique(column):
        readers, able = asker[column == c], np.flatnonzero(~np.isnan(donors[:, c]))
        near = distance[np.ix_(readers, able)]
        best = np.argsort(near, axis=1, kind="stable")[:, :k]
        found = np.take_along_axis(near, best, axis=1)
        row, place = np.nonzero(np.isfinite(found))
        parts.append((readers[row], np.full(len(row), c), able[best[row, place]], found[row, place]))
    kinds = (int, "int32", int, float)
    if not parts:
        return tuple(np.zeros(0, kind) for kind in kinds)
    return tuple(np.concatenate(p).astype(kind) for p, kind in zip(zip(*parts, strict=True), kinds, strict=True))
