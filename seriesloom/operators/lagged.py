"""Sums of products of a series with its own past, and kernels over chunks of consecutive rows.

A chunk is a fixed number of consecutive rows of one series; a kernel sees a chunk with the rows just
before it and works on it with numpy. Only narrow rows are shuffled: the rows of the series on the way in,
and numbered partial sums on the way out, which are reduced before they move.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators.chunks import CHUNK_STEPS, HOUR, join_per_key, known, slot, with_position

# A kernel gets the values of a chunk (a row per row, NaN where missing), the position of the first of
# them, and how many of the first rows belong to the chunk before.
Kernel = Callable[[np.ndarray, int, int], dict[str, np.ndarray]]

SUMS = ("n", "sum_a", "sum_b", "sum_aa", "sum_bb", "sum_ab")
# Variance that is less than this share of the squares it came from is rounding, not variance.
ROUNDING = 1e-12


def no_rows(schema: T.StructType) -> pd.DataFrame:
    return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in schema})


def chunk_size(reach: int, chunk_steps: int | None = None) -> int:
    """Rows of a chunk: many times its reach, so that few rows are copied to a neighbour."""
    return chunk_steps or max(10 * reach, CHUNK_STEPS)


def into_chunks(numbered: DataFrame, size: int, before: int, after: int = 0, position: str = "position") -> DataFrame:
    """Copy each row into the chunks that see it: ``_chunk``."""
    first = F.floor((F.col(position) - F.lit(after)) / F.lit(size))
    last = F.floor((F.col(position) + F.lit(before)) / F.lit(size))
    return numbered.withColumn("_chunk", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("bigint")), last)))


def over_chunks(
    numbered: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    kernel: Kernel,
    out: str,
    before: int,
    size: int,
    tables: DataFrame | None = None,
    position: str = "position",
) -> DataFrame:
    """(keys, ``out``): what the kernel makes of every chunk of every series.

    ``numbered`` has a row per position, 0, 1, 2, ... in each series. With ``tables`` (one row per series)
    the kernel gets the series' row as a further argument; chunks of a series without one are left out.
    """
    rows = into_chunks(numbered.select(*keys, position, *columns), size, before, 0, position)
    made = T.StructType.fromDDL(out)
    schema = T.StructType([*[numbered.schema[k] for k in keys], *made.fields])

    def run(key: tuple, part: pd.DataFrame, *more) -> pd.DataFrame:
        part = part.sort_values(position)
        places = part[position].to_numpy()
        begin = key[-1] * size
        if len(places) and places[-1] - places[0] != len(places) - 1:
            raise ValueError(f"rows of a series are missing or repeated between {places[0]} and {places[-1]}")
        if places[-1] < begin:  # rows of the chunk before only
            return no_rows(schema)
        made_here = kernel(part[list(columns)].to_numpy(float), int(places[0]), int((places < begin).sum()), *more)
        made_here = pd.DataFrame(made_here)
        if made_here.empty:
            return no_rows(schema)
        for k, value in zip(keys, key, strict=False):
            made_here[k] = value
        return made_here[schema.fieldNames()]

    if tables is None:
        return rows.groupBy(*keys, "_chunk").applyInPandas(lambda key, part: run(key, part), schema)
    # One copy of the series' row for each of its chunks.
    count = numbered.groupBy(*keys).agg(F.floor(F.max(position) / F.lit(size)).alias("_last"))
    one = F.lit(1).alias("_one")  # a table without keys has one row
    told = count.select("*", one).join(tables.select("*", one), [*keys, "_one"]).drop("_one")
    told = told.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last")))).drop("_last")
    renamed = told.select([F.col(c).alias(f"_of_{c}") for c in told.columns])

    def met(key: tuple, part: pd.DataFrame, told_here: pd.DataFrame) -> pd.DataFrame:
        if part.empty or told_here.empty:
            return no_rows(schema)
        return run(key, part, told_here.iloc[0].rename(lambda c: c.removeprefix("_of_")))

    return (
        rows.groupBy(*keys, "_chunk")
        .cogroup(renamed.groupBy(*[f"_of_{c}" for c in (*keys, "_chunk")]))
        .applyInPandas(met, schema)
    )


def centred(df: DataFrame, keys: Sequence[str], columns: Sequence[str], ts: str) -> DataFrame:
    """Less the mean of the series, as ``_mean_`` columns beside: sums of squares then lose no digits to a high level."""
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
    rows = join_per_key(df, means, keys, ts)
    return rows.withColumns({c: F.col(c) - F.col(f"_mean_{c}") for c in columns})


def correlate(a: np.ndarray, b: np.ndarray, home: int, max_lag: int) -> np.ndarray:
    """Sum over the rows t from ``home`` on of a[t] * b[t - lag], for lags 0 to ``max_lag``, by one transform.

    What would wrap around meets the zeros that stand for the rows before ``home``.
    """
    size = 1 << (len(a) + max(0, max_lag - home)).bit_length()
    own = np.zeros(size)
    own[home : len(a)] = a[home:]
    return np.fft.irfft(np.fft.rfft(own) * np.conj(np.fft.rfft(b, size)), size)[: max_lag + 1]


def lag_sums_kernel(pairs: Sequence[tuple[int, int]], max_lag: int) -> Kernel:
    def run(values: np.ndarray, first: int, home: int) -> dict[str, np.ndarray]:
        there = (~np.isnan(values)).astype(float)
        values = np.where(there > 0, values, 0.0)
        parts = []
        for i, j in pairs:
            x, y, mx, my = values[:, i], values[:, j], there[:, i], there[:, j]
            cells = [(mx, my), (x, my), (mx, y), (x * x, my), (mx, y * y), (x, y)]
            sums = {name: correlate(u, v, home, max_lag) for name, (u, v) in zip(SUMS, cells, strict=True)}
            sums["n"] = np.rint(sums["n"]).astype(np.int64)
            parts.append({"a": np.full(max_lag + 1, i), "b": np.full(max_lag + 1, j), "lag": np.arange(max_lag + 1), **sums})
        return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}

    return run


def lagged_sums(
    numbered: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    max_lag: int,
    pairs: Sequence[tuple[int, int]] | None = None,
    chunk_steps: int | None = None,
) -> DataFrame:
    """(keys, a, b, lag, n, sum_a, sum_b, sum_aa, sum_bb, sum_ab) for lags 0 to ``max_lag``.

    Sums run over the rows where column ``a`` is known and column ``b`` is known ``lag`` rows earlier; ``a`` and
    ``b`` are places in ``columns``. The cost is n * log(chunk), whatever ``max_lag``: chunks are at least
    ten times as long, overlap by it, and their sums are added per lag. Pass centred columns.
    """
    pairs = pairs or [(i, j) for i in range(len(columns)) for j in range(len(columns))]
    out = "a int, b int, lag int, n long, " + ", ".join(f"{s} double" for s in SUMS[1:])
    parts = over_chunks(numbered, keys, columns, lag_sums_kernel(pairs, max_lag), out, max_lag, chunk_size(max_lag, chunk_steps))
    return parts.groupBy(*keys, "a", "b", "lag").agg(*[F.sum(s).alias(s) for s in SUMS])


def number_rows(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], ts: str = "ts", step: timedelta = HOUR,
    chunk_steps: int | None = None, regular: bool = False,
) -> DataFrame:
    """(keys, ts, columns, position, n_rows); an existing numbering is kept.

    With ``regular`` the series are said to have a row for every step: positions are steps since the epoch, which saves
    the numbering, and ``n_rows`` is left out. A gap is an error in ``over_chunks``.
    """
    if regular:
        return known(df, [*keys, ts]).select(*keys, ts, *columns, slot(ts, step).alias("position"))
    if {"position", "n_rows"} <= set(df.columns):
        return df.select(*keys, ts, *columns, "position", "n_rows")
    return with_position(df.select(*keys, ts, *columns), keys, ts, step, chunk_steps=chunk_steps)


def correlation_of_sums():
    """The correlation from one row of ``lagged_sums``; NULL where a side does not vary."""
    n = F.when(F.col("n") > 1, F.col("n"))
    var = {s: F.col(f"sum_{s}{s}") - F.col(f"sum_{s}") * F.col(f"sum_{s}") / n for s in "ab"}
    real = (var["a"] > F.col("sum_aa") * ROUNDING) & (var["b"] > F.col("sum_bb") * ROUNDING)
    shared = F.col("sum_ab") - F.col("sum_a") * F.col("sum_b") / n
    return F.when(real, shared / (F.sqrt(F.when(real, var["a"])) * F.sqrt(F.when(real, var["b"]))))
