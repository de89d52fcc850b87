"""Sliding windows of past rows as array columns, for models that read sequences."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from seriesloom.operators.chunks import HOUR, row_window


def sequence_windows(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    target: str,
    length: int,
    ts: str = "ts",
    step: timedelta = HOUR,
    chunk_steps: int | None = None,
    carry: Sequence[str] = (),
    regular: bool = False,
) -> DataFrame:
    """(keys, ts, carry, seq, y): ``seq`` holds the ``length`` rows before ``ts``, ``y`` the target at it.

    A series of n rows gives n - length windows; ``regular`` as in ``chunks.row_window``. ``carry`` names columns to keep from the row at
    ``ts``: what is worked out on the narrow rows first needs no shuffle of arrays later.
    """

    def build(spec: WindowSpec) -> dict[str, Column]:
        return {"seq": F.collect_list(F.struct(*features)).over(spec.rowsBetween(-length, -1))}

    narrow = df.select(*keys, ts, *dict.fromkeys([*features, target, *carry]))
    windows = row_window(narrow, keys, ts, step, length, 0, build, chunk_steps, regular)
    return windows.where(F.size("seq") == length).select(*keys, ts, *carry, "seq", F.col(target).alias("y"))


def known_decoder(seq: str | Column, length: int, horizon: int, features: Sequence[str]) -> Column:
    """The last half of an encoder window followed by ``horizon`` rows of zeros."""
    half = length // 2
    zero = F.struct(*[F.lit(0.0).alias(f) for f in features])
    seq = F.col(seq) if isinstance(seq, str) else seq
    return F.concat(F.slice(seq, length - half + 1, half), F.array_repeat(zero, horizon))


def encdec_windows(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    target: str,
    length: int,
    horizon: int,
    ts: str = "ts",
    step: timedelta = HOUR,
    chunk_steps: int | None = None,
    regular: bool = False,
) -> DataFrame:
    """(keys, ts, encoder, decoder, target): ``ts`` is the last time the encoder sees.

    A series of n rows gives n - length - horizon + 1 windows.
    """

    def build(spec: WindowSpec) -> dict[str, Column]:
        rows = F.struct(*[F.col(f).cast("double").alias(f) for f in features])
        return {
            "encoder": F.collect_list(rows).over(spec.rowsBetween(1 - length, 0)),
            "_target": F.collect_list(F.struct(F.col(target).alias("v"))).over(spec.rowsBetween(1, horizon)),
        }

    narrow = df.select(*keys, ts, *dict.fromkeys([*features, target]))
    windows = row_window(narrow, keys, ts, step, length - 1, horizon, build, chunk_steps, regular)
    full = (F.size("encoder") == length) & (F.size("_target") == horizon)
    return windows.where(full).select(
        *keys,
        ts,
        "encoder",
        known_decoder("encoder", length, horizon, features).alias("decoder"),
        F.col("_target.v").alias("target"),
    )


def window_counts(df: DataFrame, keys: Sequence[str], length: int, horizon: int, batch: int) -> DataFrame:
    """Windows and whole batches that a series of this size yields, from row counts alone."""
    n = F.count(F.lit(1))
    zero = F.lit(0)
    return df.groupBy(*keys).agg(
        n.alias("n_rows"),
        F.greatest(n - length, zero).alias("n_sequences"),
        F.greatest(n - (length + horizon) + 1, zero).alias("n_encdec"),
        F.floor(F.greatest(n - (length + horizon), zero) / F.lit(batch)).alias("batch_steps"),
    )
