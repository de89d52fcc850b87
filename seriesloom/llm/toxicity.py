"""Toxicity scores by non-negative learning from positive and unlabelled texts.

Known toxic texts are the positives; all others, toxic or not, are unlabelled. With class prior p the
risk of a linear scorer g is

    p * E_pos[l(g)]  +  max(0, E_unl[l(-g)] - p * E_pos[l(-g)]),

the second term being what negatives alone would cost, held at 0 or more; where it falls below 0 the
step goes the other way, so that the scorer doesn't learn single texts by heart. The loss l is the
logistic one, so that the sigmoid of g is a probability. Unlabelled texts are drawn from all texts,
known positives too, as the estimate asks for. Words whose share among the positives hardly differs
from that among the unlabelled (under LEAST_Z standard errors) get no weight, and an L1 penalty takes
it from more: long texts don't gather noise.

Several scorers are trained, each in one task on its own bounded sample: up to POSITIVES positives
and UNLABELLED unlabelled texts of any length, drawn by a hash of the id (scorers may share texts). A drawn text travels as
the set of its buckets, 2**BITS / 8 bytes at most, and a task holds those of the telling words only. The weights, 2**BITS
numbers a scorer, are sent to the scoring tasks. All texts are scored whole.

Texts count as the set of their hashed words, ASCII punctuation parting words.

Defined results: an empty or NULL text gets the sigmoid of the intercept. Without positives or without
unlabelled texts all scores are the prior. Repeated rows are scored alike; NULL ids are scored and
never learnt from. No rows: an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.shared import stage
from seriesloom.llm.words import words

BITS = 18
SCORERS = 4
POSITIVES = 3000
UNLABELLED = 6000
LEAST_Z = 4.0
LEAST_TEXTS = 5
PENALTY = 1.5e-4
STEPS = 1000
RATE = 1.0
THRESHOLD = 0.3

WEIGHTS = "scorer int, intercept double, weights binary"


class Sparse(NamedTuple):
    """Rows of distinct word buckets."""

    row: np.ndarray
    bucket: np.ndarray
    rows: int


def features(texts: pa.Array, bits: int = BITS) -> Sparse:
    rows, buckets = [], []
    for part in words(texts, letters_only=True):
        both = np.unique((part.text.astype(np.int64) << bits) | (part.hashes >> np.uint64(64 - bits)).astype(np.int64))
        rows.append((both >> bits) + part.first)
        buckets.append(both & ((1 << bits) - 1))
    none = np.zeros(0, np.int64)
    return Sparse(np.concatenate(rows or [none]), np.concatenate(buckets or [none]), len(texts))


def packed_set(buckets: np.ndarray, bits: int = BITS) -> bytes:
    """Sorted distinct buckets: their numbers, or one bit for each bucket there is if that is shorter."""
    if 4 * len(buckets) < (1 << bits) // 8:
        return buckets.astype("<u4").tobytes()
    held = np.zeros(1 << bits, bool)
    held[buckets] = True
    return np.packbits(held).tobytes()


def unpacked_set(data: bytes, bits: int = BITS) -> np.ndarray:
    if len(data) < (1 << bits) // 8:
        return np.frombuffer(data, "<u4").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8)))


def _telling(x: Sparse, positive: np.ndarray, size: int) -> np.ndarray:
    """The buckets whose share among positives differs from that among the others."""
    with_pos = np.bincount(x.bucket, positive[x.row], size)
    with_unl = np.bincount(x.bucket, ~positive[x.row], size)
    return _differs(with_pos, with_unl, positive.sum(), (~positive).sum())


def _differs(with_pos: np.ndarray, with_unl: np.ndarray, n_pos: int, n_unl: int) -> np.ndarray:
    usual = (with_unl + 1) / (n_unl + 2)
    z = (with_pos / n_pos - usual) / np.sqrt(usual * (1 - usual) / n_pos)
    enough = (with_pos + with_unl >= LEAST_TEXTS) & ((with_pos >= 0.01 * n_pos) | (z < 0))
    return enough & (np.abs(z) >= LEAST_Z)


def fit(x: Sparse, positive: np.ndarray, prior: float, bits: int = BITS, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Intercept and weights that lower the non-negative risk."""
    known = np.flatnonzero(_telling(x, positive, 1 << bits))
    place = np.full(1 << bits, -1)
    place[known] = np.arange(len(known))
    at = place[x.bucket]
    row, word = x.row[at >= 0], at[at >= 0]
    weights, scale = np.zeros(len(known)), np.full(len(known), 1e-8)
    intercept, intercept_scale = float(np.log(prior / (1 - prior))), 1e-8
    n_pos, n_unl = positive.sum(), (~positive).sum()
    for _ in range(steps):
        g = np.bincount(row, weights[word], x.rows) + intercept
        up = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        if_negative = np.logaddexp(0, g)
        negative = if_negative[~positive].mean() - prior * if_negative[positive].mean()
        slope_pos = np.where(positive, -prior * (1 - up) / n_pos, 0.0)
        slope_neg = np.where(positive, -prior * up / n_pos, up / n_unl)
        slope = slope_pos + slope_neg if negative >= 0 else -slope_neg
        gradient = np.bincount(word, slope[row], len(weights))
        scale += gradient * gradient
        rate = RATE / np.sqrt(scale)
        weights -= rate * gradient
        weights = np.sign(weights) * np.maximum(0, np.abs(weights) - rate * PENALTY)
        down = slope.sum()
        intercept_scale += down * down
        intercept -= RATE / np.sqrt(intercept_scale) * down
    out = np.zeros(1 << bits)
    out[known] = weights
    return float(intercept), out


def _telling_sets(sets: list[bytes], positive: np.ndarray) -> Sparse:
    """The texts' sets without the buckets that tell nothing, unpacked one at a time."""
    with_bucket = {True: np.zeros(1 << BITS), False: np.zeros(1 << BITS)}
    for data, known in zip(sets, positive, strict=True):
        with_bucket[bool(known)][unpacked_set(data)] += 1
    telling = _differs(with_bucket[True], with_bucket[False], positive.sum(), (~positive).sum())
    kept = [buckets[telling[buckets]] for buckets in map(unpacked_set, sets)]
    row = np.repeat(np.arange(len(sets)), [len(k) for k in kept])
    return Sparse(row, np.concatenate(kept), len(sets))


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to the sets of their buckets; doc_id and roles as they are."""
    for batch in batches:
        x = features(batch.column("text"))
        order = np.lexsort([x.bucket, x.row])
        edges = np.searchsorted(x.row[order], np.arange(x.rows + 1))
        buckets = x.bucket[order]
        sets = [packed_set(buckets[edges[i] : edges[i + 1]]) for i in range(x.rows)]
        columns = [batch.column("doc_id"), batch.column("roles"), pa.array(sets, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "roles", "buckets"])


def _train(prior: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "buckets"])
        rows = pd.concat([rows[rows["positive"]].head(POSITIVES), rows[~rows["positive"]].head(UNLABELLED)])
        positive = rows["positive"].to_numpy(bool)
        if positive.all() or not positive.any():
            return pd.DataFrame({"scorer": [], "intercept": [], "weights": []})
        intercept, weights = fit(_telling_sets(rows["buckets"].tolist(), positive), positive, prior)
        found = {"scorer": [int(rows["scorer"].iloc[0])], "intercept": [intercept], "weights": [weights.astype("<f4").tobytes()]}
        return pd.DataFrame(found)

    return run


def train(docs: DataFrame, labels: DataFrame, learn: Column) -> list[tuple[float, np.ndarray]]:
    """Scorers from the rows of ``docs`` and ``labels`` for which ``learn``, a condition on doc_id, holds.

    The class prior is the share of toxic labels there. At most SCORERS rows come back, of fixed size.
    """
    known = labels.where(learn & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if not prior or prior >= 1:
        return [(0.0 if prior is None else -20.0 if not prior else 20.0, np.zeros(1 << BITS, np.float32))]
    usable = docs.where(learn & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    usable = usable.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    toxic = stage(known.where("toxic = 1").select("doc_id", F.lit(True).alias("toxic")), "toxic-ids")
    n_toxic, total = max(1, toxic.count()), max(1, usable.count())
    # Thinned by hash first, so that few texts move: about twice as many as wanted.
    chance = lambda name, k: F.pmod(F.xxhash64(F.lit(name), F.lit(k), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    role = lambda k, positive: F.struct(F.lit(k).alias("scorer"), F.lit(positive).alias("positive"))
    drawn = [
        *[F.when(F.col("toxic") & (chance("positive", k) < 2.0 * POSITIVES / n_toxic), role(k, True)) for k in range(SCORERS)],
        *[F.when(chance("unlabelled", k) < 2.0 * UNLABELLED / total, role(k, False)) for k in range(SCORERS)],
    ]
    marked = usable.join(toxic, "doc_id", "left")
    thin = marked.select("doc_id", "text", F.array_compact(F.array(*drawn)).alias("roles")).where(F.size("roles") > 0)
    sets = thin.mapInArrow(_with_sets, "doc_id long, roles array<struct<scorer: int, positive: boolean>>, buckets binary")
    thin = sets.select("doc_id", "buckets", F.explode("roles").alias("role"))
    thin = thin.select("buckets", "role.*", F.xxhash64("role.scorer", "doc_id").alias("order"))
    found = thin.groupBy("scorer").applyInPandas(_train(float(prior)), WEIGHTS).collect()
    scorers = [(r["intercept"], np.frombuffer(r["weights"], "<f4")) for r in sorted(found)]
    return scorers or [(float(np.log(prior / (1 - prior))), np.zeros(1 << BITS, np.float32))]


def _apply(sent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = sent.value
        for batch in batches:
            x = features(batch.column("text"))
            total = np.zeros(x.rows)
            for intercept, weights in scorers:
                g = np.bincount(x.row, weights[x.bucket], x.rows) + intercept
                total += 1 / (1 + np.exp(-np.clip(g, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total / len(scorers))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, scorers: list[tuple[float, np.ndarray]]) -> DataFrame:
    """doc_id and score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(scorers)  # SCORERS * 2**BITS floats
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(_apply(sent), "doc_id long, score double")


def crc_of_id(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))
