"""Importance resampling towards a target distribution, over hashed n-gram features.

Features of a text are its runs of one to ``orders`` words. A feature's bucket is the CRC-32 of its bytes
modulo ``buckets``. How often each bucket occurs in the raw texts and in the target texts gives the
bucket a gain, the logarithm of the smoothed ratio in whole thousandths. A text's weight is the sum of
the gains of its features; with a Gumbel draw from its id as noise, the texts with the greatest sums are
a sample without replacement in proportion to the weights.

Per slice of texts an open-addressed numpy table interns the n-grams: the xxhash64 of a feature says
where to look, its bytes decide. A slot keeps the feature's bucket, worked out once per distinct n-gram,
and its count. The counts of the slots are what the corpus statistics add up; the slot of each occurrence
gathers the gains when texts are weighed. Tables hold one slice (about 1 MB of texts, or one longer text).

Plan: one pass counts the buckets (a task sends at most ``buckets`` rows), one weighs. Only the gains, of
fixed size, pass through the driver. Ranks: the eligible texts, as narrow rows, are dealt to ranges of
scores; sizes of the ranges say where each begins; only ranges that hold drawn texts are numbered.

Defined results: NULL and empty texts have no features, weight 0 and are drawn only if ``least_words`` is
0. Rows count one by one, so repeated rows are drawn one by one; rows of one score and id are ranked in
the order they were read. A NULL id has the draw of the text 'null' and comes first among equal scores.
Without target texts all counts of the target are 0. No rows: an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesloom.llm.shared import partitions, stage
from seriesloom.llm.spans import NOT_ALNUM, word_spans

BUCKETS = 10_000
ORDERS = 1
LEAST_WORDS = 20
SHARE = (10, 100)
SEED = "2024"
THOUSAND = 1000

U64 = np.uint64
# The five primes of xxhash64.
_P1 = U64(0x9E3779B185EBCA87)
_P2 = U64(0xC2B2AE3D27D4EB4F)
_P3 = U64(0x165667B19E3779F9)
_P4 = U64(0x85EBCA77C2B2AE63)
_P5 = U64(0x27D4EB2F165667C5)
_SHORT = 32  # shorter features are hashed by numpy, all at once


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U64(by)) | (x >> U64(64 - by))


class Grams(NamedTuple):
    """Spans of bytes, readable eight at a time. ``data`` ends with eight spare bytes."""

    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    def eight(self, at: np.ndarray) -> np.ndarray:
        every = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        return every[at]

    def lane(self, which: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k + 7 of the spans ``which``, 0 beyond their ends."""
        left = np.clip(self.sizes[which] - 8 * k, 0, 8).astype(U64)
        mask = np.where(left == 8, ~U64(0), (U64(1) << (U64(8) * (left & U64(7)))) - U64(1))
        return np.where(left > 0, self.eight(np.where(left > 0, self.starts[which] + 8 * k, 0)) & mask, U64(0))

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i] + self.sizes[i]].tobytes()


def xxhash64(grams: Grams) -> np.ndarray:
    """The xxhash64, seed 0, of every span."""
    starts, sizes = grams.starts, grams.sizes
    out = _P5 + sizes.astype(U64)
    for k in range(3):  # whole lanes of eight bytes
        at = np.flatnonzero((sizes >= 8 * (k + 1)) & (sizes < _SHORT))
        lane = _turn(grams.eight(starts[at] + 8 * k) * _P2, 31) * _P1
        out[at] = _turn(out[at] ^ lane, 27) * _P1 + _P4
    at = np.flatnonzero((sizes & 4 > 0) & (sizes < _SHORT))
    four = grams.eight(starts[at] + (sizes[at] & ~7)) & U64(0xFFFFFFFF)
    out[at] = _turn(out[at] ^ (four * _P1), 23) * _P2 + _P3
    for k in range(3):  # the last bytes, one by one
        at = np.flatnonzero((sizes & 3 > k) & (sizes < _SHORT))
        one = grams.data[starts[at] + (sizes[at] & ~3) + k].astype(U64)
        out[at] = _turn(out[at] ^ (one * _P5), 11) * _P1
    out = (out ^ (out >> U64(33))) * _P2
    out = (out ^ (out >> U64(29))) * _P3
    out = out ^ (out >> U64(32))
    for i in np.flatnonzero(sizes >= _SHORT):
        out[i] = xxhash.xxh64_intdigest(grams.bytes_of(i))
    return out


def _crc_steps() -> np.ndarray:
    """What CRC-32 makes of each value of a byte. Fixed value: the reversed polynomial."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> np.uint32(1)) ^ np.uint32(0xEDB88320), step >> np.uint32(1))
    return step


_STEPS = _crc_steps()


def crc32(grams: Grams, which: np.ndarray) -> np.ndarray:
    """The CRC-32 of the spans ``which``."""
    starts, sizes = grams.starts[which], grams.sizes[which]
    out = np.full(len(which), 0xFFFFFFFF, np.uint32)
    at = np.flatnonzero(sizes < _SHORT)
    for k in range(_SHORT):
        at = at[sizes[at] > k]
        byte = grams.data[starts[at] + k]
        out[at] = _STEPS[(out[at] & np.uint32(255)) ^ byte] ^ (out[at] >> np.uint32(8))
    out = ~out
    for i in np.flatnonzero(sizes >= _SHORT):
        out[i] = zlib.crc32(grams.bytes_of(which[i]))
    return out.astype(np.int64)


def _equal(grams: Grams, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether spans a[i] and b[i] hold the same bytes."""
    same = grams.sizes[a] == grams.sizes[b]
    for k in range(_SHORT // 8):
        at = np.flatnonzero(same & (grams.sizes[a] > 8 * k) & (a != b))
        if not len(at):
            break
        same[at] = grams.lane(a[at], k) == grams.lane(b[at], k)
    for i in np.flatnonzero(same & (grams.sizes[a] > _SHORT) & (a != b)):
        same[i] = grams.bytes_of(a[i]) == grams.bytes_of(b[i])
    return same


class Table(NamedTuple):
    """An interned slice: per slot a bucket and a count, and the slot of each occurrence."""

    bucket: np.ndarray
    count: np.ndarray
    slot: np.ndarray


def intern(grams: Grams, buckets: int) -> Table:
    """Intern all spans in a table of at least twice their number of slots.

    All spans that have no slot yet try theirs at once: empty slots take one of the spans that came to
    them, spans equal to their slot's are done, the rest go on by one slot.
    """
    n = len(grams.starts)
    size = 1 << max(4, (2 * n).bit_length())
    keys = xxhash64(grams)
    holder, slot = np.full(size, -1, np.int64), np.zeros(n, np.int64)
    left, probe = np.arange(n), (keys & U64(size - 1)).astype(np.int64)
    while len(left):
        empty = holder[probe] < 0
        holder[probe[empty]] = left[empty]
        held = holder[probe]
        same = keys[held] == keys[left]
        same[same] = _equal(grams, left[same], held[same])
        slot[left[same]] = probe[same]
        left, probe = left[~same], (probe[~same] + 1) & (size - 1)
    bucket = np.zeros(size, np.int64)
    used = np.flatnonzero(holder >= 0)
    bucket[used] = crc32(grams, holder[used]) % buckets
    return Table(bucket, np.bincount(slot, minlength=size), slot)


class Features(NamedTuple):
    grams: Grams
    text: np.ndarray  # of each feature, in rising order within an order
    n_words: np.ndarray  # of each text
    first: int
    count: int


def features(texts: pa.Array, orders: int) -> Iterator[Features]:
    """All runs of one to ``orders`` words, slice by slice, their words joined by one space."""
    for part in word_spans(texts, NOT_ALNUM, lower=True):
        sizes = part.ends - part.starts
        # The words alone, each with a space behind: runs of words are spans of this.
        places = np.concatenate([[0], np.cumsum(sizes + 1)])
        keep = np.zeros(len(part.data) + 1, np.int8)
        keep[part.starts] = 1
        keep[part.ends] -= 1
        inside = np.cumsum(keep[:-1]) > 0
        out = np.full(places[-1] + 8, 0x20, np.uint8)
        target = np.ones(places[-1], bool)
        target[places[1:] - 1] = False
        out[: places[-1]][target] = part.data[inside]
        words = np.diff(part.bounds)
        text = np.repeat(np.arange(part.count), words)
        left = part.bounds[1:][text] - np.arange(len(sizes))  # words from here to the text's end
        starts, ends, owners = [], [], []
        for k in range(1, orders + 1):
            at = np.flatnonzero(left >= k)
            starts.append(places[at])
            ends.append(places[at + k] - 1)
            owners.append(text[at])
        first, last = np.concatenate(starts), np.concatenate(ends)
        yield Features(Grams(out, first, last - first), np.concatenate(owners), words, part.first, part.count)


def _count(buckets: int, orders: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in features(batch.column(0), orders):
                table = intern(part.grams, buckets)
                np.add.at(total, table.bucket[table.count > 0], table.count[table.count > 0])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, orders: int = ORDERS) -> DataFrame:
    """(bucket, n) of the features of all texts."""
    parts = texts.select(F.col(text)).mapInArrow(_count(buckets, orders), "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain): a row per bucket, from the counts of the raw and of the target texts."""
    spark = raw.sparkSession
    both = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(
        target.select("bucket", F.lit(0).cast("long"), F.col("n"))
    )
    both = both.union(spark.range(buckets).select("id", F.lit(0).cast("long"), F.lit(0).cast("long")))
    counts = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    every = W.partitionBy()  # a row per bucket: a fixed number
    counts = counts.withColumns({"all_s": F.sum("s").over(every), "all_t": F.sum("t").over(every)})
    real = lambda name, more: F.col(name).cast("double") + F.lit(float(more))
    ratio = real("t", 1) * real("all_s", buckets) / (real("s", 1) * real("all_t", buckets))
    return counts.select("bucket", F.floor(F.ln(ratio) * THOUSAND).alias("gain"))


def _weigh(gain: np.ndarray, orders: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in features(batch.column(1), orders):
                table = intern(part.grams, len(gain))
                found = gain[table.bucket[table.slot]]
                weight = np.zeros(part.count, np.int64)
                np.add.at(weight, part.text, found)
                columns = [
                    batch.column(0).slice(part.first, part.count),
                    pa.array(part.n_words),
                    pa.array(np.bincount(part.text, minlength=part.count)),
                    pa.array(weight),
                    pa.array(np.full(part.count, task)),
                    pa.array(np.arange(place, place + part.count)),
                ]
                place += part.count
                yield pa.RecordBatch.from_arrays(columns, ["key", "n_words", "n_features", "weight", "task", "place"])

    return run


def weigh(docs: DataFrame, gain: DataFrame, key: str = "doc_id", text: str = "text", orders: int = ORDERS) -> DataFrame:
    """(key, n_words, n_features, weight, task, place), written out. ``gain`` has a row per bucket, few enough for the driver."""
    table = {row["bucket"]: row["gain"] for row in gain.collect()}
    by_bucket = np.array([table[b] for b in range(len(table))], np.int64)
    narrow = docs.select(F.col(key).alias("key"), F.col(text))
    kind = narrow.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_words long, n_features long, weight long, task long, place long"
    return stage(narrow.mapInArrow(_weigh(by_bucket, orders), schema), "weights")


def noise(key: Column, seed: str = SEED) -> Column:
    """A Gumbel draw in whole thousandths from the first 32 bits of sha256(seed:key)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))) * F.lit(-float(THOUSAND)))


def draw(weighed: DataFrame, least_words: int = LEAST_WORDS, share: tuple[int, int] = SHARE, seed: str = SEED) -> DataFrame:
    """Add ``score`` and ``rank``: 1, 2, ... for the greatest scores of texts with ``least_words`` words, else NULL.

    ``share``: numerator and denominator of the part of these texts that is drawn, rounded down.
    """
    rows = weighed.withColumn("score", F.col("weight") + noise(F.col("key"), seed))
    fits = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("key").asc(), F.col("task"), F.col("place")]
    ranged = rows.where(fits).repartitionByRange(partitions(rows), *order)
    ranged = stage(ranged.withColumn("range_", F.spark_partition_id()), "ranges")
    sizes = stage(ranged.groupBy("range_").agg(F.count(F.lit(1)).alias("size_")), "sizes")
    before = F.sum("size_").over(W.orderBy("range_")) - F.col("size_")
    drawn = F.floor(F.sum("size_").over(W.partitionBy()) * share[0] / share[1])
    starts = stage(sizes.select("range_", before.alias("before_"), drawn.alias("drawn_")), "starts")
    placed = ranged.join(starts, "range_")
    first = placed.where(F.col("before_") < F.col("drawn_"))
    rank = F.row_number().over(W.partitionBy("range_").orderBy(*order)) + F.col("before_")
    numbered = first.withColumn("rank_", rank).withColumn("rank", F.when(F.col("rank_") <= F.col("drawn_"), F.col("rank_")))
    none = F.lit(None).cast("long")
    names = [*rows.columns, "rank"]
    beyond = placed.where(F.col("before_") >= F.col("drawn_")).withColumn("rank", none)
    short = rows.where(~fits).withColumn("rank", none)
    return numbered.select(names).union(beyond.select(names)).union(short.select(names))


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    buckets: int = BUCKETS,
    orders: int = ORDERS,
    least_words: int = LEAST_WORDS,
    share: tuple[int, int] = SHARE,
    seed: str = SEED,
) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank): a row per row of ``docs``; drawn texts have a rank."""
    raw = bucket_counts(docs, text, buckets, orders)
    gain = gains(raw, bucket_counts(target, target_text, buckets, orders), buckets)
    weighed = weigh(docs, gain, key, text, orders)
    drawn = draw(weighed, least_words, share, seed)
    return drawn.withColumnRenamed("key", key).select(key, "n_words", "n_features", "weight", "score", "rank")
