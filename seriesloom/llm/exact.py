"""Exact deduplication by Grace hashing: buckets that fit, tables that compare whole content.

1. Each task folds its own rows in an open-addressing table of bounded size, so a text that fills a
   third of the corpus leaves a task a few times only. The folded groups are written with the ids of
   their rows.
2. Buckets are cut from the content hash. A bucket whose distinct content is larger than
   ``bucket_bytes`` is cut again by the next hash bits, until each fits. One shuffle then spills every
   group to its bucket, and a table per bucket compares complete contents.
3. Rows learn the fate of their group by a join on the group's number, which is never hot.

Defined results: NULL text counts as empty. The row with the largest id stays; NULL ids come last;
of rows that repeat the largest id one stays. Extra columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.shared import free_name, partitions, stage

TABLE_BYTES = 16 << 20
BUCKET_BYTES = 64 << 20
STEP_BITS = 4
MOST_BITS = 60

GROUPS = pa.schema(
    [
        ("group", pa.int64()),
        ("hash", pa.int64()),
        ("text", pa.string()),
        ("bytes", pa.int64()),
        ("ids", pa.list_(pa.int64())),
        ("most", pa.int64()),
        ("n", pa.int64()),
    ]
)
FATES = "group long, keep_id long, group_size long, winner boolean, text_sha256 string"


class ContentTable:
    """Open addressing with linear probing; equal hashes are settled by the complete content."""

    def __init__(self) -> None:
        self._slots = np.full(1024, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def place(self, code: int, content: bytes) -> int:
        """The number of this content; new contents get the next."""
        slots, last = self._slots, len(self._slots) - 1
        at = code & last
        while (k := int(slots[at])) >= 0:
            if self.hashes[k] == code and self.contents[k] == content:
                return k
            at = (at + 1) & last
        k = len(self.contents)
        slots[at] = k
        self.hashes.append(code)
        self.contents.append(content)
        self.bytes += len(content) + 100
        if 2 * k > last:
            self._grow()
        return k

    def _grow(self) -> None:
        last = 4 * len(self._slots) - 1
        slots = np.full(last + 1, -1, np.int64)
        for k, code in enumerate(self.hashes):
            at = code & last
            while slots[at] >= 0:
                at = (at + 1) & last
            slots[at] = k
        self._slots = slots


def content_hash(content: bytes) -> int:
    return xxhash.xxh3_64_intdigest(content)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _folded(table: ContentTable, ids: list[list[int | None]], first: int) -> pa.RecordBatch:
    known = [[x for x in i if x is not None] for i in ids]
    rows = {
        "group": range(first, first + len(ids)),
        "hash": [_signed(h) for h in table.hashes],
        "text": [c.decode() for c in table.contents],
        "bytes": [len(c) + 100 for c in table.contents],
        "ids": ids,
        "most": [max(k, default=None) for k in known],
        "n": [len(i) for i in ids],
    }
    return pa.RecordBatch.from_pydict({k: list(v) for k, v in rows.items()}, GROUPS)


def _fold(table_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 36
        table, ids = ContentTable(), []
        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                content = text.as_buffer().to_pybytes() if text.is_valid else b""
                k = table.place(content_hash(content), content)
                if k == len(ids):
                    ids.append([])
                ids[k].append(key)
                if table.bytes + 8 * len(ids[k]) > table_bytes:
                    yield _folded(table, ids, number)
                    number += len(ids)
                    table, ids = ContentTable(), []
        if ids:
            yield _folded(table, ids, number)

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups, ordered by bucket, to the fate of each; one bucket's contents are held at a time."""
    bucket, table, seen = None, ContentTable(), []

    def fates() -> Iterator[pa.RecordBatch]:
        n, best = len(table.contents), {}
        size = [0] * n
        for group, k, most, count in seen:
            size[k] += count
            rank = (most is not None, most or 0, -group)
            if k not in best or rank > best[k][0]:
                best[k] = (rank, group, most)
        digest = [hashlib.sha256(c).hexdigest() for c in table.contents]
        for i in range(0, len(seen), 1 << 16):
            part = seen[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([g for g, *_ in part], pa.int64()),
                    pa.array([best[k][2] for _, k, *_ in part], pa.int64()),
                    pa.array([size[k] for _, k, *_ in part], pa.int64()),
                    pa.array([best[k][1] == g for g, k, *_ in part]),
                    pa.array([digest[k] for _, k, *_ in part]),
                ],
                ["group", "keep_id", "group_size", "winner", "text_sha256"],
            )

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("bucket", "group", "hash", "most", "n")]
        for b, group, code, most, count, text in zip(*columns, batch.column("text"), strict=True):
            if b != bucket:
                yield from fates()
                bucket, table, seen = b, ContentTable(), []
            k = table.place(code & (2**64 - 1), text.as_buffer().to_pybytes())
            seen.append((group, k, most, count))
    yield from fates()


def _bucketed(groups: DataFrame, bucket_bytes: int) -> DataFrame:
    """Add ``bucket``: hash bits, as many as it takes for the distinct content of each to fit."""
    contents = groups.groupBy("hash").agg(F.max("bytes").alias("bytes"))
    contents = stage(contents, "contents")
    total = contents.agg(F.sum("bytes")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, total / (bucket_bytes / 2))))))
    prefix = lambda n: F.shiftrightunsigned("hash", 64 - n) if n else F.lit(0).cast("long")
    name = lambda n: F.concat(F.lit(f"{n}:"), prefix(n).cast("string"))
    bucket = name(bits)
    over = contents.withColumn("bucket", bucket)
    splits: list[tuple[int, DataFrame]] = []
    while bits < MOST_BITS:
        full = over.groupBy("bucket").agg(F.sum("bytes").alias("held"), F.count("*").alias("texts"))
        full = stage(full.where((F.col("held") > bucket_bytes) & (F.col("texts") > 1)).select("bucket"), "full")
        if full.isEmpty():
            break
        bits += STEP_BITS
        splits.append((bits, full))
        over = over.join(full, "bucket", "left_semi").withColumn("bucket", name(bits))
    out = groups.withColumn("bucket", bucket)
    for finer, full in splits:
        out = out.join(full.withColumn("again", F.lit(True)), "bucket", "left")
        out = out.withColumn("bucket", F.when(F.col("again"), name(finer)).otherwise(F.col("bucket"))).drop("again")
    return out


def deduplicate(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    table_bytes: int = TABLE_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256."""
    narrow = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    fields = "`group` long, hash long, text string, bytes long, ids array<long>, most long, n long"
    groups = stage(narrow.mapInArrow(_fold(table_bytes), fields), "groups")
    bucketed = _bucketed(groups.drop("ids"), bucket_bytes)
    dealt = bucketed.repartition(partitions(docs), "bucket").sortWithinPartitions("bucket")
    fates = dealt.mapInArrow(_settle, FATES)
    rows = groups.select("group", "ids", "most").join(fates, "group")
    # The first place of the largest id in the winning group; a group without ids keeps its first row.
    place = F.when(F.col("most").isNull(), F.lit(0)).otherwise(F.array_position("ids", F.col("most")) - 1)
    rows = rows.withColumn("place", place.cast("int"))
    rows = rows.select("*", F.posexplode("ids").alias("at", "id"))
    return rows.select(
        F.col("id").alias(key),
        "keep_id",
        "group_size",
        (F.col("winner") & (F.col("at") == F.col("place"))).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that stay; of rows equal in id and text one stays."""
    fates = deduplicate(docs)
    rows = fates.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    stays = stage(rows.where("kept").select(F.col("doc_id").alias("id_"), F.col("text_sha256").alias("sha_"), "rows"), "stays")
    own = free_name(docs, "own_")
    coded = docs.withColumn(own, F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    same = (coded[own] == stays["sha_"]) & coded["doc_id"].eqNullSafe(stays["id_"])
    once = coded.join(stays.where("rows = 1"), same, "left_semi").select(docs.columns)
    again = stays.where("rows > 1")
    if again.isEmpty():
        return once
    repeated = coded.join(again, same, "left_semi").dropDuplicates(["doc_id", own]).select(docs.columns)
    return once.union(repeated)
