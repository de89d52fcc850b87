"""Benchmark items inside documents: a MinHash containment search, then exact containment.

Only SQL functions run here. Words are runs of bytes other than ASCII white space, A-Z as a-z; an
item's shingles are its distinct runs of five words. An item is contained in a document if the
document has at least ``share`` (0.75) of them.

Search: shingles are ranked by a hash. Items are parted by size; an item of m shingles is known by
its m - ceil(share * m) + 1 smallest hashes, the signature that its size class needs: a document
with ``share`` of the item's shingles lacks at most m - ceil(share * m) of them and so holds at least
one of the signature. All shingles of all documents probe the signatures, so no long document hides
a short item, and the search misses nothing. Documents are parted by size too: one with fewer
shingles than ceil(share * m) cannot contain the item.

Check: the documents found are read again, and all their shingles are matched with all shingles of
the items found in them.

The join with the signatures is left to Spark: it broadcasts them while they are small (a test set's
are) and shuffles otherwise. The documents' shingles meet them right where they are made.

Defined results: an item of one to four words is one shingle of all its words and is contained where
these words stand in a row. Items without words are contained nowhere. NULL texts have no words.
Items and documents are told apart by a code of id and text, which is never NULL: ids may be NULL, and
different texts under one id each count alone and get their own rows. Copies of a row get one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.shared import free_name, stage

SIZE = 5
SHARE = 0.75
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_list(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _code(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.col(text))


def _shingles(rows: DataFrame, size: int) -> DataFrame:
    """A row for each run of ``size`` words in ``words``, as its hash."""
    places = F.sequence(F.lit(0), F.size("words") - size)
    at = rows.where(F.size("words") >= size).withColumn("at_", F.explode(places))
    run = [F.get("words", F.col("at_") + k) for k in range(size)]
    return at.select("*", F.xxhash64(F.lit(size), *run).alias("shingle"))


def item_shingles(items: DataFrame, key: str, text: str, share: float) -> DataFrame:
    """item, item_id, size, shingle, n_shingles, wanted (the least to share) and rank of each shingle."""
    listed = items.select(_code(key, text).alias("item"), F.col(key).alias("item_id"), word_list(F.col(text)).alias("words"))
    sized = listed.withColumn("size", F.least(F.lit(SIZE), F.size("words"))).where("size > 0")
    each = [_shingles(sized.where(F.col("size") == k), k).select("item", "item_id", "size", "shingle") for k in range(1, SIZE + 1)]
    rows = each[0]
    for more in each[1:]:
        rows = rows.union(more)
    rows = rows.distinct()
    sets = rows.groupBy("item", "item_id").agg(F.sort_array(F.collect_list(F.struct("shingle", "size"))).alias("set"))
    n = F.size("set")
    out = sets.select("item", "item_id", n.alias("n_shingles"), F.ceil(n * F.lit(share)).alias("wanted"), F.posexplode("set").alias("rank", "one"))
    return out.select("item", "item_id", "n_shingles", "wanted", "rank", "one.size", "one.shingle")


def contained(
    docs: DataFrame,
    items: DataFrame,
    share: float = SHARE,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """doc_id, item_id, n_shingles of the item, n_shared, for every item contained in a document.

    Joins are on codes only; ids, which may be NULL, travel beside them.
    """
    known = stage(item_shingles(items, item_key, item_text, share), "items")
    signatures = known.where(F.col("rank") <= F.col("n_shingles") - F.col("wanted"))
    signatures = stage(signatures.select("item", "size", "shingle", "wanted"), "signatures")
    sizes = sorted(r[0] for r in known.select("size").distinct().collect())  # at most SIZE values
    texts = docs.select(_code(key, text).alias("doc"), F.col(key).alias("doc_id"), F.col(text).alias("text"))
    listed = texts.select("doc", word_list(F.col("text")).alias("words"))
    found, full = None, None
    for size in sizes:
        probes = _shingles(listed, size)
        of_size = signatures.where(F.col("size") == size).drop("size")
        hits = probes.join(of_size, "shingle").where(F.size("words") - (size - 1) >= F.col("wanted"))
        hits = hits.select("doc", "item")
        found = hits if found is None else found.union(hits)
    if found is None:
        empty = known.select(F.lit(None).cast(docs.schema[key].dataType).alias("doc_id"), "item_id")
        return empty.select("doc_id", "item_id", F.lit(0).alias("n_shingles"), F.lit(0).cast("long").alias("n_shared")).limit(0)
    found = stage(found.distinct(), "found")
    suspects = stage(found.select("doc").distinct(), "suspects")
    again = texts.join(suspects, "doc").select("doc", "doc_id", word_list(F.col("text")).alias("words"))
    for size in sizes:
        rows = _shingles(again, size).select("doc", "doc_id", "shingle").join(known.where(F.col("size") == size), "shingle")
        rows = rows.select("doc", "doc_id", "item", "item_id", "n_shingles", "wanted", "shingle")
        full = rows if full is None else full.union(rows)
    full = full.join(found, ["doc", "item"], "left_semi")
    counted = full.groupBy("doc", "item", "doc_id", "item_id").agg(
        F.first("n_shingles").alias("n_shingles"),
        F.first("wanted").alias("wanted"),
        F.count_distinct("shingle").alias("n_shared"),
    )
    return counted.where("n_shared >= wanted").select("doc_id", "item_id", "n_shingles", "n_shared")


def clean(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """The documents that contain no item. Rows count by their text, so their ids may repeat or be NULL."""
    code = free_name(docs, "code_")
    coded = docs.withColumn(code, F.xxhash64("text"))
    bad = contained(coded.select(code, "text"), items, share, key=code).select(F.col("doc_id").alias(code))
    return coded.join(stage(bad.distinct(), "contaminated"), code, "left_anti").select(docs.columns)
