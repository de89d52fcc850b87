"""Exact n-gram Jaccard join: links between texts whose shingle sets overlap by 75% of their union.

Texts with equal sets are one node. Nodes that can link share a shingle of their prefixes: of n
shingles, ranked alike everywhere, the first n - ceil(0.75 n) + 1. Shingles that many texts have rank
last, so a passage that many texts share opens no group; which ones these are is read from counts in
2**SLOT_BITS slots over the whole corpus (the ranking decides speed only, never results).

1. Nodes that share a prefix shingle form a group, ordered by set size. Small groups give their pairs.
   Large ones are cut into tiles of TILE nodes, so that a tile is a band of sizes; only tiles whose
   bands are compatible meet.
2. A node's bitmap has the parity of the shingles hashed to each bit, two to four bits a shingle. The
   bits in which two bitmaps differ are at most the shingles in which the sets differ: their count
   bounds the overlap from above. Pairs over the bound are dropped.
3. What is left is checked exactly on sorted arrays of shingle hashes.

A pair inside a cluster of linked nodes can't change the result, so tiles meet in three rounds, each with the
clusters that the links before it made. First each tile meets itself and its neighbour. Then farther tiles meet, but only
those with more than one cluster between them: tiles of near copies, which their neighbours already join, don't. Where many
pairs pass in these rounds, a tile pair gives a star cover only (its best connected node with all that
pass, then the best of the rest, and so on, and a few pairs between each two stars); in the last round such tile pairs
give all passing pairs between different clusters, if there are still such. So no link between components is lost, and
groups of near copies don't give all their pairs.

Defined results: NULL and empty texts have no shingles and link with nothing; so have texts of white
space. A text of one to four words has its whole sequence as one shingle. Rows that repeat an id are
texts of their own. NULL ids count as larger than any id. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.shared import components, free_name, partitions, salted_lookup, stage
from seriesloom.llm.words import shingle_sets

PERCENT = 75  # the rules below are for this similarity: 175 * common >= 75 * (a + b)
SLOT_BITS = 24
BLOCK_BITS = 16
SMALL = 12
TILE = 2048
BRIDGES = 4
SEEN = 1 << 20
WANTED_BITS = 24
U64 = np.uint64

Batches = Iterator[pa.RecordBatch]


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) >> 1


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Parity of the shingles in each of 2n to 4n bits, as 64-bit words."""
    bits = max(64, 1 << int(2 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of words) of half, a quarter, ... of the width."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _first_seen(node: int, seen: set[int]) -> bool:
    if node in seen:
        return False
    if len(seen) >= SEEN:
        seen.clear()
    seen.add(node)
    return True


# --- scans of the texts ---------------------------------------------------------------------

NODES = "doc_id long, code long, n int, node long, bits binary, block int, counts binary, total long"
_NODE_FIELDS = [
    ("doc_id", pa.int64()),
    ("code", pa.int64()),
    ("n", pa.int32()),
    ("node", pa.int64()),
    ("bits", pa.binary()),
    ("block", pa.int32()),
    ("counts", pa.binary()),
    ("total", pa.int64()),
]


def _describe(batches: Batches) -> Batches:
    """A row per text, with a bitmap where its node is new to the task; then the task's slot counts."""
    schema, seen = pa.schema(_NODE_FIELDS), set()
    slots = np.zeros(1 << SLOT_BITS, np.uint32)
    for batch in batches:
        rows = []
        ids, codes = batch.column("doc_id").to_pylist(), batch.column("code").to_pylist()
        for t, shingles in shingle_sets(batch.column("text")):
            row = {"doc_id": ids[t], "code": codes[t], "n": len(shingles)}
            if len(shingles):
                row["node"] = _node(shingles)
                if _first_seen(row["node"], seen):
                    row["bits"] = bitmap(shingles).tobytes()
                    slots[shingles >> U64(64 - SLOT_BITS)] += 1  # a text's shingles rarely share a slot
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, schema)
    for k in range(1 << (SLOT_BITS - BLOCK_BITS)):
        part = slots[k << BLOCK_BITS : (k + 1) << BLOCK_BITS]
        if total := int(part.sum()):
            small = part.astype(np.uint8) if part.max() < 256 else part
            row = {"block": k, "counts": zlib.compress(small.tobytes(), 1), "total": total}
            yield pa.RecordBatch.from_pylist([row], schema)


def _unpacked(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data)
    return np.frombuffer(raw, np.uint8 if len(raw) == 1 << BLOCK_BITS else np.uint32)


def _common(most: float) -> Callable[[Batches], Batches]:
    """Slot counts ordered by block, to a bit for each slot that counts more than ``most``."""

    def run(batches: Batches) -> Batches:
        block, counts = None, None

        def out() -> pa.RecordBatch:
            bits = np.packbits(counts > most).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits])], ["block", "bits"])

        for batch in batches:
            for k, data in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if k != block:
                    if block is not None:
                        yield out()
                    block, counts = k, np.zeros(1 << BLOCK_BITS, np.int64)
                counts += _unpacked(data)
        if block is not None:
            yield out()

    return run


def _common_slots(described: DataFrame) -> np.ndarray:
    """Which slots many texts use: 2**SLOT_BITS bits, whatever the corpus."""
    rows = described.where("block is not null")
    mean = (rows.agg(F.sum("total")).first()[0] or 0) / (1 << SLOT_BITS)
    most = mean + 6 * mean**0.5 + 8
    dealt = rows.select("block", "counts").repartition(partitions(described), "block").sortWithinPartitions("block")
    common = np.zeros(1 << SLOT_BITS, bool)
    for row in dealt.mapInArrow(_common(most), "block int, bits binary").collect():
        part = np.unpackbits(np.frombuffer(row["bits"], np.uint8)).astype(bool)
        common[row["block"] << BLOCK_BITS : (row["block"] + 1) << BLOCK_BITS] = part
    return np.packbits(common)


PREFIXES = "shingle long, node long, n int"


def _prefixes(common: Broadcast) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        late, seen = np.unpackbits(common.value).astype(bool), set()
        for batch in batches:
            tokens, nodes, sizes = [], [], []
            for _, shingles in shingle_sets(batch.column("text")):
                n = len(shingles)
                if n and _first_seen(node := _node(shingles), seen):
                    rank = (shingles >> U64(1)) | (late[shingles >> U64(64 - SLOT_BITS)].astype(U64) << U64(63))
                    k = prefix_length(n)
                    tokens.append(rank if k >= n else np.partition(rank, k - 1)[:k])
                    nodes.append(node)
                    sizes.append(n)
            if nodes:
                each = [len(t) for t in tokens]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(tokens).view(np.int64)),
                        pa.array(np.repeat(np.array(nodes, np.int64), each)),
                        pa.array(np.repeat(np.array(sizes, np.int32), each)),
                    ],
                    ["shingle", "node", "n"],
                )

    return run


def _sets_of(wanted: Broadcast) -> Callable[[Batches], Batches]:
    """The shingle sets of wanted nodes; ``wanted`` has a bit for a hash of each."""

    def run(batches: Batches) -> Batches:
        bits, seen = np.unpackbits(wanted.value).astype(bool), set()
        for batch in batches:
            nodes, sets = [], []
            for _, shingles in shingle_sets(batch.column("text")):
                if len(shingles) and bits[(node := _node(shingles)) & ((1 << WANTED_BITS) - 1)] and _first_seen(node, seen):
                    nodes.append(node)
                    sets.append(shingles.tobytes())
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])

    return run


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


def _sets(narrow: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sorted shingle hashes of nodes, and of a few others."""
    wanted = narrow.sparkSession.sparkContext.broadcast(_wanted_bits(nodes))
    return stage(narrow.mapInArrow(_sets_of(wanted), "node long, shingles binary"), "sets")


def _wanted_bits(nodes: DataFrame) -> np.ndarray:
    """A bit for the low bits of each node: 2**WANTED_BITS bits, whatever the corpus."""
    low = F.col("node").bitwiseAND(F.lit((1 << WANTED_BITS) - 1))
    word = nodes.select(F.shiftright(low, 6).alias("word"), low.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    found = word.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    out = np.zeros(1 << (WANTED_BITS - 6), np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return np.packbits(np.unpackbits(out.view(np.uint8), bitorder="little"))


# --- groups and tiles -----------------------------------------------------------------------

GROUPS = "a long, b long, shingle long, tile int, node long, n int"


def _compatible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)


def _group_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = [pa.nulls(len(a), k) for k in (pa.int64(), pa.int32(), pa.int64(), pa.int32())]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *none], ["a", "b", "shingle", "tile", "node", "n"]
    )


def _tile_rows(shingle: int, tile: int, node: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    none, m = pa.nulls(len(node), pa.int64()), len(node)
    arrays = [none, none, pa.array(np.full(m, shingle)), pa.array(np.full(m, tile, np.int32)), pa.array(node), pa.array(n)]
    return pa.RecordBatch.from_arrays(arrays, ["a", "b", "shingle", "tile", "node", "n"])


def _grouped(small: int, tile_nodes: int) -> Callable[[Batches], Batches]:
    """Prefix rows ordered by (shingle, n, node): pairs of small groups, tiles of large ones.

    At most a batch and ``tile_nodes`` rows are held.
    """

    def run(batches: Batches) -> Batches:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        begun: tuple[int, int] | None = None  # a shingle of which tiles are out, and the next tile
        pairs: list[tuple[np.ndarray, np.ndarray]] = []

        def complete(token: np.ndarray, node: np.ndarray, n: np.ndarray) -> Batches:
            nonlocal begun
            if not len(token):
                return
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            sizes = np.diff(np.r_[starts, len(token)])
            open_first = begun is not None and token[0] == begun[0]
            whole = ~((starts == 0) & open_first)
            for size in range(2, small + 1):
                s = starts[(sizes == size) & whole][:, None]
                if len(s):
                    i, j = np.triu_indices(size, 1)
                    i, j = (s + i).ravel(), (s + j).ravel()
                    fits = _compatible(n[i], n[j])
                    pairs.append((node[i[fits]], node[j[fits]]))
            large = (sizes > small) & whole
            for s, size in zip(starts[large], sizes[large], strict=True):
                for k in range(0, size, tile_nodes):
                    e = s + min(size, k + tile_nodes)
                    yield _tile_rows(token[s], k // tile_nodes, node[s + k : e], n[s + k : e])
            if open_first:
                size = sizes[0]
                for k in range(0, size, tile_nodes):
                    e = min(size, k + tile_nodes)
                    yield _tile_rows(begun[0], begun[1] + k // tile_nodes, node[k:e], n[k:e])
            if sum(len(p[0]) for p in pairs) > 100_000:
                yield from flush()

        def flush() -> Batches:
            if pairs:
                both = np.stack([np.concatenate([p[k] for p in pairs]) for k in (0, 1)], 1)
                pairs.clear()
                both = np.unique(np.sort(both, 1), axis=0)
                if len(both):
                    yield _group_rows(both[:, 0].copy(), both[:, 1].copy())

        for batch in batches:
            rows = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("shingle", "node", "n"), strict=True)]
            token, node, n = rows
            keep = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])] if len(token) else np.zeros(0, bool)
            token, node, n = token[keep], node[keep], n[keep]
            last = int(np.searchsorted(token, token[-1])) if len(token) else 0
            yield from complete(token[:last], node[:last], n[:last])
            token, node, n = token[last:], node[last:], n[last:]
            while len(token) > tile_nodes + 1:
                tile = begun[1] if begun and begun[0] == token[0] else 0
                yield _tile_rows(token[0], tile, node[:tile_nodes], n[:tile_nodes])
                begun = (int(token[0]), tile + 1)
                token, node, n = token[tile_nodes:], node[tile_nodes:], n[tile_nodes:]
            held = [token, node, n]
        yield from complete(*held)
        yield from flush()

    return run


def passing(bits_a: list[bytes], n_a: np.ndarray, bits_b: list[bytes] | None, n_b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose sizes and bitmaps allow a link: within one list, or between two."""
    within = bits_b is None
    bits_b, n_b = (bits_a, n_a) if within else (bits_b, n_b)
    width_a = np.array([len(b) // 8 for b in bits_a])
    width_b = np.array([len(b) // 8 for b in bits_b])
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for wa in np.unique(width_a):
        at_a = np.flatnonzero(width_a == wa)
        rows_a = np.frombuffer(b"".join(bits_a[i] for i in at_a), "<u8").reshape(len(at_a), wa)
        for wb in (wa // 2, wa, 2 * wa):
            at_b = np.flatnonzero(width_b == wb)
            if not len(at_b) or (within and wb < wa):
                continue
            width = min(wa, wb)
            rows_b = fold(np.frombuffer(b"".join(bits_b[i] for i in at_b), "<u8").reshape(len(at_b), wb), width)
            left = fold(rows_a, width)
            for k, i in enumerate(at_a):
                rest = slice(k + 1, None) if within and wa == wb else slice(None)
                others = at_b[rest]
                differ = np.bitwise_count(rows_b[rest] ^ left[k]).sum(1, dtype=np.int64)
                good = (7 * differ <= n_a[i] + n_b[others]) & _compatible(n_a[i], n_b[others])
                if good.any():
                    found_b.append(others[good])
                    found_a.append(np.full(good.sum(), i))
    return np.concatenate(found_a), np.concatenate(found_b)


def star_cover(i: np.ndarray, j: np.ndarray, count: int) -> np.ndarray:
    """Which pairs to keep: those of the best connected node, then of the best of the rest, ..."""
    keep, live = np.zeros(len(i), bool), np.ones(len(i), bool)
    star_of = np.arange(count)
    while live.any():
        degree = np.bincount(i[live], minlength=count) + np.bincount(j[live], minlength=count)
        best = int(degree.argmax())
        star = live & ((i == best) | (j == best))
        keep |= star
        reached = np.zeros(count, bool)
        reached[i[star]] = reached[j[star]] = True
        star_of[reached] = best
        live &= ~(reached[i] | reached[j])
    # A few pairs between each two stars, so that stars that belong together meet.
    low, high = np.minimum(star_of[i], star_of[j]), np.maximum(star_of[i], star_of[j])
    apart = np.flatnonzero(low != high)
    key = low[apart].astype(np.int64) * count + high[apart]
    order = np.argsort(key, kind="stable")
    begins = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(order) else order
    place = np.arange(len(order)) - np.repeat(begins, np.diff(np.r_[begins, len(order)]))
    keep[apart[order[place < BRIDGES]]] = True
    return keep


TILE_PAIRS = "a long, b long, shingle long, i int, j int"


def _tiled(cover: bool) -> Callable[[Batches], Batches]:
    """Rows ordered by tile pair to passing pairs between different clusters.

    ``cover``: a star cover and the tile pair's name if more than four a node pass.
    """

    def solve(key: tuple[int, int, int], rows: list[tuple]) -> Batches:
        side = np.array([r[0] for r in rows])
        node = np.array([r[1] for r in rows], np.int64)
        n = np.array([r[2] for r in rows], np.int64)
        bits = [r[3] for r in rows]
        cluster = np.array([r[4] for r in rows], np.int64)
        if (cluster == cluster[0]).all():
            return
        if key[1] == key[2]:
            i, j = passing(bits, n, None, None)
        else:
            a, b = np.flatnonzero(side == key[1]), np.flatnonzero(side == key[2])
            i, j = passing([bits[k] for k in a], n[a], [bits[k] for k in b], n[b])
            i, j = a[i], b[j]
        apart = cluster[i] != cluster[j]
        i, j = i[apart], j[apart]
        dense = cover and len(i) > 4 * len(node)
        if dense:
            kept = star_cover(i, j, len(node))
            i, j = i[kept], j[kept]
        low, high = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        more = 1 if dense else 0
        none = [None] * len(low)
        columns = [
            pa.array([*low, *[None] * more], pa.int64()),
            pa.array([*high, *[None] * more], pa.int64()),
            pa.array([*none, *[key[0]] * more], pa.int64()),
            pa.array([*none, *[key[1]] * more], pa.int32()),
            pa.array([*none, *[key[2]] * more], pa.int32()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["a", "b", "shingle", "i", "j"])

    def run(batches: Batches) -> Batches:
        key, rows = None, []
        for batch in batches:
            names = ("shingle", "i", "j", "tile", "node", "n", "bits", "cluster")
            for row in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if row[:3] != key:
                    if rows:
                        yield from solve(key, rows)
                    key, rows = row[:3], []
                rows.append(row[3:])
        if rows:
            yield from solve(key, rows)

    return run


def _tile_pairs(tiles: DataFrame) -> DataFrame:
    """(shingle, i, j) of the tiles whose size bands are compatible, i <= j."""
    bands = tiles.groupBy("shingle", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    left = bands.select("shingle", F.col("tile").alias("i"), F.col("high").alias("high_i"))
    right = bands.select("shingle", F.col("tile").alias("j"), F.col("low").alias("low_j"))
    return left.join(right, "shingle").where("i <= j and 100 * high_i >= 75 * low_j").select("shingle", "i", "j")


def _mixed(tiles: DataFrame, meetings: DataFrame, clusters: DataFrame) -> DataFrame:
    """The tile pairs that hold nodes of more than one cluster; a node in no cluster (node, cluster) is its own."""
    named = tiles.join(clusters, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    ranges = named.groupBy("shingle", "tile").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"))
    ranges = stage(ranges, "tile-clusters")
    out = meetings
    for end in ("i", "j"):
        one = ranges.select("shingle", F.col("tile").alias(end), F.col("low").alias(f"low_{end}"), F.col("high").alias(f"high_{end}"))
        out = out.join(one, ["shingle", end])
    return out.where("least(low_i, low_j) < greatest(high_i, high_j)").select("shingle", "i", "j")


def _meet(tiles: DataFrame, meetings: DataFrame, nodes: DataFrame, cover: bool) -> DataFrame:
    """Bring the rows of each tile pair together and find the passing pairs; ``nodes``: node, bits, cluster."""
    ends = meetings.select("shingle", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"))
    rows = tiles.join(ends, ["shingle", "tile"]).join(nodes, "node")
    rows = rows.select("shingle", "i", "j", "tile", "node", "n", "bits", "cluster")
    dealt = rows.repartition(partitions(tiles), "shingle", "i", "j").sortWithinPartitions("shingle", "i", "j", "n", "node")
    return dealt.mapInArrow(_tiled(cover), TILE_PAIRS)


# --- checks ---------------------------------------------------------------------------------


def _bounded(batches: Batches) -> Batches:
    """Pairs with both bitmaps to those within the bound."""
    for batch in batches:
        keep = []
        columns = [batch.column(c).to_pylist() for c in ("bits_a", "bits_b", "n_a", "n_b")]
        for x, y, n, m in zip(*columns, strict=True):
            a, b = np.frombuffer(x, "<u8")[None], np.frombuffer(y, "<u8")[None]
            width = min(a.shape[1], b.shape[1])
            keep.append(7 * int(np.bitwise_count(fold(a, width) ^ fold(b, width)).sum()) <= n + m)
        rows = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        if rows.num_rows:
            yield rows


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _checked(batches: Batches) -> Batches:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("set_a", "set_b")]
        keep = [linked(np.frombuffer(x, U64), np.frombuffer(y, U64)) for x, y in zip(*columns, strict=True)]
        rows = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        if rows.num_rows:
            yield rows


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that link, by exact intersection."""
    sets = sets.groupBy("node").agg(F.first("shingles").alias("shingles"))
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b")
    return stage(rows.mapInArrow(_checked, "a long, b long"), "checked")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row, with the hash of its text as ``code``."""
    return membership(*node_links(docs, key, text))


def thin(docs: DataFrame) -> DataFrame:
    """One document of each component stays, that with the smallest id; rows count by id and text.

    Where a component has ids at all, its rows without an id go. Rows that repeat the smallest id stay.
    """
    going = join(docs).where("component_id is not null and not (doc_id <=> component_id)")
    going = stage(going.select(F.col("doc_id").alias("id_"), F.col("code").alias("code_")).distinct(), "near-copies")
    own = free_name(docs, "own_")
    coded = docs.withColumn(own, F.xxhash64("text"))
    same = (coded[own] == going["code_"]) & coded["doc_id"].eqNullSafe(going["id_"])
    return coded.join(going, same, "left_anti").select(docs.columns)


def node_links(
    docs: DataFrame, key: str = "doc_id", text: str = "text", small: int = SMALL, tile: int = TILE
) -> tuple[DataFrame, DataFrame]:
    """(rows with doc_id, code, n and node; links (a, b) between nodes that span all components)."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("code"))
    described = stage(narrow.mapInArrow(_describe, NODES), "described")
    common = spark.sparkContext.broadcast(_common_slots(described))
    rows = described.where("block is null").select("doc_id", "code", "n", "node")
    bitmaps = described.where("bits is not null").groupBy("node").agg(F.first("bits").alias("bits"), F.first("n").alias("n"))

    prefixes = narrow.mapInArrow(_prefixes(common), PREFIXES)
    dealt = prefixes.repartition(partitions(docs), "shingle").sortWithinPartitions("shingle", "n", "node")
    grouped = stage(dealt.mapInArrow(_grouped(small, tile), GROUPS), "grouped")

    pairs = grouped.where("a is not null").select("a", "b").distinct()
    first = bitmaps.select(F.col("node").alias("a"), F.col("bits").alias("bits_a"), F.col("n").alias("n_a"))
    second = bitmaps.select(F.col("node").alias("b"), F.col("bits").alias("bits_b"), F.col("n").alias("n_b"))
    pairs = pairs.join(first, "a").join(second, "b").select("a", "b", "bits_a", "bits_b", "n_a", "n_b")
    pairs = pairs.mapInArrow(_bounded, "a long, b long")

    tiles = grouped.where("node is not null").select("shingle", "tile", "node", "n")
    meetings = stage(_tile_pairs(tiles), "meetings")
    apart = bitmaps.select("node", "bits", F.col("node").alias("cluster"))
    met = stage(_meet(tiles, meetings.where("j - i <= 1"), apart, cover=True), "met")
    pairs = stage(pairs.union(met.where("a is not null").select("a", "b")).distinct(), "pairs")

    sets = _sets(narrow, _ends(pairs))
    links = _links(pairs, sets)

    dense = met.where("shingle is not null").select("shingle", "i", "j")
    for cover in (True, False):
        open_pairs = meetings.where("j - i > 1") if cover else dense  # the last round takes what both before it covered
        if open_pairs.isEmpty():
            continue
        clusters = components(links, "a", "b").withColumnRenamed("component", "cluster")
        mixed = stage(_mixed(tiles, open_pairs, clusters), "mixed")
        if mixed.isEmpty():
            continue
        known = bitmaps.select("node", "bits").join(clusters, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
        more = stage(_meet(tiles, mixed, known, cover), "met-again")
        if cover:
            dense = dense.union(more.where("shingle is not null").select("shingle", "i", "j"))
        found = more.where("a is not null").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
        found = stage(found, "more-pairs")
        if cover:  # tile pairs of the last round gave a cover of all their nodes before
            sets = sets.union(_sets(narrow, _ends(found).join(sets, "node", "left_anti")))
        pairs, links = pairs.union(found), links.union(_links(found, sets))
    return rows, links


def membership(rows: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id of the component."""
    groups = components(links, "a", "b")
    smallest = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
    named = stage(smallest.join(groups, "node", "left").select("node", "low", "copies", F.coalesce("component", "node").alias("component")), "named")
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"), F.sum("copies").alias("members")).where("members > 1")
    known = stage(named.join(lows, "component").select("node", "component_id"), "known")
    out = salted_lookup(rows, known, "node", ["doc_id"])
    component = F.coalesce("component_id", "doc_id").alias("component_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component, "code")
