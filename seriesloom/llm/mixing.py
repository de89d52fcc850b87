"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its words, A-Z in lower case, and one end. A word is coded in two steps:

* its head, the first HEAD bytes (or the whole of a shorter word), by how many tokens begin so;
* each byte after that, and the word's end, as binary decisions along a Huffman code of the bytes of the
  training words. Predictors with contexts of one to four bytes, hashed into tables of fixed size that count word types, and two with the whole
  word so far, which count the tokens of all texts and of one class of texts, give a probability each.
  Their logits are added with weights that a gate chooses by how much the longer contexts have seen,
  and the result is refined by what came true at that probability before (both learnt online, over all
  words, each token being predicted from the others: its own count is taken off first).

A word's price from its spelling is then mixed with how often it followed the word before it: the
counts of all word pairs of the corpus, START and END of a text being words too, divided by the count of
the first. How much the pairs are believed depends on how often the first word was seen; these weights
are fitted on the pairs of all training texts, each pair without its own count.

Classes of texts, such as languages, are CLASSES clusters by short words: centres that start where the vectors of all
training texts differ most and move to the means of all that is nearest. A text's probability is the sum over the classes of
the class's share times the text's probability there.

The weights are those of a bucket of heads, so all that a bucket needs is the words of the corpus that
begin with its heads. How many buckets there are depends on the bytes of the corpus alone. Words that begin alike share
their decisions, which are learnt and priced once for all of them, with all their tokens; long words are gone through
in pieces of PIECE bytes at once, each after all that came before it in the word. Counts of words, heads and contexts cover all training texts and grow with them;
only the hashed tables have a fixed size. The probabilities of all words sum to at most 1.

Data flow: texts are cut into chunks that keep their distinct words and word pairs with counts; the words
and the hashed pairs go to buckets, where the counts of all chunks meet; the costs of a chunk's words and
the counts of its pairs return to the chunk, where they are added up for each text in its order of words.
A word or pair that fills the corpus travels once a chunk. Pairs are known by PAIR_BITS bits of a hash.

Defined results: NULL text is empty: one end, no words. Without training texts all counts are 0 and
the base is log10(1 / 1) a token. Repeated rows are scored alike; a NULL id counts as held in (its crc
is NULL, so it is neither remainder) and is learnt from.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.shared import KIND, done_with, partitions, stage, stage_kinds
from seriesloom.llm.words import Words, hash_spans, mix, words

CHUNK_BYTES = 10 << 20
SPREAD_BYTES = 16 << 20  # of the corpus, for the number of buckets and parts
CLASSES = 4
CLASS_BITS = 6  # hashed short words that tell classes apart
SHORT = 3  # bytes of a short word, at most
ROUNDS = 20  # in which the classes' centres move, at most
HEAD = 3
PIECE = 40  # bytes of a word that are gone through together
ORDERS = (1, 2, 3, 4)
TABLE_BITS = (16, 19, 20, 21)
END = 0x20  # ends a word; no word holds it
PRIOR = 0.4
RATE = 0.02
SLOW = 32.0
STEP_ROWS = 4096
PLACES = 49
LEAST = 2e-5
ESCAPE = 1.0  # tokens' worth of heads never seen
BACKING = 20.0  # tokens' worth of all texts in a class's heads
LIMIT = 12.0
PAIR_BITS = 48
BIT_UNIT = 256  # words' prices travel in this part of a bit
RATIO_STEPS = 4  # places of an octave in the tallies of ratios
RATIO_LEAST, RATIO_MOST = -200, 400  # the first stands for pairs not seen elsewhere
FITS = 200
U64, F32 = np.uint64, np.float32
Batches = Iterator[pa.RecordBatch]

COUNTED = (
    "chunk long, doc_id long, held boolean, tokens long, bytes long, bucket int, part int, size int, payload binary"
)
COUNTED_SCHEMA = pa.schema(
    [
        ("chunk", pa.int64()),
        ("doc_id", pa.int64()),
        ("held", pa.bool_()),
        ("tokens", pa.int64()),
        ("bytes", pa.int64()),
        ("bucket", pa.int32()),
        ("part", pa.int32()),
        ("size", pa.int32()),
        ("payload", pa.binary()),
    ]
)


_ZSTD = pa.Codec("zstd", 1)


def _pressed(data: bytes) -> bytes:
    """Compressed, the length in front."""
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def _restored(data: bytes | pa.Buffer) -> pa.Buffer:
    view = memoryview(data)
    return _ZSTD.decompress(view[8:], int.from_bytes(view[:8], "little"))


def _packed(*arrays: np.ndarray) -> bytes:
    head = np.array([a.nbytes for a in arrays], np.int64).tobytes()
    return _pressed(head + b"".join(a.tobytes() for a in arrays))


def _unpacked(data: bytes | pa.Buffer, *kinds: str) -> list[np.ndarray]:
    raw = _restored(data)
    at, out = 8 * len(kinds), []
    for kind, size in zip(kinds, np.frombuffer(raw, np.int64, len(kinds)), strict=True):
        out.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    return out


def _planes(a: np.ndarray) -> np.ndarray:
    """The bytes of numbers, all first bytes, then all second ones."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).ravel()


def _numbers(planes: np.ndarray, kind: str) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in order, where each comes first, and each hash's number among them.

    Numbers that hold a hash and its place are sorted: much faster than places by their hashes. Where both are too long
    for one number, the hash's last bits are left out; if these matter, places are sorted.
    """
    if not len(hashes):
        return hashes, np.zeros(0, np.int64), np.zeros(0, np.int64)
    above = hashes - hashes.min()
    places = len(hashes).bit_length()
    spare = max(0, int(above.max()).bit_length() + places - 64)
    keys = above >> U64(spare) << U64(places) | np.arange(len(hashes), dtype=U64)
    keys.sort()
    order = (keys & U64((1 << places) - 1)).astype(np.int64)
    ordered = hashes[order]
    if spare and (ordered[1:] < ordered[:-1]).any():
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    number = np.empty(len(hashes), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], order[new], number


# --- chunks ---------------------------------------------------------------------------------


class _Chunk:
    """Texts and their distinct words."""

    def __init__(self) -> None:
        self.docs: list[tuple] = []
        self.slices: list[tuple] = []
        self.bytes = 0

    def add(self, part: Words, ids: list, held: np.ndarray, centres: np.ndarray) -> None:
        """A slice of texts with their ids."""
        known, first, inverse = distinct(part.hashes)
        kind = class_of(short_words(part), centres)
        learnt = (~held[part.text]).astype(float)
        train = np.bincount(inverse * CLASSES + kind[part.text], learnt, len(known) * CLASSES).astype(np.uint32)
        lengths = (part.ends - part.starts)[first]
        spelt = _spans(part.data, part.starts[first], lengths)
        base = len(self.slices)
        edges, inverse = part.bounds(), inverse.astype(np.uint32)
        sizes = np.bincount(part.text, part.ends - part.starts + 1, part.count).astype(np.int64)
        for t in range(part.count):
            row = (ids[t], bool(held[t]), base, inverse[edges[t] : edges[t + 1]], int(sizes[t]), int(kind[t]))
            self.docs.append(row)
        self.slices.append((known, train, lengths.astype(np.uint32), spelt))
        self.bytes += len(part.data) + 64 * part.count

    def rows(self, chunk: int, buckets: int, parts: int) -> Batches:
        every = np.concatenate([s[0] for s in self.slices])
        known, first, inverse = distinct(every)
        slot = inverse[:, None] * CLASSES + np.arange(CLASSES)
        train = np.bincount(slot.ravel(), np.concatenate([s[1] for s in self.slices]), len(known) * CLASSES)
        train = train.astype(np.uint32).reshape(-1, CLASSES)
        lengths = np.concatenate([s[2] for s in self.slices]).astype(np.int64)
        data = np.concatenate([s[3] for s in self.slices])
        starts = np.cumsum(lengths) - lengths
        starts, lengths = starts[first], lengths[first]
        tokens = train.sum(1)
        seen = np.bincount(_spans(data, starts, lengths), np.repeat(tokens, lengths), 256)
        seen[END] += tokens.sum()
        yield pa.RecordBatch.from_pylist([{"chunk": chunk, "part": -2, "payload": _packed(seen)}], COUNTED_SCHEMA)
        bucket = bucket_of(data, starts, lengths, buckets)
        order = np.argsort(bucket, kind="stable")
        local = np.empty(len(order), np.uint32)
        local[order] = np.arange(len(order), dtype=np.uint32)
        names = known[order]
        maps = np.split(local[inverse], np.cumsum([len(s[0]) for s in self.slices])[:-1])
        seqs = [maps[base][at] for _, _, base, at, _, _ in self.docs]
        for i in range(0, len(self.docs), 2000):
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "chunk": chunk,
                        "doc_id": key,
                        "held": held,
                        "tokens": len(seq) + 1,
                        "bytes": size,
                        "size": kind,
                        "payload": _packed(_planes(seq)),
                    }
                    for (key, held, _, _, size, kind), seq in zip(self.docs[i : i + 2000], seqs[i : i + 2000], strict=True)
                ],
                COUNTED_SCHEMA,
            )
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out = []
        for b in np.flatnonzero(np.diff(edges)):
            at = order[edges[b] : edges[b + 1]]
            payload = _packed(train[at], lengths[at].astype(np.uint32), _spans(data, starts[at], lengths[at]))
            out.append({"chunk": chunk, "bucket": int(b), "size": int(edges[b]), "payload": payload})
        yield pa.RecordBatch.from_pylist(out, COUNTED_SCHEMA)
        yield from self._pair_rows(chunk, parts, names, seqs)

    def _pair_rows(self, chunk: int, parts: int, names: np.ndarray, seqs: list[np.ndarray]) -> Batches:
        """The hashes of the chunk's words, as part -1, and its pairs with training counts by ranges of hashes."""
        _, _, codes = pairs_of(names, seqs)
        learnt = np.repeat([not d[1] for d in self.docs], [len(q) + 1 for q in seqs])
        known, _, inverse = distinct(codes)
        train = np.bincount(inverse, learnt, len(known)).astype(np.uint32)
        bounds = [np.uint64((b << PAIR_BITS) // parts) for b in range(parts)]
        edges = np.append(np.searchsorted(known, np.array(bounds, U64)), len(known))
        out = [{"chunk": chunk, "part": -1, "size": 0, "payload": _packed(names)}]
        for b in np.flatnonzero(np.diff(edges)):
            at = slice(edges[b], edges[b + 1])
            payload = _packed(_planes(np.diff(known[at], prepend=U64(0))), _planes(train[at]))
            out.append({"chunk": chunk, "part": int(b), "size": int(edges[b]), "payload": payload})
        yield pa.RecordBatch.from_pylist(out, COUNTED_SCHEMA)


def pairs_of(names: np.ndarray, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of neighbours of texts, in order: the first, the second, and the pair's hash.

    Words are places in ``names``, their hashes; START and END are the two numbers after these.
    """
    start, end = len(names), len(names) + 1
    last = np.cumsum([len(q) + 1 for q in seqs], dtype=np.int64) - 1
    second = np.full(int(last[-1]) + 1 if len(last) else 0, end, np.int64)
    word = np.ones(len(second), bool)
    word[last] = False
    second[word] = np.concatenate(seqs) if seqs else 0
    first = np.r_[start, second[:-1]] if len(second) else second
    first[last[:-1] + 1] = start
    every = np.r_[names, mix(np.array([1, 2], U64))]
    return first, second, mix(every[first] * U64(0x9E3779B97F4A7C15) + every[second]) >> U64(64 - PAIR_BITS)


def _spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of spans, one after the other."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    if not len(ends):
        return data[:0]
    return data[np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)]


def _heads(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first HEAD bytes of each word as a number; a shorter word's end counts as a byte."""
    padded, out = np.r_[data, np.full(HEAD, END, np.uint8)], np.zeros(len(starts), np.int64)
    for k in range(HEAD):
        out = out << 8 | np.where(k < lengths, padded[starts + k], END)
    return out


def bucket_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(_heads(data, starts, lengths).astype(U64)) % U64(buckets)).astype(np.int64)


def short_words(part: Words) -> np.ndarray:
    """How often each text has the hashed short words, as shares, square roots of them."""
    short = (part.ends - part.starts) <= SHORT
    slot = part.text[short] * (1 << CLASS_BITS) + (part.hashes[short] >> U64(64 - CLASS_BITS)).astype(np.int64)
    counts = np.bincount(slot, minlength=part.count << CLASS_BITS).reshape(part.count, -1)
    return np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))


def class_of(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1)


VECTOR_UNIT = 255  # places of a text's vector travel as bytes; sums of whole numbers are the same in any order


def _vectors(batches: Batches) -> Batches:
    """The short-word vectors of texts."""
    for batch in batches:
        rows = [v.tobytes() for part in words(batch.column("text")) for v in np.rint(short_words(part) * VECTOR_UNIT).astype(np.uint8)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["vector"])


SUMS = "kind long, dim long, total long"


def _summed_vectors(sums_of: Callable[[np.ndarray], np.ndarray]) -> Callable[[Batches], Batches]:
    """The task's sums of a table of whole numbers that ``sums_of`` makes of vectors, with a 1 in front of each."""

    def run(batches: Batches) -> Batches:
        sums = 0
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            sums = sums + sums_of(np.column_stack([np.ones(len(x)), x])).astype(np.int64)
        if np.ndim(sums):
            kind, dim = np.divmod(np.arange(sums.size), sums.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(dim), pa.array(sums.ravel())], ["kind", "dim", "total"])

    return run


def _sums(vectors: DataFrame, sums_of: Callable[[np.ndarray], np.ndarray], rows: int) -> np.ndarray:
    out = np.zeros((rows, (1 << CLASS_BITS) + 1))
    dealt = vectors.mapInArrow(_summed_vectors(sums_of), SUMS).groupBy("kind", "dim").agg(F.sum("total").alias("total"))
    for row in dealt.collect():  # ``rows`` times the places of a vector
        out[row["kind"], row["dim"]] = row["total"]
    return out


def _products(x: np.ndarray) -> np.ndarray:
    return x.T @ x


def _by_class(centres: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The sums of the vectors nearest to each centre, their number in front."""

    def run(x: np.ndarray) -> np.ndarray:
        return np.eye(CLASSES)[class_of(x[:, 1:], centres)].T @ x

    return run


def spread_centres(products: np.ndarray) -> np.ndarray:
    """CLASSES points around the mean, along the directions in which the vectors differ most."""
    count = max(products[0, 0], 1.0)
    mean = products[0, 1:] / count
    size, way = np.linalg.eigh(products[1:, 1:] / count - np.outer(mean, mean))
    way = way[:, ::-1][:, : CLASSES - 1] * np.sqrt(np.maximum(size[::-1][: CLASSES - 1], 0))
    corners = np.eye(CLASSES) - 1 / CLASSES  # of a body whose corners are equally far apart
    return mean + corners @ np.linalg.svd(corners)[2][: CLASSES - 1].T @ way.T * CLASSES**0.5


def centres_of(docs: DataFrame) -> np.ndarray:
    """Class centres: means of what is nearest to them, over all texts in every round."""
    vectors = stage(docs.select("text").mapInArrow(_vectors, "vector binary"), "vectors")
    centres = spread_centres(_sums(vectors, _products, (1 << CLASS_BITS) + 1))
    for _ in range(ROUNDS):
        sums = _sums(vectors, _by_class(centres), CLASSES)
        moved = np.where(sums[:, :1] > 0, sums[:, 1:] / np.maximum(sums[:, :1], 1), centres)
        if (moved == centres).all():
            break
        centres = moved
    return centres / VECTOR_UNIT


def _chunked(buckets: int, parts: int, centres: np.ndarray) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        from pyspark import TaskContext

        task = TaskContext.get()
        number, chunk = (task.partitionId() if task else 0) << 32, _Chunk()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            for part in words(batch.column("text")):
                span = slice(part.first, part.first + part.count)
                chunk.add(part, ids[span], held[span], centres)
                if chunk.bytes >= CHUNK_BYTES:
                    yield from chunk.rows(number, buckets, parts)
                    number, chunk = number + 1, _Chunk()
        if chunk.docs:
            yield from chunk.rows(number, buckets, parts)

    return run


def _bytes_seen(rows: DataFrame) -> np.ndarray:
    """How often the chunks' training tokens have each byte."""

    def run(batches: Batches) -> Batches:
        sums = np.zeros(256)
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                sums += _unpacked(payload, "f8")[0]
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(sums)], ["byte", "seen"])

    out = np.zeros(256)
    for row in rows.select("payload").mapInArrow(run, "byte int, seen double").groupBy("byte").agg(F.sum("seen")).collect():  # 256 rows
        out[row[0]] = row[1]
    return out


# --- buckets --------------------------------------------------------------------------------


class Code:
    """A Huffman code of the bytes by how often training words have them: where each byte stands in the order of the
    codes, and by that place the codes' lengths, bits, and the nodes of the tree that the bits leave."""

    def __init__(self, seen: np.ndarray) -> None:
        least = int(seen.sum()) // 4096 + 1  # keeps the rarest codes short
        heap = [(int(n) + least, b, (b,)) for b, n in enumerate(seen)]
        heapq.heapify(heap)
        length = np.zeros(256, np.int64)
        for step in range(255):
            (n, _, one), (m, _, two) = heapq.heappop(heap), heapq.heappop(heap)
            length[[*one, *two]] += 1
            heapq.heappush(heap, (n + m, 256 + step, one + two))
        order = np.argsort(length, kind="stable")
        self.rank = np.empty(256, np.int64)
        self.rank[order] = np.arange(256)
        self.length = length[order]
        shape = (256, int(length.max()))
        self.bit, self.node = np.zeros(shape, np.float32), np.zeros(shape, np.int64)
        nodes: dict[tuple[int, int], int] = {}
        word = 0
        for place, size in enumerate(self.length.tolist()):
            if place:
                word = (word + 1) << (size - int(self.length[place - 1]))
            for depth in range(size):
                self.bit[place, depth] = word >> (size - depth - 1) & 1
                self.node[place, depth] = nodes.setdefault((depth, word >> (size - depth)), len(nodes))


class Bucket:
    """All words of a bucket with their training counts, and the pieces of PIECE bytes of what follows their heads."""

    def __init__(self, rows: list[tuple[int, int, bytes]], code: Code | None = None) -> None:
        self.code = code or Code(np.zeros(256))
        parts, hashes, self.chunks = [], [], []
        for chunk, size, payload in rows:
            counts, lengths, data = _unpacked(payload, "u4", "u4", "u1")
            ends = np.cumsum(lengths, dtype=np.int64)
            hashes.append(hash_spans(data, ends - lengths, ends))
            parts.append((counts, lengths, data))
            self.chunks.append((chunk, size, len(lengths)))
        counts, lengths, data = (np.concatenate(c) for c in zip(*parts, strict=True))
        lengths = lengths.astype(np.int64)
        _, first, self.inverse = distinct(np.concatenate(hashes))
        slot = self.inverse[:, None] * CLASSES + np.arange(CLASSES)
        self.by_class = np.bincount(slot.ravel(), counts, len(first) * CLASSES).astype(np.int64).reshape(-1, CLASSES)
        self.counts = self.by_class.sum(1)
        self.data, self.lengths = _spans(data, (np.cumsum(lengths) - lengths)[first], lengths[first]), lengths[first]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.heads = _heads(self.data, self.starts, self.lengths)

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each piece its word, where it begins, how many bytes of the word are left there, and a number for what came before."""
        word = np.flatnonzero(self.lengths >= HEAD)
        many = (self.lengths[word] - HEAD) // PIECE + 1
        of = np.repeat(word, many)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        begin, before = HEAD + PIECE * nth, self.heads[of].astype(U64)
        later = np.flatnonzero(nth)
        if len(later):
            long = np.flatnonzero(self.lengths >= HEAD + PIECE)
            data, lengths = _spans(self.data, self.starts[long], self.lengths[long]), self.lengths[long]
            at = (np.cumsum(lengths) - lengths)[np.searchsorted(long, of[later])]
            before[later] = hash_spans(data, at, at + begin[later])
        return of, self.starts[of] + begin, self.lengths[of] - begin, np.unique(before, return_inverse=True)[1]


class Level(NamedTuple):
    """The next byte of all pieces, an edge for each byte that follows what came before."""

    group: np.ndarray  # by edge: what came before, an edge of the last level or a first number
    rank: np.ndarray  # by edge: the byte's place in the code
    tokens: np.ndarray  # by edge and class
    alone: np.ndarray  # by edge: words with one token
    types: np.ndarray  # by edge: words with tokens
    contexts: list[np.ndarray]  # by edge, for each of ORDERS
    words: np.ndarray  # of the pieces that end here
    edges: np.ndarray  # their edges


def _levels(bucket: Bucket) -> Iterator[Level]:
    of, place, left, group = bucket.pieces()
    padded = np.r_[bucket.data, np.uint8(END)]
    by_class, alone, types = bucket.by_class.astype(np.float32), bucket.counts == 1, bucket.counts > 0
    for k in range(PIECE):
        if not len(of):
            return
        rank = bucket.code.rank[np.where(left > 0, padded[place], END)]
        order = np.argsort(group << 8 | rank, kind="stable")
        of, place, left, group, rank = of[order], place[order], left[order], group[order], rank[order]
        fork = np.r_[True, (group[1:] != group[:-1]) | (rank[1:] != rank[:-1])]
        at, edge = np.flatnonzero(fork), np.cumsum(fork) - 1
        context, contexts = np.zeros(len(at), U64), []
        for n in range(1, ORDERS[-1] + 1):
            back = place[at] - n
            byte = np.where(back >= bucket.starts[of[at]], padded[back], END).astype(U64)
            context = context | byte << U64(8 * (n - 1))
            contexts.append(context | U64(n) << U64(32))
        sums = [np.add.reduceat(v[of], at, axis=0, dtype=np.float32) for v in (by_class, alone, types)]
        going = (left > 0) & (k < PIECE - 1)
        yield Level(group[at], rank[at], *sums, contexts, of[~going], edge[~going])
        of, place, left, group = of[going], place[going] + 1, left[going] - 1, edge[going]


class Fork(NamedTuple):
    """A binary decision wherever words of a level differ or may differ: nodes, and the ways that words take from them."""

    depth: int
    edges: np.ndarray  # that come through
    ways: np.ndarray  # where each way begins among these
    bit: np.ndarray  # by way
    node: np.ndarray  # by way
    nodes: np.ndarray  # where each node begins among the ways
    slots: list[np.ndarray]  # by node: places in the tables


def _forks(level: Level, code: Code) -> Iterator[Fork]:
    live = np.arange(len(level.rank))
    for depth in range(code.node.shape[1]):
        live = live[code.length[level.rank[live]] > depth]
        if not len(live):
            return
        rank, group = level.rank[live], level.group[live]
        number, bit = code.node[rank, depth], code.bit[rank, depth]
        new = np.r_[True, (group[1:] != group[:-1]) | (number[1:] != number[:-1])]
        ways = np.flatnonzero(new | np.r_[True, bit[1:] != bit[:-1]])
        node, nodes = np.cumsum(new)[ways] - 1, np.flatnonzero(new[ways])
        at, number = live[ways[nodes]], number[ways[nodes]].astype(U64)
        slots = [
            2 * (mix(context[at] << U64(9) | number) >> U64(64 - bits)).astype(np.int64)
            for context, bits in zip(level.contexts, TABLE_BITS, strict=True)
        ]
        yield Fork(depth, live, ways, bit[ways], node, nodes, slots)


def _add_types(bucket: Bucket, tables: list[np.ndarray]) -> None:
    """Count word types by context slot and bit."""
    for level in _levels(bucket):
        for fork in _forks(level, bucket.code):
            types = np.add.reduceat(level.types[fork.edges], fork.ways).astype(np.uint32)
            for slots, table in zip(fork.slots, tables, strict=True):
                np.add.at(table, slots[fork.node] + fork.bit.astype(np.int64), types)


def _buckets(batches: Batches, code: Code) -> Iterator[tuple[int, Bucket]]:
    """Word rows ordered by bucket, as buckets."""
    at, rows = None, []
    for batch in batches:
        for b, *row in zip(*[batch.column(c).to_pylist() for c in ("bucket", "chunk", "size", "payload")], strict=True):
            if b != at and rows:
                yield at, Bucket(rows, code)
                rows = []
            at = b
            rows.append(tuple(row))
    if rows:
        yield at, Bucket(rows, code)


BLOCK = 1 << 16  # numbers of the tables in a row
TALLIES = "part int, counts binary, seen array<long>, kinds long"


def _tally(code: Code) -> Callable[[Batches], Batches]:
    """The task's context tables in blocks, and its tokens and word types."""

    def run(batches: Batches) -> Batches:
        sums, seen, kinds = [np.zeros(2 << b, np.uint32) for b in TABLE_BITS], np.zeros(CLASSES, np.int64), 0
        for _, bucket in _buckets(batches, code):
            _add_types(bucket, sums)
            seen, kinds = seen + bucket.by_class.sum(0), kinds + int((bucket.counts > 0).sum())
        every = np.concatenate(sums)
        for k in range(len(every) // BLOCK):
            block = every[k * BLOCK : (k + 1) * BLOCK]
            if block.any():
                yield pa.RecordBatch.from_pydict(_tally_row(k, _pressed(block.tobytes()), None, 0), _TALLY_SCHEMA)
        yield pa.RecordBatch.from_pydict(_tally_row(-1, b"", seen.tolist(), kinds), _TALLY_SCHEMA)

    return run


_TALLY_SCHEMA = pa.schema([("part", pa.int32()), ("counts", pa.binary()), ("seen", pa.list_(pa.int64())), ("kinds", pa.int64())])


def _tally_row(part: int, counts: bytes, seen: list[int] | None, kinds: int) -> dict:
    return {"part": [part], "counts": [counts], "seen": [seen], "kinds": [kinds]}


def _summed(batches: Batches) -> Batches:
    """Blocks ordered by part, to their sums."""
    at, total = None, np.zeros(BLOCK, np.uint32)
    for batch in batches:
        for part, data in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            if part != at:
                if at is not None:
                    yield pa.RecordBatch.from_pydict(_tally_row(at, _pressed(total.tobytes()), None, 0), _TALLY_SCHEMA)
                at, total = part, np.zeros(BLOCK, np.uint32)
            total += np.frombuffer(_restored(data), np.uint32)
    if at is not None:
        yield pa.RecordBatch.from_pydict(_tally_row(at, _pressed(total.tobytes()), None, 0), _TALLY_SCHEMA)


class Mixer:
    """Gated logistic mixing, refined by what came true at each probability.

    Inputs: the word so far in the class, in all texts, the ORDERS, and a constant. The gate is how
    much the first two have seen.
    """

    def __init__(self) -> None:
        trust = np.array([0.0, 0.3, 0.45, 0.6, 0.7, 0.8, 0.9, 0.95])
        first = np.repeat(trust, 8)
        second = (1 - first) * np.tile(trust, 8)
        rest = (1 - first - second)[:, None] * np.array([0.1, 0.15, 0.25, 0.5])
        self.weights = np.column_stack([first, second, rest, np.zeros(64)]).astype(np.float32)
        spread = 1 / (1 + np.exp(-np.linspace(-LIMIT, LIMIT, PLACES)))
        self.truth = np.tile(np.stack([spread, np.ones(PLACES)], 1) * 20, (8, 1, 1))

    def __call__(self, x: np.ndarray, gate: np.ndarray, depth: int) -> np.ndarray:
        """Refined probabilities of a 1."""
        p, place = self._mixed(x, gate)
        table = self.truth[min(depth, 7)]
        refined = 0.5 * p + 0.5 * (table[:, 0] / table[:, 1])[place]
        return np.clip(refined, LEAST, 1 - LEAST)

    def _mixed(self, x: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mixed probabilities of a 1, and their places in the refining table."""
        logit = np.clip(np.einsum("ij,ij->i", x, self.weights[gate]), -LIMIT, LIMIT)
        p = 1 / (1 + np.exp(-logit))
        return p, np.rint((logit + LIMIT) * ((PLACES - 1) / (2 * LIMIT))).astype(int)

    def learn(self, x: np.ndarray, gate: np.ndarray, depth: int, bit: np.ndarray, weight: np.ndarray) -> None:
        p, place = self._mixed(x, gate)
        error = (bit - p) * weight
        norm = np.bincount(gate, weight, 64) + SLOW
        for k in range(x.shape[1]):
            self.weights[:, k] += RATE * np.bincount(gate, error * x[:, k], 64) / norm
        np.clip(self.weights, -1, 3, out=self.weights)
        self.truth[min(depth, 7)][:, 0] += np.bincount(place, weight * bit, PLACES)
        self.truth[min(depth, 7)][:, 1] += np.bincount(place, weight, PLACES)


def _level(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(n + 1)[1] - 1, 7)


def _inputs(
    mine: np.ndarray, my_both: np.ndarray, ones: np.ndarray, both: np.ndarray, orders: list[np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """The mixer's inputs and gate, from counts of ones and of both bits."""
    x = np.empty((len(mine), len(orders) + 3), np.float32)
    for k, (one, all_) in enumerate(((mine, my_both), (ones, both))):
        np.log((one + F32(PRIOR / 8)) / (all_ - one + F32(PRIOR / 8)), out=x[:, k])
    np.clip(x[:, :2], -LIMIT, LIMIT, out=x[:, :2])
    for k, logit in enumerate(orders):
        x[:, k + 2] = logit
    x[:, -1] = 0.3
    return x, _level(my_both) * 8 + _level(both)


def _head_bits(bucket: Bucket, totals: np.ndarray) -> np.ndarray:
    """Bits of the heads, by word and class."""
    heads, of = np.unique(bucket.heads, return_inverse=True)
    begun = np.zeros((len(heads), CLASSES))
    np.add.at(begun, of, bucket.by_class)
    every = (begun.sum(1, keepdims=True) + ESCAPE * 257.0**-HEAD) / (totals.sum() + ESCAPE)
    p = (begun + BACKING * every) / (totals + BACKING)
    return -np.log2(p)[of]


def costs(bucket: Bucket, tables: list[np.ndarray], totals: np.ndarray) -> np.ndarray:
    """Bits of every word of a bucket in each class; ``totals``: training tokens with ends by class."""
    mixer = Mixer()
    for level in _levels(bucket):
        for fork in _forks(level, bucket.code):
            _learn(mixer, level, fork, tables)
    bits, so_far = _head_bits(bucket, totals), None
    for level in _levels(bucket):
        here = np.zeros((len(level.rank), CLASSES)) if so_far is None else so_far[level.group]
        for fork in _forks(level, bucket.code):
            p = _prices(mixer, level, fork, tables)[fork.node]
            sizes = np.diff(np.r_[fork.ways, len(fork.edges)])
            here[fork.edges] -= np.repeat(np.log2(np.where(fork.bit[:, None] == 1, p, 1 - p)), sizes, axis=0)
        np.add.at(bits, level.words, here[level.edges])
        so_far = here
    return bits


def _counts(level: Level, fork: Fork) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens by way and class; those of ones, and all, by node and class, all classes together in the last column."""
    mine = np.add.reduceat(level.tokens[fork.edges], fork.ways, axis=0)
    mine = np.column_stack([mine, mine.sum(1)])
    ones = np.add.reduceat(mine * fork.bit[:, None], fork.nodes, axis=0)
    return mine[:, :-1], ones, np.add.reduceat(mine, fork.nodes, axis=0)


def _of_class(counts: np.ndarray, node: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of nodes in a class each, and in all classes."""
    row = node * counts.shape[1]
    return counts.ravel().take(row + kind), counts.ravel().take(row + CLASSES)


def _learn(mixer: Mixer, level: Level, fork: Fork, tables: list[np.ndarray]) -> None:
    """Every token of a way is predicted from all others; a way's tokens weigh as the root of their number."""
    mine, ones, both = _counts(level, fork)
    way, kind = np.nonzero(mine)
    if not len(way):
        return
    # A token that is its word's only one takes the word's type with it.
    tokens = np.maximum(1, mine.sum(1))
    gone = np.add.reduceat(level.alone[fork.edges], fork.ways) / tokens
    orders = []
    for table, slots in zip(tables, fork.slots, strict=True):
        a, b = table[slots + 1][fork.node] - gone * fork.bit, table[slots][fork.node] - gone * (1 - fork.bit)
        orders.append(np.log((a + F32(PRIOR)) / (b + F32(PRIOR)))[way])
    node, bit = fork.node[way], fork.bit[way]
    my_ones, every_one = _of_class(ones, node, kind)
    my_both, every = _of_class(both, node, kind)
    x, gate = _inputs(my_ones - bit, my_both - 1, every_one - bit, every - 1, orders)
    weight = mine[way, kind]
    for i in range(0, len(way), STEP_ROWS):
        j = slice(i, i + STEP_ROWS)
        mixer.learn(x[j], gate[j], fork.depth, bit[j], weight[j])


def _prices(mixer: Mixer, level: Level, fork: Fork, tables: list[np.ndarray]) -> np.ndarray:
    """Probabilities of a 1 by node and class; where a class has seen nothing, those without classes."""
    _, ones, both = _counts(level, fork)
    orders = [np.log((t[s + 1] + F32(PRIOR)) / (t[s] + F32(PRIOR))) for t, s in zip(tables, fork.slots, strict=True)]
    nothing = np.zeros(len(ones), np.float32)
    x, gate = _inputs(nothing, nothing, ones[:, -1], both[:, -1], orders)
    p = np.repeat(mixer(x, gate, fork.depth)[:, None], CLASSES, axis=1)
    node, kind = np.nonzero(both[:, :-1])
    if len(node):
        my_ones, every_one = _of_class(ones, node, kind)
        my_both, every = _of_class(both, node, kind)
        x, gate = _inputs(my_ones, my_both, every_one, every, [o[node] for o in orders])
        p[node, kind] = mixer(x, gate, fork.depth)
    return p


def _priced(tables: Broadcast, totals: np.ndarray, code: Code) -> Callable[[Batches], Batches]:
    """Buckets to rows of each chunk: size is the first word's number, payload counts and bits."""

    def run(batches: Batches) -> Batches:
        split = np.split(np.frombuffer(_restored(tables.value), np.uint32), np.cumsum([2 << b for b in TABLE_BITS])[:-1])
        split = [t.astype(np.float32) for t in split]
        for b, bucket in _buckets(batches, code):
            # Rounded up, so that the probabilities still sum to at most 1.
            bits, at, out = np.ceil(costs(bucket, split, totals) * BIT_UNIT).astype("<u8"), 0, []
            counts = bucket.counts.astype("<u8")
            for chunk, first, n in bucket.chunks:
                mine = bucket.inverse[at : at + n]
                at += n
                payload = _packed(_planes(counts[mine]), _planes(bits[mine].T.ravel()))
                out.append({"chunk": chunk, "bucket": b, "size": first, "payload": payload})
            yield pa.RecordBatch.from_pylist(out, COUNTED_SCHEMA)

    return run


def _paired(batches: Batches) -> Batches:
    """Pair rows ordered by part, to each chunk's pairs with the training counts of all chunks."""

    def met(rows: list[tuple]) -> pa.RecordBatch:
        parts = [_unpacked(payload, "u1", "u1") for _, _, _, payload in rows]
        codes = [np.cumsum(_numbers(p[0], "u8"), dtype=U64) for p in parts]
        _, _, inverse = distinct(np.concatenate(codes))
        sums = np.bincount(inverse, np.concatenate([_numbers(p[1], "u4") for p in parts])).astype(np.uint32)
        each = np.split(sums[inverse], np.cumsum([len(c) for c in codes])[:-1])
        out = [
            {"chunk": chunk, "part": part, "size": size, "payload": _packed(_planes(n))}
            for (part, chunk, size, _), n in zip(rows, each, strict=True)
        ]
        return pa.RecordBatch.from_pylist(out, COUNTED_SCHEMA)

    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("part", "chunk", "size", "payload")], strict=True):
            if rows and row[0] != rows[0][0]:
                yield met(rows)
                rows = []
            rows.append(row)
    if rows:
        yield met(rows)


class _Met:
    """A chunk's texts with the prices of their words and the counts of their pairs."""

    def __init__(self) -> None:
        self.words: list[tuple] = []
        self.pairs: list[tuple] = []
        self.names = np.zeros(0, U64)
        self.texts: list[tuple] = []
        self.seqs: list[np.ndarray] = []

    def take(self, bucket: int | None, part: int | None, size: int, payload: bytes, text: tuple) -> None:
        if bucket is not None:
            counts, bits = _unpacked(payload, "u1", "u1")
            bits = (_numbers(bits, "u8").reshape(CLASSES, -1).T / BIT_UNIT).astype("f4")
            self.words.append((size, _numbers(counts, "i8"), bits))
        elif part is None:
            self.texts.append((*text, size))
            self.seqs.append(_numbers(_unpacked(payload, "u1")[0], "u4"))
        elif part < 0:
            self.names = _unpacked(payload, "u8")[0]
        else:
            self.pairs.append((size, _numbers(_unpacked(payload, "u1")[0], "u4")))

    def settle(self, ends: int, end_bits: np.ndarray) -> None:
        """Counts and bits by word, START and END after them; the pairs, with their counts and their number in each place."""
        for parts in (self.words, self.pairs):
            parts.sort(key=lambda p: p[0])
        self.counts = np.concatenate([*[p[1] for p in self.words], np.array([ends, ends], np.int64)])
        self.bits = np.concatenate([*[p[2] for p in self.words], np.zeros((1, CLASSES), "f4"), end_bits[None].astype("f4")])
        self.words.clear()
        first, place, codes = pairs_of(self.names, self.seqs)
        self.edges = np.r_[0, np.cumsum([len(q) + 1 for q in self.seqs])]
        self.seqs.clear()
        self.place = place.astype(np.int32)
        _, at, inverse = distinct(codes)
        self.inverse = inverse.astype(np.int32)
        self.first, self.second = first[at], place[at]
        del first, place, codes, at, inverse
        self.pair_counts = np.concatenate([p[1] for p in self.pairs]).astype(float)
        self.pairs.clear()


def _chunks_met[T](batches: Batches, ends: int, end_bits: np.ndarray, work: Callable[[_Met], T]) -> Iterator[T]:
    """Rows ordered by chunk, the texts last, to what ``work`` makes of each chunk; one chunk is held at a time."""
    number, chunk = None, _Met()
    names = ("chunk", "bucket", "part", "size", "doc_id", "held", "tokens", "bytes")
    for batch in batches:
        payloads = batch.column("payload")
        for k, (at, bucket, part, size, *text) in enumerate(zip(*[batch.column(c).to_pylist() for c in names], strict=True)):
            if at != number:
                if number is not None:
                    chunk.settle(ends, end_bits)
                    done = work(chunk)
                    del chunk
                    yield done
                number, chunk = at, _Met()
            chunk.take(bucket, part, size, payloads[k].as_buffer(), tuple(text))
    if number is not None:
        chunk.settle(ends, end_bits)
        yield work(chunk)


def _gate(seen: np.ndarray) -> np.ndarray:
    """How often the first word of a pair was seen, in octaves."""
    return np.frexp(seen.astype(float))[1].astype(np.int64)


GATES = 64
RATIOS = "gate int, ratio int, times double"


def _ratios(ends: int, end_bits: np.ndarray) -> Callable[[Batches], Batches]:
    """How much likelier the pairs of training texts are by the other pairs than by the word alone, tallied."""
    wide = RATIO_MOST - RATIO_LEAST + 1

    def tallied(met: _Met) -> np.ndarray:
        sizes = np.diff(met.edges)
        kind = np.repeat([t[-1] for t in met.texts], sizes)
        learnt = np.repeat([not t[1] for t in met.texts], sizes)
        # Pairs of a class are alike: tallied once, with how often they come.
        every = np.bincount(met.inverse[learnt] * CLASSES + kind[learnt])
        both = np.flatnonzero(every)
        pair, kind, times = both // CLASSES, both % CLASSES, every[both]
        others, seen = met.pair_counts[pair] - 1, met.counts[met.first[pair]]
        ratio = np.full(len(pair), RATIO_LEAST)
        some = (others > 0) & (seen > 1)
        log2 = np.log2(others[some] / (seen[some] - 1)) + met.bits[met.second[pair[some]], kind[some]]
        ratio[some] = np.clip(np.rint(log2 * RATIO_STEPS), RATIO_LEAST + 1, RATIO_MOST)
        return np.bincount(_gate(seen) * wide + ratio - RATIO_LEAST, times, GATES * wide)

    def run(batches: Batches) -> Batches:
        sums = np.zeros(GATES * wide)
        for one in _chunks_met(batches, ends, end_bits, tallied):
            sums += one
        at = np.flatnonzero(sums)
        rows = [pa.array(at // wide, pa.int32()), pa.array(at % wide + RATIO_LEAST, pa.int32()), pa.array(sums[at])]
        yield pa.RecordBatch.from_arrays(rows, ["gate", "ratio", "times"])

    return run


def trust_of(ratio: np.ndarray, times: np.ndarray) -> float:
    """The share of the pairs' counts in the mixture that makes the tallied pairs likeliest."""
    r = np.where(ratio == RATIO_LEAST, 0.0, 2.0 ** (ratio / RATIO_STEPS))
    share = 0.5
    for _ in range(FITS):
        share = float((times * share * r / (1 - share + share * r)).sum() / times.sum())
    return min(share, 0.999)


SCORES = "doc_id long, held_out boolean, n_tokens long, bytes long, n_known long, base double, bits array<double>"


def _added(trust: np.ndarray, ends: int, end_bits: np.ndarray) -> Callable[[Batches], Batches]:
    """A chunk's priced words, counted pairs and texts to the sums of each text."""

    def added(met: _Met) -> pa.RecordBatch:
        seen = met.counts[met.first]
        share = np.where(seen > 0, trust[_gate(seen)], 0.0)
        rest, some, starts = np.log2(1 - share), np.flatnonzero(met.pair_counts * share), met.edges[:-1]
        by_pair = np.log2(share[some] * met.pair_counts[some] / np.maximum(seen[some], 1))
        bits = np.empty((len(starts), CLASSES))
        for k in range(CLASSES):  # one at a time: a chunk's pairs are many
            log2_p = rest - np.ascontiguousarray(met.bits[:, k])[met.second]
            log2_p[some] = np.logaddexp2(log2_p[some], by_pair)
            bits[:, k] = np.add.reduceat((-log2_p)[met.inverse], starts)
        word = met.place <= len(met.names)
        known = np.add.reduceat(word & (met.counts[met.place] > 0), starts, dtype=np.int64)
        base = np.add.reduceat(np.where(word, np.log10(met.counts + 1.0)[met.place], 0.0), starts)
        key, held, tokens, length, _ = zip(*met.texts, strict=True)
        kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.float64(), pa.list_(pa.float64())]
        columns = [key, held, tokens, length, known.tolist(), base.tolist(), bits.tolist()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "bytes", "n_known", "base", "bits"])

    def run(batches: Batches) -> Batches:
        yield from _chunks_met(batches, ends, end_bits, added)

    return run


def spread_of(size: int) -> tuple[int, int]:
    """How many buckets of heads and parts of pairs for a corpus of ``size`` bytes.

    Both grow with the square root of the corpus's bytes: buckets and parts stay of bounded growth, and so does what a
    chunk sends to each of them.
    """
    factor = 1 << max(0, math.ceil(math.log2(max(1.0, size / SPREAD_BYTES)) / 2))
    return max(16, 8 * factor), 64 * factor


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries in here leave no shuffle files behind: what they make is written or collected."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def score(docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all ``docs``, learnt from those for which ``held`` is not true.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), bits_per_byte.
    """
    spark, width = docs.sparkSession, partitions(docs)
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    with _shuffles_removed(spark):
        buckets, parts = spread_of(narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
        centres = centres_of(narrow.where(~F.col("held")))
        kind = F.when(F.col("bucket").isNotNull(), "spelt").when(F.col("part").isNull(), "texts")
        kind = kind.when(F.col("part") >= 0, "pairs").when(F.col("part") == -1, "names").otherwise("bytes")
        counted, path = stage_kinds(narrow.mapInArrow(_chunked(buckets, parts, centres), COUNTED), "counted", kind)
        texts, spelt, names, pairs, seen = (counted.where(f"{KIND} = '{k}'") for k in ("texts", "spelt", "names", "pairs", "bytes"))
        code = Code(_bytes_seen(seen))
        dealt = spelt.select("bucket", "chunk", "size", "payload").repartition(max(width, buckets // 2), "bucket").sortWithinPartitions("bucket")

        tallies = stage(dealt.mapInArrow(_tally(code), TALLIES), "tallies")
        blocks = tallies.where("part >= 0").repartition(width, "part").sortWithinPartitions("part")
        tables = np.zeros(sum(2 << b for b in TABLE_BITS), np.uint32)
        for row in blocks.mapInArrow(_summed, TALLIES).collect():  # the tables' fixed size, compressed
            tables[row["part"] * BLOCK : (row["part"] + 1) * BLOCK] = np.frombuffer(_restored(row["counts"]), np.uint32)
        by_class = [F.sum(F.get("seen", F.lit(k))).alias(f"c{k}") for k in range(CLASSES)]
        sums = tallies.where("part < 0").agg(F.sum("kinds").alias("kinds"), *by_class).first()
        ends = np.zeros(CLASSES, np.int64)
        for row in texts.where(~F.col("held")).groupBy("size").count().collect():  # a row for each class
            ends[row["size"]] = row["count"]
        totals = np.array([sums[f"c{k}"] or 0 for k in range(CLASSES)]) + ends
        total, all_ends = int(totals.sum()), int(ends.sum())
        distinct = (sums["kinds"] or 0) + (all_ends > 0)

        sent = spark.sparkContext.broadcast(_pressed(tables.tobytes()))
        priced = stage(dealt.mapInArrow(_priced(sent, totals, code), COUNTED), "priced")
        done_with(spark, path, "spelt")
        dealt_pairs = pairs.select("part", "chunk", "size", "payload").repartition(max(width, parts // 8), "part").sortWithinPartitions("part")
        paired = stage(dealt_pairs.mapInArrow(_paired, COUNTED), "paired")
        done_with(spark, path, "pairs")
        columns = ["chunk", "bucket", "part", "size", "doc_id", "held", "tokens", "bytes", "payload"]
        both = priced.select(columns)
        for more in (names, paired, texts):
            both = both.union(more.select(columns))
        order = ["chunk", F.col("bucket").asc_nulls_last(), F.col("part").asc_nulls_last()]
        met = both.repartition(width, "chunk").sortWithinPartitions(*order)

        every_end = (all_ends + ESCAPE / 257) / (total + ESCAPE)
        end_bits = -np.log2((ends + BACKING * every_end) / (totals + BACKING))
        tallied: dict[int, list[tuple[int, float]]] = {}
        for row in met.mapInArrow(_ratios(all_ends, end_bits), RATIOS).groupBy("gate", "ratio").agg(F.sum("times")).collect():
            tallied.setdefault(row[0], []).append((row[1], row[2]))  # GATES times the places of ratios at most
    trust = np.zeros(GATES)
    for gate, found in tallied.items():
        trust[gate] = trust_of(*np.array(sorted(found)).T)
    rows = met.mapInArrow(_added(trust, all_ends, end_bits), SCORES)

    unit = math.log10(total + distinct + 1)
    share = (ends + 1) / (all_ends + CLASSES)
    in_class = [F.lit(float(np.log2(share[k]))) - F.get("bits", F.lit(k)) for k in range(CLASSES)]
    most = F.greatest(*in_class)
    summed = in_class[0] * 0
    for one in in_class:
        summed = summed + F.pow(F.lit(2.0), one - most)
    log2_p = most + F.log2(summed)
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + (1 if all_ends else 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(math.log10(all_ends + 1)) - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        (log2_p * F.lit(math.log10(2))).alias("score"),
        (-log2_p / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )
