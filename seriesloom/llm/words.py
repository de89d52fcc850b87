"""Words and shingles of whole texts, hashed for many texts at once with numpy.

A word is a run of bytes other than the ASCII white space; A-Z count as a-z. Words and shingles
are known by 64-bit hashes: two different ones of a corpus of n meet by chance about n*n / 2**65
times.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
SHINGLE = 5
SLICE_BYTES = 1 << 20  # texts are hashed in slices of about this size; one longer text is one slice

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTERS_ONLY = _SPACE.copy()
_LETTERS_ONLY[:0x80] = True
_LETTERS_ONLY[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits evenly (the finish of a common hash function)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_LETTER = mix(np.arange(1, 257, dtype=U64) * _BASE)
_PLACES = mix(np.arange(1, 65, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(size, base, U64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


class Words(NamedTuple):
    """Words of a slice of texts: hash, text index within the slice, byte places in ``data``."""

    hashes: np.ndarray
    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    first: int  # index of the slice's first text in the batch
    count: int  # texts in the slice

    def bounds(self) -> np.ndarray:
        """Where each text's words begin, with the end of the last."""
        return np.searchsorted(self.text, np.arange(self.count + 1))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column, and where each text begins; NULL counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, values = texts.buffers()
    places = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    return data[places[0] : places[-1]], places - places[0]


def slices(places: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE_BYTES."""
    i, n = 0, len(places) - 1
    while i < n:
        j = int(np.searchsorted(places, places[i] + SLICE_BYTES, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_LETTER[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def words(texts: pa.Array, letters_only: bool = False) -> Iterator[Words]:
    """Hash the words of all texts, slice by slice.

    ``letters_only``: ASCII punctuation also parts words.
    """
    breaks = _LETTERS_ONLY if letters_only else _SPACE
    data, places = text_bytes(texts)
    for i, j in slices(places):
        part = _LOWER[data[places[i] : places[j]]]
        edge = places[i : j + 1] - places[i]
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = ~breaks[part]
        cut = np.zeros(len(part) + 1, bool)
        cut[edge] = True
        here, before = inside[1:].astype(bool), inside[:-1].astype(bool)
        starts = np.flatnonzero(here & (~before | cut))
        ends = np.flatnonzero(before & (~here | cut))
        hashes = hash_spans(part, starts, ends)
        text = np.searchsorted(edge, starts, "right") - 1
        yield Words(hashes, text, starts, ends, part, i, j - i)


def _in_order(hashes: np.ndarray, n: int, size: int) -> np.ndarray:
    out = np.full(n, U64(size), U64)
    for k in range(size):
        out += hashes[k : k + n] * _PLACES[k]
    return mix(out)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """For each text its index and its sorted distinct shingle hashes.

    A text of fewer than ``size`` words has its whole sequence as one shingle; without words: none.
    """
    for part in words(texts):
        edges = part.bounds()
        every = _in_order(part.hashes, max(0, len(part.hashes) - size + 1), size)
        for t in range(part.count):
            a, b = edges[t], edges[t + 1]
            if b - a >= size:
                yield part.first + t, np.unique(every[a : b - size + 1])
            elif b > a:
                yield part.first + t, _in_order(part.hashes[a:b], 1, int(b - a))
            else:
                yield part.first + t, every[:0]
