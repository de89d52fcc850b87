"""Where the words of whole texts lie, for many texts at once, without hashing them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from seriesloom.llm.words import slices, text_bytes

_BYTES = np.arange(256)
WHITE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
_DIGIT = (_BYTES >= ord("0")) & (_BYTES <= ord("9"))
_LETTER = (_BYTES >= ord("a")) & (_BYTES <= ord("z"))
NOT_ALNUM = (_BYTES < 0x80) & ~_DIGIT & ~_LETTER  # of texts in lower case
_LOWER = np.where((_BYTES >= ord("A")) & (_BYTES <= ord("Z")), _BYTES + 32, _BYTES).astype(np.uint8)


class Spans(NamedTuple):
    """Words of a slice of texts as byte places in ``data``; text t has words bounds[t] to bounds[t + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    first: int  # index of the slice's first text in the batch
    count: int  # texts in the slice


def word_spans(texts: pa.Array, breaks: np.ndarray, lower: bool) -> Iterator[Spans]:
    """Words are longest runs of bytes that are no ``breaks``; with ``lower`` A-Z count as a-z."""
    data, places = text_bytes(texts)
    for i, j in slices(places):
        part = data[places[i] : places[j]]
        part = _LOWER[part] if lower else part
        edge = places[i : j + 1] - places[i]
        inside = np.zeros(len(part) + 2, bool)
        inside[1:-1] = ~breaks[part]
        cut = np.zeros(len(part) + 1, bool)
        cut[edge] = True
        here, before = inside[1:], inside[:-1]
        starts = np.flatnonzero(here & (~before | cut))
        ends = np.flatnonzero(before & (~here | cut))
        yield Spans(part, starts, ends, np.searchsorted(starts, edge), i, j - i)
