"""Periodic runs of words, by a dictionary of basic factors.

A run is a stretch of words with smallest period q that no neighbouring word extends. Runs of at
least four periods are found in three steps, for all texts of a slice at once:

* Names. Two places have the same name at level k if the 2**k words from there on are equal. Names of
  level k + 1 are pairs of names of level k. Only places whose name occurs twice in their text go
  on: every factor of a run does, so ordinary prose drops out after a few levels.
* Successors. The next place with the same name, looked at when it is 2**k / 2 < q <= 2**k words
  away. Inside a run of period q the next occurrence of a factor at least q long is exactly q away
  (its first q words are primitive, they recur at multiples of q only). Two equal steps, i, i + q,
  i + 2q, are an arithmetic progression within twice the factor's length and propose q.
* Extension. Consecutive places that propose the same q belong to one run. Each such step says that
  two words q apart are equal, and the run's last factor that fits begins 2q + 2**k words before its
  end, so the stretch of places gives the run's exact ends. A period lies in one level only; what is
  proposed there is deduplicated by start, length and period.

Words are compared by 64-bit hashes that include the text they are in. Every text is worked on whole,
in one task: memory is a few numbers per word of a slice (about 1 MB of texts, or one longer text).

Defined results: NULL and empty texts, and texts without words, have no runs and collapse to an empty
text. Rows are worked on one by one, so repeated rows, repeated and NULL ids give a row each. No rows:
an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.spans import WHITE, Spans, word_spans
from seriesloom.llm.words import hash_spans, mix

LEAST_WORDS = 6
LEAST_EXPONENT = 4

_TEXT = np.uint64(0x9FB21C651E98DF25)
_WHITE_RUN = r"[\x20\x09-\x0D]+"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each key: its rank among the distinct keys, the index of the next equal key (-1), and whether it occurs twice."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    names = np.empty(len(keys), np.int64)
    names[order] = np.concatenate([[0], np.cumsum(~same)])
    after = np.full(len(keys), -1, np.int64)
    after[order[:-1][same]] = order[1:][same]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return names, after, twice


def runs_of(hashes: np.ndarray, bounds: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """Rows (first word, words, period) of all runs of texts that lie one after the other.

    ``bounds``: where each text's words begin, with the end of the last.
    """
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    stop = bounds[1:][text]
    at = np.flatnonzero(stop - np.arange(len(hashes)) >= 1)
    keys = mix(hashes + _TEXT * (text.astype(np.uint64) + np.uint64(1)))
    # One place more than words: steps beyond the last text read 0 there.
    step, name = np.zeros(len(hashes) + 1, np.int64), np.full(len(hashes) + 1, -1, np.int64)
    found, span, longest = [], 1, int(sizes.max(initial=0))
    while len(at) > 1:
        names, after, twice = _named(keys)
        far = np.where(after >= 0, at[after] - at, 0)
        step[:] = 0
        step[at] = np.where((far > span // 2) & (far <= span), far, 0)
        two = (step[at] > 0) & (step[np.minimum(at + step[at], len(hashes))] == step[at])
        begin, period = at[two], step[at][two]
        if len(begin):
            new = np.concatenate([[True], (np.diff(begin) != 1) | (np.diff(period) != 0)])
            head, tail = np.flatnonzero(new), np.flatnonzero(np.concatenate([new[1:], [True]]))
            q = period[head]
            length = begin[tail] - begin[head] + 2 * q + span
            found.append(np.stack([begin[head], length, q], 1))
        if 2 * span >= longest:  # a longer period would need more than four times half the next factor
            break
        name[:] = -1
        name[at[twice]] = names[twice]
        next_at = at[twice & (at + 2 * span <= stop[at])]
        right = name[next_at + span]
        next_at, right = next_at[right >= 0], right[right >= 0]
        keys = name[next_at] * (len(hashes) + 1) + right
        at, span = next_at, 2 * span
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    rows = rows[rows[:, 1] >= np.maximum(least, exponent * rows[:, 2])]
    return np.unique(rows, axis=0) if len(rows) else rows


def repeated(rows: np.ndarray, n: int) -> np.ndarray:
    """For n words: which lie in a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, rows[:, 0] + rows[:, 2], 1)
    np.add.at(edge, rows[:, 0] + rows[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def joined(part: Spans, keep: np.ndarray) -> pa.Array:
    """Each text's kept words, joined by one space."""
    starts, sizes = part.starts[keep], (part.ends - part.starts)[keep]
    before = np.concatenate([[0], np.cumsum(keep)])[part.bounds]  # kept words before each text
    room = sizes + 1
    last = before[1:][before[1:] > before[:-1]] - 1
    room[last] -= 1  # no space after a text's last word
    places = np.concatenate([[0], np.cumsum(room)])
    out = np.full(places[-1], 0x20, np.uint8)
    source = np.repeat(starts - places[:-1], room) + np.arange(places[-1])
    inside = source < np.repeat(starts + sizes, room)
    out[inside] = part.data[source[inside]]
    offsets = pa.py_buffer(places[before].astype(np.int64).tobytes())
    return pa.Array.from_buffers(pa.large_string(), part.count, [None, offsets, pa.py_buffer(out.tobytes())])


def _search(least: int, exponent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in word_spans(batch.column(1), WHITE, lower=False):
                rows = runs_of(hash_spans(part.data, part.starts, part.ends), part.bounds, least, exponent)
                keep = ~repeated(rows, len(part.starts))
                owner = np.searchsorted(part.bounds, rows[:, 0], "right") - 1
                cells = [rows[:, 0] - part.bounds[owner], rows[:, 1], rows[:, 2]]
                offsets = np.searchsorted(rows[:, 0], part.bounds).astype(np.int32)
                runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c) for c in cells], fields=list(_RUN)))
                columns = [
                    batch.column(0).slice(part.first, part.count),
                    pa.array(np.diff(part.bounds)),
                    runs,
                    joined(part, keep).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n_words", "runs", "collapsed"])

    return run


def find_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT
) -> DataFrame:
    """(key, n_words, runs, collapsed): a row per row of ``docs``.

    ``runs``: array of (start, length, period) in words, by start, then length; all runs of at least
    ``least`` words and ``exponent`` periods. ``collapsed``: the text with one period of every run left,
    words joined by one space. No shuffle.
    """
    if exponent < LEAST_EXPONENT:
        raise ValueError(f"runs of fewer than {LEAST_EXPONENT} periods are not all found")
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return narrow.mapInArrow(_search(least, exponent), schema).withColumnRenamed("key", key)


def run_lines(runs: Column) -> Column:
    """Each run as 'start,length,period' and a line end, by start, then period."""
    by_period = F.transform(runs, lambda r: F.struct(r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return F.concat(F.array_join(F.transform(F.sort_array(by_period), line), "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))


def longest_run(runs: Column) -> Column:
    """The run with the greatest length, then the smallest start, then the smallest period; NULL without runs."""
    ranked = F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.get(F.sort_array(ranked), F.lit(0))


def with_periodic_tail(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): in about a tenth of the texts, chosen by a checksum of the id, the words from some place on repeat.

    With h = crc32(id), g = h / 10: texts with h % 10 = 0 and n > 0 words have word a + (i - a) % p in
    place of each word i >= a, where a = g % n and p = 1 + (n - a) / (3 + g % 8), all in whole numbers.
    """
    words = F.filter(F.split(F.col(text), _WHITE_RUN), lambda w: w != "")
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    chosen = docs.select(F.col(key), F.col(text), (F.coalesce(h % 10, F.lit(1)) == 0).alias("_chosen"), F.floor(h / 10).alias("_g"))
    n = F.size("_words")
    placed = (
        chosen.withColumn("_words", F.when(F.col("_chosen") & F.col(text).isNotNull(), words))
        .withColumn("_n", F.when(n > 0, n))
        .withColumn("_a", (F.col("_g") % F.col("_n")).cast("int"))
        .withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    )
    tail = F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_words", F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    return placed.select(F.col(key), F.when(F.col("_n").isNotNull(), F.array_join(tail, " ")).otherwise(F.col(text)).alias(text))
