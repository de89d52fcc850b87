"""Licence scans with a positional index of rare words.

The index holds, for every word of the known licence notices, its postings: (phrase or notice, place in
it). How many documents hold a word gives its IDF. A file is looked up by its highest-IDF licence words:
of every phrase, the file's places of the phrase's rarest word are taken; each proposes a start, the
place less the word's place in the phrase. The postings of the other words, rarest first, are
intersected by relative position: a start stays while the file has the next word at start plus its
place. What stays are the phrase's exact places, and a phrase that stands in a file is never lost, since
its rarest word stands there too.

A notice is found where all of its mandatory key phrases stand at their relative positions: their
proposed starts lie within SLACK words of that of the first one, which allows for names and years filled in
between. Its agreement is the IDF share of the notice's words that the file has at exactly their places
from that start.

Words are compared by 64-bit hashes. Only the index (words of the notices, of fixed size) and its document
counts pass through the driver.

Defined results: NULL and empty texts have no words and nothing found. Rows are scanned one by one: repeated
rows and NULL ids give a row each. Documents are counted by rows. No rows: an empty result. Other columns
are not read. A phrase with a repeated word is found as any other; places may overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.words import words

SLACK = 8
THOUSAND = 1000
ALONE = 0.5  # score of a text with a base phrase and no notice

# Base phrases and their labels.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Short public notices by label, in words as the scanner reads them, and their mandatory
# key phrases in order.
NOTICES = (
    ("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided "
        "that the following conditions are met",
        ("redistribution and use in source and binary forms", "with or without modification"),
    ),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("general public license version 2",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify and or distribute this software", "with or without fee is hereby granted"),
    ),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("mit-notice", "released under the mit license", ("released under the mit license",)),
    ("mit-notice", "licensed under the mit license", ("licensed under the mit license",)),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)

Notice = tuple[str, str, Sequence[str]]
FOUND = "array<struct<label:string,start:long,words:int>>"
NOTED = "array<struct<label:string,start:long,agreement:double>>"


def key_place(text: str, phrase: str) -> int:
    """Where a key phrase stands in its notice, in words."""
    whole, part = text.split(" "), phrase.split(" ")
    for i in range(len(whole) - len(part) + 1):
        if whole[i : i + len(part)] == part:
            return i
    raise ValueError(f"{phrase!r} does not stand in {text!r}")


class Index(NamedTuple):
    """Licence words by rank of hash, and what stands where in words of that rank."""

    names: list[str]
    hashes: np.ndarray  # rising
    phrases: list[tuple[str, np.ndarray]]
    notices: list[tuple[str, np.ndarray, list[tuple[np.ndarray, int]]]]  # label, words, (key phrase, its place)


def build_index(phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[Notice] = NOTICES) -> Index:
    every = [p for p, _ in phrases] + [text for _, text, _ in notices]
    names = sorted({w for text in every for w in text.split(" ")})
    part = next(words(pa.array([" ".join(names)]), letters_only=True))
    if len(part.hashes) != len(names):
        raise ValueError("phrases and notices must be words of a-z, 0-9 and letters beyond ASCII, parted by one space")
    order = np.argsort(part.hashes)
    names = [names[i] for i in order]
    rank = {w: i for i, w in enumerate(names)}
    ranks = lambda text: np.array([rank[w] for w in text.split(" ")], np.int64)
    return Index(
        names,
        part.hashes[order],
        [(label, ranks(p)) for p, label in phrases],
        [(label, ranks(text), [(ranks(k), key_place(text, k)) for k in keys]) for label, text, keys in notices],
    )


class Hits(NamedTuple):
    """Words of a slice as ranks of licence words (-1: none), and where each licence word stands."""

    ranks: np.ndarray
    places: np.ndarray  # sorted by rank, then place
    edges: np.ndarray  # where each rank begins in ``places``
    text: np.ndarray
    bounds: np.ndarray


def hits_of(part, index: Index) -> Hits:
    at = np.minimum(np.searchsorted(index.hashes, part.hashes), len(index.hashes) - 1)
    ranks = np.where(index.hashes[at] == part.hashes, at, -1)
    licence = np.flatnonzero(ranks >= 0)
    places = licence[np.argsort(ranks[licence], kind="stable")]
    edges = np.searchsorted(ranks[places], np.arange(len(index.names) + 1))
    return Hits(ranks, places, edges, part.text, part.bounds())


def starts_of(phrase: np.ndarray, hits: Hits, idf: np.ndarray) -> np.ndarray:
    """All places of a phrase in a slice: looked up by its rarest word, intersected with the others by relative position."""
    rarest_first = np.argsort(-idf[phrase], kind="stable")
    anchor = int(rarest_first[0])
    word = phrase[anchor]
    starts = hits.places[hits.edges[word] : hits.edges[word + 1]] - anchor
    starts = starts[(starts >= 0) & (starts + len(phrase) <= len(hits.ranks))]
    starts = starts[hits.text[starts] == hits.text[starts + len(phrase) - 1]]
    for k in rarest_first[1:]:
        starts = starts[hits.ranks[starts + k] == phrase[k]]
    return starts


def notice_starts(keys: Sequence[tuple[np.ndarray, int]], hits: Hits, idf: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """Proposed starts of a notice (they may lie before its text) and the place of its first key phrase."""
    first, offset = keys[0]
    places = starts_of(first, hits, idf)
    for phrase, at in keys[1:]:
        other = starts_of(phrase, hits, idf) - at
        wanted, text = places - offset, hits.text[places]
        # The next place of the other phrase from slack words before on must be near enough and in the same text.
        i = np.searchsorted(other, wanted - slack)
        i = np.maximum(i, np.searchsorted(other, hits.bounds[text] - at))
        near = other[np.minimum(i, len(other) - 1)] if len(other) else wanted
        inside = (i < len(other)) & (near <= wanted + slack)
        inside &= near + at < hits.bounds[text + 1]
        places = places[inside]
    return places - offset, places


def agreement(notice: np.ndarray, starts: np.ndarray, places: np.ndarray, hits: Hits, weight: np.ndarray) -> np.ndarray:
    """The weight share of the notice's words that stand at their places from each start."""
    low, high = hits.bounds[hits.text[places]], hits.bounds[hits.text[places] + 1]
    got = np.zeros(len(starts), np.int64)
    for k, word in enumerate(notice):
        at = starts + k
        inside = (at >= low) & (at < high)
        got += np.where(inside & (hits.ranks[np.where(inside, at, 0)] == word), weight[word], 0)
    return got / max(int(weight[notice].sum()), 1)


def _documents_with(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows = np.zeros(len(index.names), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for part in words(batch.column(0), letters_only=True):
                hits = hits_of(part, index)
                ranks = hits.ranks[hits.places]
                text = hits.text[hits.places]  # rising within a rank
                new = np.ones(len(ranks), bool)
                new[1:] = (ranks[1:] != ranks[:-1]) | (text[1:] != text[:-1])
                n += np.bincount(ranks[new], minlength=len(n))
        words_ = pa.array([*index.names, None])
        yield pa.RecordBatch.from_arrays([words_, pa.array([*n.tolist(), rows])], ["word", "documents"])

    return run


def document_counts(docs: DataFrame, index: Index, text: str = "text") -> Mapping[str | None, int]:
    """How many rows hold each licence word; under None the number of all rows. As many entries as the index has words."""
    parts = docs.select(F.col(text)).mapInArrow(_documents_with(index), "word string, documents long")
    return {r["word"]: r["documents"] for r in parts.groupBy("word").agg(F.sum("documents").alias("documents")).collect()}


def weights(index: Index, counts: Mapping[str | None, int]) -> np.ndarray:
    """IDF in whole thousandths: floor(1000 * ln((rows + 1) / (rows with the word + 1)) + 1)."""
    n = counts.get(None, 0)
    return np.array([int(np.floor(THOUSAND * np.log((n + 1) / (counts.get(w, 0) + 1)))) + 1 for w in index.names], np.int64)


def _scan(index: Index, weight: np.ndarray, slack: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def spread(found: list[tuple], hits: Hits, count: int, last: str) -> pa.Array:
        """Found places as one list per text: by place, then label."""
        labels = np.concatenate([np.full(len(p), i) for i, (_, p, _, _) in enumerate(found)]) if found else np.zeros(0, int)
        places, starts, values = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, int) for k in (1, 2, 3))
        order = np.lexsort((labels, places))
        text = hits.text[places[order]].astype(np.int64)
        names = pa.array([found[i][0] for i in labels[order]], pa.string())
        begin = pa.array(starts[order] - hits.bounds[text], pa.int64())
        kind = pa.int32() if last == "words" else pa.float64()
        cells = pa.StructArray.from_arrays([names, begin, pa.array(values[order]).cast(kind)], ["label", "start", last])
        return pa.ListArray.from_arrays(np.searchsorted(text, np.arange(count + 1)).astype(np.int32), cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words(batch.column(1), letters_only=True):
                hits = hits_of(part, index)
                phrases, notices = [], []
                for label, phrase in index.phrases:
                    at = starts_of(phrase, hits, weight)
                    phrases.append((label, at, at, np.full(len(at), len(phrase))))
                for label, notice, keys in index.notices:
                    starts, places = notice_starts(keys, hits, weight, slack)
                    notices.append((label, places, starts, agreement(notice, starts, places, hits, weight)))
                columns = [
                    batch.column(0).slice(part.first, part.count),
                    pa.array(np.diff(hits.bounds).astype(np.int64)),
                    spread(phrases, hits, part.count, "words"),
                    spread(notices, hits, part.count, "agreement"),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n_words", "phrases", "notices"])

    return run


def scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    phrases: Sequence[tuple[str, str]] = PHRASES,
    notices: Sequence[Notice] = NOTICES,
    slack: int = SLACK,
) -> DataFrame:
    """(key, n_words, phrases, notices): a row per row of ``docs``.

    ``phrases``: array of (label, start, words), every place of every phrase. ``notices``: array of (label, start,
    agreement), every place where all mandatory key phrases stand. Starts count words from 0. Counting the
    documents of the licence words runs while the plan is built.
    """
    index = build_index(phrases, notices)
    weight = weights(index, document_counts(docs, index, text))
    narrow = docs.select(F.col(key).alias("key"), F.col(text))
    kind = narrow.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_words long, phrases {FOUND}, notices {NOTED}"
    return narrow.mapInArrow(_scan(index, weight, slack), schema).withColumnRenamed("key", key)


def label_list(*found: Column) -> Column:
    """The distinct labels of arrays of found places, sorted, joined by commas."""
    every = F.concat(*[F.transform(f, lambda p: p["label"]) for f in found])
    return F.array_join(F.array_sort(F.array_distinct(every)), ",")


def licence_score(phrases: Column, notices: Column) -> Column:
    """The best agreement of a notice; ALONE for a text with a base phrase and no better notice; else 0."""
    best = F.array_max(F.transform(notices, lambda p: p["agreement"]))
    return F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size(phrases) > 0, F.lit(ALONE)).otherwise(F.lit(0.0)))
