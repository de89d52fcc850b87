"""Concatenate token streams and cut them into windows of a fixed size.

Pass one tokenizes and counts: each task writes its documents with the tokens that come before them
in the task. The totals of the tasks, summed in task order, give every task its place in the stream.
Pass two needs no shuffle of tokens: a document's place in the stream is its task's place plus its own,
and it is cut where the windows begin. Every piece is a row; ``begins`` and ``ends`` say whether it
holds the document's first and last token, so pieces that cross a window border are known.

Defined results: NULL text is empty and yields the closing id alone. Rows are packed one by one, so
repeated rows and NULL ids are packed too. Only the last window may be short. No rows: no pieces.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesloom.llm.shared import stage

WINDOW = 4096
CLOSING_ID = 2
CACHE_BYTES = 96 << 20  # of ids and words kept by a Python worker
OUT_BYTES = 4 << 20

TOKENS = "part long, place long, before long, doc_id long, tokens long, ids binary"
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # no apostrophe: tokenizers part "it's" in ways of their own
# Latin letters whose lower case is one letter and that no normal form changes.
_LATIN = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+\\Z")

# Texts by which a tokenizer is tried: case, accents, digits, punctuation, scripts, and runs of white space.
_PROBES = (
    "Hello, World. It's 12 o'clock!",
    " two  spaces\tand\nlines\x0b ",
    "Zoë naïve İ. é. рус. 中文, x",
    "www.example.com/a_b?c=1 3.14 (ok)",
    "Ab.!! cd*** É) e--",
)

_tokenizers: dict[str, WordTokenizer] = {}


def _stays_letters(word: str) -> bool:
    """Letters only, also in lower case and normal form, which make letter and mark of some."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word.lower()).isalpha())


class WordTokenizer:
    """Ids of whole texts.

    For a tokenizer that parts words at white space the ids of a text are those of its words in turn, so a word is
    encoded once and remembered, by its bytes. The memory is bounded: each time that half of it is full, words not met
    since the last time are forgotten. Letters with punctuation at the end are put together from two words.
    Whether a tokenizer is of that kind is tried on a few texts when it is loaded; the texts of any other are encoded whole.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self._letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.room = self.half = cache_bytes // 2
        self.by_words = all(self._text_by_words(t.encode()) == self._whole(t) for t in _PROBES)

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode(self, word: bytes) -> bytes:
        low = text = word.decode()
        if not word.isalpha():
            if not _LATIN.match(text):
                return self._whole(text)
            low = self._letters(text.lower())[0][0]
        ids = [t.id for t in self.tokenizer.model.tokenize(low)]  # only letters: one piece for the model, in lower case and as bytes
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, word: bytes) -> bytes:
        body = word.rstrip(_MARKS)
        if len(body) < len(word):  # a run of letters is a piece of its own
            if body.isalpha():
                return self.word(body.lower()) + self.word(word[len(body) :])
            if _stays_letters(body.decode()):
                return self.word(body) + self.word(word[len(body) :])
        ids = self.known.get(word) or self.older.get(word)
        if not ids:
            ids = self.word(word.lower()) if word.isalpha() and not word.islower() else self._encode(word)
        size = 130 + len(word) + len(ids)
        if size > self.room:
            self.known, self.older, self.room = {}, self.known, self.half
        self.room -= size
        self.known[word] = ids
        return ids

    def word(self, word: bytes) -> bytes:
        return self.known.get(word) or self._learn(word)

    def text(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        return self.utf8(text.encode())

    def utf8(self, text: bytes) -> bytes:
        """``text`` for a text's bytes."""
        return self._text_by_words(text) if self.by_words else self._whole(text.decode())

    def _text_by_words(self, text: bytes) -> bytes:
        known, learn = self.known.get, self._learn
        return b"".join([known(w) or learn(w) for w in text.split()])  # bytes are split at ASCII white space


def tokenizer(path: str) -> WordTokenizer:
    """The process's tokenizer for a file, with what it has learnt."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def _count(path: str, closing: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, place = TaskContext.get().partitionId(), 0, 0
        words, end = tokenizer(path), np.array([closing], "<u4").tobytes()
        rows, held = [], 0
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for key, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                ids = words.utf8(text.as_py() or b"") + end
                rows.append((part, place, before, key, len(ids) // 4, ids))
                place, before, held = place + 1, before + len(ids) // 4, held + len(ids)
                if held > OUT_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.binary()]
    names = ["part", "place", "before", "doc_id", "tokens", "ids"]
    columns = zip(zip(*rows, strict=True), kinds, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names)


def tokenize(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", closing: int = CLOSING_ID) -> DataFrame:
    """Pass one, written out: see TOKENS."""
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return stage(narrow.mapInArrow(_count(path, closing), TOKENS), "tokens")


def stream_places(tokens: DataFrame) -> DataFrame:
    """Add ``stream``: the tokens of the whole stream before a document.

    The table of totals has a row per task of pass one. It is written first, so that Spark knows its
    size when it chooses the join.
    """
    totals = stage(tokens.groupBy("part").agg(F.sum("tokens").alias("total")), "totals")
    start = F.sum("total").over(W.orderBy("part")) - F.col("total")
    starts = stage(totals.select("part", start.alias("start")), "starts")
    return tokens.join(starts, "part").withColumn("stream", F.col("start") + F.col("before"))


def cut(placed: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per piece of a document in a window, with the piece's ids."""
    last = F.col("stream") + F.col("tokens")
    first_window = F.floor(F.col("stream") / window)
    windows = F.sequence(first_window, F.floor((last - 1) / window))
    rows = placed.withColumn("sequence_id", F.explode(windows))
    begin = F.greatest(F.col("stream"), F.col("sequence_id") * window)
    length = F.least(last, (F.col("sequence_id") + 1) * window) - begin
    start = begin - F.col("stream")
    piece = F.substring(F.col("ids"), (start * 4 + 1).cast("int"), (length * 4).cast("int"))
    return rows.select(
        "doc_id",
        start.alias("start"),
        length.alias("length"),
        piece.alias("ids"),
        F.col("tokens").alias("doc_tokens"),
        "sequence_id",
        (begin - F.col("sequence_id") * window).alias("offset"),
        (start == 0).alias("begins"),
        (start + length == F.col("tokens")).alias("ends"),
    )


def pack(docs: DataFrame, path: str, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents, packed; see ``cut`` for the columns."""
    return cut(stream_places(tokenize(docs, path, key, text)), window)
