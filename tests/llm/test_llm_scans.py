"""Licence scans, periodic runs and importance resampling against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from llm_data import ODD, SPACE, documents, plain_words, prose, vocabulary
from pyspark.sql import functions as F

from seriesloom.llm import licences, periodic, queries, resampling
from seriesloom.llm.spans import WHITE, word_spans
from seriesloom.llm.words import hash_spans, words

NOT_ALNUM = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD).cache()


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def alnum_words(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return [w.decode() for w in NOT_ALNUM.split(low) if w]


def rows_by_id(df):
    out = defaultdict(list)
    for row in df.collect():
        out[row["doc_id"]].append(row)
    return out


# --- licence scans --------------------------------------------------------------------------


def phrase_places(found, phrase):
    parts = phrase.split(" ")
    return [i for i in range(len(found) - len(parts) + 1) if found[i : i + len(parts)] == parts]


def plain_scan(texts, slack=licences.SLACK):
    """Base places and (label, start, agreement) of notices by plain loops."""
    split = [alnum_words(t) for t in texts]
    known = Counter(w for s in split for w in set(s))
    weight = lambda w: math.floor(1000 * math.log((len(texts) + 1) / (known[w] + 1))) + 1
    out = []
    for found in split:
        base = sorted((i, label) for phrase, label in licences.PHRASES for i in phrase_places(found, phrase))
        noted = []
        for label, text, keys in licences.NOTICES:
            starts = [[i - licences.key_place(text, k) for i in phrase_places(found, k)] for k in keys]
            for s in starts[0]:
                if all(any(abs(o - s) <= slack for o in other) for other in starts[1:]):
                    parts = text.split(" ")
                    there = [0 <= s + j < len(found) and found[s + j] == w for j, w in enumerate(parts)]
                    total = sum(map(weight, parts))
                    noted.append((label, s, sum(weight(w) for w, t in zip(parts, there, strict=True) if t) / total))
        out.append((len(found), base, sorted(noted)))
    return out


def licence_texts(seed, n):
    dice, known = random.Random(seed), vocabulary(60, 2)
    pieces = [p for p, _ in licences.PHRASES] + [t for _, t, _ in licences.NOTICES]
    pieces += [k for _, _, keys in licences.NOTICES for k in keys]
    texts = []
    for _ in range(n):
        found = []
        for _ in range(dice.randint(0, 5)):
            found += [dice.choice(known) for _ in range(dice.randint(0, 12))]
            part = dice.choice(pieces).split(" ")
            for _ in range(dice.choice([0, 0, 1, 3, 9, 14])):  # names filled in, and words changed
                at = dice.randrange(len(part) + 1)
                part[at:at] = [dice.choice(known)]
            if dice.random() < 0.2:
                part[dice.randrange(len(part))] = "x"
            found += part if dice.random() < 0.9 else part[: len(part) // 2]
        case = dice.choice([str, str.upper, str.title])
        texts.append(case(dice.choice([" ", "-", ", ", "\n"]).join(found)))
    return texts


def test_scan_finds_what_plain_loops_find(spark):
    texts = licence_texts(4, 400) + [None, "", "MIT", "License. MIT", "the mit license mit license mit licensed", "general public", "license"]
    want = plain_scan(texts)
    got = rows_by_id(licences.scan(documents(spark, list(enumerate(texts))).repartition(5)))
    hit = 0
    for i, (n, base, noted) in enumerate(want):
        row = got[i][0]
        assert (row.n_words, [(p.start, p.label) for p in row.phrases]) == (n, base)
        mine = sorted((p.label, p.start, p.agreement) for p in row.notices)
        assert [m[:2] for m in mine] == [w[:2] for w in noted]
        assert np.allclose([m[2] for m in mine], [w[2] for w in noted], atol=1e-12)
        hit += len(noted)
    assert hit > 100 and any(0 < p[2] < 1 for _, _, noted in want for p in noted)


def test_places_do_not_cross_texts(spark):
    texts = ["the mit", "license apache", "license general public", "license", "permission is hereby granted free of charge", "to deal in the software without restriction"]
    got = licences.scan(documents(spark, list(enumerate(texts))).coalesce(1))
    assert got.where("size(phrases) + size(notices) > 0").isEmpty()


def test_every_place_of_a_phrase_is_counted(spark):
    texts = [(1, "mit license " * 40_000), (2, "general public license\n" * 3 + "word")]
    got = rows_by_id(licences.scan(documents(spark, texts)))
    assert len(got[1][0].phrases) == 40_000 and got[1][0].phrases[-1].start == 79_998
    assert [p.start for p in got[2][0].phrases] == [0, 3, 6]


def test_phrases_of_the_caller_are_scanned(spark):
    texts = [(1, "un deux un deux un"), (2, "été Üben, ok"), (3, "a a a a")]
    got = rows_by_id(licences.scan(documents(spark, texts), phrases=[("un deux un", "f"), ("été Üben", "u"), ("a a", "a")], notices=[]))
    assert [[p.start for p in got[i][0].phrases] for i in (1, 2, 3)] == [[0, 2], [0], [0, 1, 2]]
    with pytest.raises(ValueError):
        licences.build_index([("no-word", "x")], [])
    with pytest.raises(ValueError):
        licences.build_index([], [("x", "a b c", ("c b",))])


def test_scan_of_odd_rows(spark, odd, none):
    got = licences.scan(odd)
    assert got.columns == ["doc_id", "n_words", "phrases", "notices"] and got.count() == len(ODD)
    by_id = rows_by_id(got)
    assert all(r.n_words == len(alnum_words(t)) for i, t in ODD for r in by_id[i])
    assert len(by_id[None]) == 1 and len(by_id[8]) == 2
    assert licences.scan(none).isEmpty()


# --- periodic runs --------------------------------------------------------------------------


def plain_runs(found, least=6, exponent=4):
    out = {}
    for q in range(1, len(found) // exponent + 1):
        i = 0
        while i + q < len(found):
            if found[i] != found[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(found) and found[i] == found[i + q]:
                i += 1
            if i - start + q >= max(least, exponent * q):
                out.setdefault((start, i - start + q), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def plain_collapse(found, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(found) if i not in gone)


def white_words(text):
    return [w for w in re.split(f"[{SPACE}]+", text or "") if w]


def periodic_texts(seed, n):
    dice = random.Random(seed)
    texts = []
    for _ in range(n):
        found = []
        for _ in range(dice.randint(0, 6)):
            letters = dice.choice(["ab", "abc", "aB", "é中"])
            block = [dice.choice(letters) for _ in range(dice.randint(1, 11))]
            found += (block * dice.randint(1, 9))[: dice.randint(1, 90)]
            found += [dice.choice("abcdefgh") for _ in range(dice.randint(0, 4))]
        texts.append(dice.choice([" ", "\n", " \t\x0b"]).join(found))
    return texts


def test_runs_are_those_of_a_plain_search(spark):
    texts = periodic_texts(6, 700)
    got = rows_by_id(periodic.find_runs(documents(spark, list(enumerate(texts))).repartition(4)))
    total = 0
    for i, text in enumerate(texts):
        found, row = white_words(text), got[i][0]
        want = plain_runs(found)
        assert [tuple(r) for r in row.runs] == want and row.n_words == len(found)
        assert row.collapsed == plain_collapse(found, want)
        total += len(want)
    assert total > 300


def test_every_period_is_found_at_its_least_length():
    dice = random.Random(2)
    for q in [*range(1, 40), 63, 64, 65, 127, 128, 129, 500]:
        block = [f"w{dice.random()}" for _ in range(q)]
        for size, hits in ((4 * q, 1 if q > 1 else 0), (4 * q - 1, 0), (max(6, 4 * q), 1)):
            found = ["x", *(block * 6)[:size], "y"]
            part = next(word_spans(pa.array([" ".join(found)]), WHITE, lower=False))
            rows = periodic.runs_of(hash_spans(part.data, part.starts, part.ends), part.bounds, 6, 4)
            assert len(rows) == hits and (not hits or tuple(rows[0]) == (1, size, q)), (q, size)


def test_case_and_other_texts_part_runs(spark):
    texts = [(1, "a A a A a A a A"), (2, "a a a A a a a"), (3, "b b b"), (4, "b b b"), (5, "b b b b b"), (6, "b b b b b b")]
    got = rows_by_id(periodic.find_runs(documents(spark, texts).coalesce(1)))
    assert [len(got[i][0].runs) for i in range(1, 7)] == [1, 0, 0, 0, 0, 1]
    assert got[1][0].collapsed == "a A" and got[6][0].collapsed == "b" and got[2][0].collapsed == texts[1][1]
    with pytest.raises(ValueError):
        periodic.find_runs(documents(spark, texts), exponent=3)


def test_long_runs_of_long_texts(spark):
    dice = random.Random(8)
    block = [str(dice.random()) for _ in range(9_000)]
    texts = [(1, "a " * 400_000), (2, " ".join(block * 5)), (3, " ".join(str(i) for i in range(300_000))), (4, "x" * 3_000_000)]
    got = rows_by_id(periodic.find_runs(documents(spark, texts)))
    assert [tuple(r) for r in got[1][0].runs] == [(0, 400_000, 1)] and got[1][0].collapsed == "a"
    assert [tuple(r) for r in got[2][0].runs] == [(0, 45_000, 9_000)] and got[2][0].collapsed == " ".join(block)
    assert got[3][0].runs == [] and got[4][0].collapsed == "x" * 3_000_000


def test_tails_are_made_periodic_as_stated(spark):
    dice, known = random.Random(9), vocabulary()
    rows = [(i, prose(dice, known, dice.randint(0, 60)) or None) for i in range(300)]
    got = rows_by_id(periodic.with_periodic_tail(documents(spark, rows)))
    changed = 0
    for i, text in rows:
        h = zlib.crc32(str(i).encode())
        found, g = white_words(text), h // 10
        if h % 10 == 0 and found:
            n, a = len(found), g % len(found)
            p = 1 + (n - a) // (3 + g % 8)
            found = [found[j] if j < a else found[a + (j - a) % p] for j in range(n)]
            changed += 1
            assert got[i][0].text == " ".join(found)
        else:
            assert got[i][0].text == text
    assert changed > 10


def test_longest_run_and_lines(spark):
    rows = [(1, [(0, 8, 2), (10, 9, 1), (30, 9, 2)]), (2, [])]
    df = spark.createDataFrame(rows, "doc_id long, runs array<struct<start:long,length:long,period:long>>")
    got = {r.doc_id: r for r in df.select("doc_id", periodic.longest_run(F.col("runs")).alias("l"), periodic.run_lines(F.col("runs")).alias("t")).collect()}
    assert (got[1].l.start, got[1].l.length, got[1].l.period) == (10, 9, 1) and got[2].l is None
    assert got[1].t == "0,8,2\n10,9,1\n30,9,2\n" and got[2].t == ""


def test_runs_of_odd_rows(spark, odd, none):
    got = periodic.find_runs(periodic.with_periodic_tail(odd))
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"] and got.count() == len(ODD)
    by_id = rows_by_id(periodic.find_runs(odd))
    for i, text in ODD:
        for row in by_id[i]:
            want = [(0, 30_000, 1)] if i == 10 else plain_runs(white_words(text))
            assert [tuple(r) for r in row.runs] == want
    assert by_id[1][0].collapsed == by_id[2][0].collapsed == by_id[3][0].collapsed == ""
    assert periodic.find_runs(none).isEmpty() and periodic.with_periodic_tail(none).isEmpty()


# --- importance resampling ------------------------------------------------------------------


def grams_of(found, orders):
    return [" ".join(found[i : i + k]) for k in range(1, orders + 1) for i in range(len(found) - k + 1)]


def plain_resample(docs, target, buckets, orders, least, share, seed="2024"):
    """(n_features, weight, score, rank) per document by plain loops."""
    code = lambda g: zlib.crc32(g.encode()) % buckets
    found = [grams_of(alnum_words(t), orders) for _, t in docs]
    raw = Counter(code(g) for f in found for g in f)
    want = Counter(code(g) for t in target for g in grams_of(alnum_words(t), orders))
    s, t = sum(raw.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets))))
    out = []
    for (i, text), f in zip(docs, found, strict=True):
        weight = sum(gain(code(g)) for g in f)
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(alnum_words(text))])
    fits = sorted((-r[3], r[0] is not None, r[0] or 0, k) for k, r in enumerate(out) if r[4] >= least)
    ranks = {k: n + 1 for n, (_, _, _, k) in enumerate(fits[: share[0] * len(fits) // share[1]])}
    return [(*r[:4], ranks.get(k)) for k, r in enumerate(out)]


@pytest.mark.parametrize("orders", [1, 3])
def test_resampling_is_that_of_plain_loops(spark, orders):
    dice, known = random.Random(11), vocabulary()
    docs = [(i, prose(dice, known if i % 3 else known[:40], dice.randint(0, 60)).title() or None) for i in range(500)]
    docs += [(500 + i, t) for i, (_, t) in enumerate(ODD)]
    target = [prose(dice, known[:60], 30) for _ in range(40)] + [None, ""]
    want = {r[0]: r for r in plain_resample(docs, target, 500, orders, 20, (10, 100))}
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(documents(spark, docs).repartition(7), items, buckets=500, orders=orders)
    rows = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()]
    assert len(rows) == len(docs) and {r[0]: r for r in rows} == want
    assert sum(r[4] is not None for r in rows) >= 30


def test_equal_scores_go_to_the_smaller_id(spark):
    rows = [(i, 30, 30, 0, 0, i) for i in range(400)]
    weighed = spark.createDataFrame(rows, "key long, n_words long, n_features long, weight long, task long, place long")
    flat = resampling.draw(weighed, share=(25, 100), seed="x")
    got = sorted((r["rank"], -r.score, r.key) for r in flat.collect() if r["rank"])
    assert [g[0] for g in got] == list(range(1, 101)) and got == sorted(got, key=lambda g: (g[1], g[2]))
    same = [(7, 30, 30, 0, 0, i) for i in range(100)] + [(None, 30, 30, 0, 1, i) for i in range(100)]
    copies = resampling.draw(spark.createDataFrame(same, weighed.schema), share=(1, 4))
    assert sorted(r["rank"] for r in copies.collect() if r["rank"]) == list(range(1, 51))
    assert copies.count() == 200


def test_xxhash_and_checksum_are_those_of_the_libraries():
    dice = random.Random(12)
    texts = [None, "", "é ünï " * 3, *(" ".join(prose(dice, vocabulary(), 9)[: dice.randint(0, 70)].split(" ")).replace(" ", "") for _ in range(300))]
    for part in resampling.features(pa.array(texts), 3):
        grams = part.grams
        spans = [grams.bytes_of(i) for i in range(len(grams.starts))]
        assert [xxhash.xxh64_intdigest(b) for b in spans] == resampling.xxhash64(grams).tolist()
        assert [zlib.crc32(b) for b in spans] == resampling.crc32(grams, np.arange(len(spans))).tolist()


def test_bytes_decide_where_hashes_agree(monkeypatch):
    """With all hashes equal the table still keeps different n-grams apart."""
    dice = random.Random(13)
    text = " ".join(dice.choice(["a", "ab", "abcdefgh", "abcdefghi", "x" * 32, "x" * 33, "x" * 33 + "y", "x" * 34]) for _ in range(400))
    monkeypatch.setattr(resampling, "xxhash64", lambda grams: np.full(len(grams.starts), 5, np.uint64))
    part = next(resampling.features(pa.array([text]), 2))
    table = resampling.intern(part.grams, 1000)
    spans = [part.grams.bytes_of(i) for i in range(len(part.grams.starts))]
    want = Counter(spans)
    assert [int(table.count[s]) for s in table.slot] == [want[b] for b in spans]
    assert [int(table.bucket[s]) for s in table.slot] == [zlib.crc32(b) % 1000 for b in spans]
    assert (table.count > 0).sum() == len(want)


def test_resampling_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([("one two three",), (None,)], "text string")
    got = resampling.resample(odd, items, least_words=0, share=(1, 1))
    rows = got.collect()
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"] and len(rows) == len(ODD)
    assert sorted(r["rank"] for r in rows) == list(range(1, len(ODD) + 1))
    assert all(r.weight == 0 for r in rows if r.n_features == 0)
    by_id = {i: alnum_words(t) for i, t in ODD}
    assert all(r.n_features == len(by_id[r.doc_id]) for r in rows)
    assert resampling.resample(none, items).isEmpty()
    assert resampling.resample(odd, none.select("text")).count() == len(ODD)


# --- the queries against their SQL, with words that tables do not hold -------------------------


@pytest.mark.parametrize("name", ["op11_license_scans", "op12_periodic_runs", "op13_importance_resampling"])
def test_queries_agree_with_sql(spark, tmp_path, name):
    dice = random.Random(14)
    texts = [*licence_texts(15, 60), *periodic_texts(16, 60), *(prose(dice, vocabulary(), dice.randint(5, 120)) for _ in range(60)), None, "", " "]
    documents(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, prose(dice, vocabulary()[:50], 25)) for i in range(30)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    df = queries.QUERIES[name](spark, str(tmp_path))
    want = db.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, want))


def test_word_spans_are_words(spark):
    texts = [t for _, t in ODD] + ["a\x00b", " lead", "trail "]
    got = []
    for part in word_spans(pa.array(texts), WHITE, lower=True):
        cut = [part.data[s:e].tobytes().decode() for s, e in zip(part.starts, part.ends, strict=True)]
        got += [cut[a:b] for a, b in zip(part.bounds, part.bounds[1:], strict=False)]
    assert got == [plain_words(t) for t in texts]
    assert sum(len(p.hashes) for p in words(pa.array(texts), letters_only=True)) == sum(len(alnum_words(t)) for t in texts)
