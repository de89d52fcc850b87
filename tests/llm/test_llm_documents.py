"""Operators on documents against brute force, and on odd rows."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from llm_data import ODD, documents, edited, plain_shingles, plain_words, prose, vocabulary
from pyspark.sql import functions as F

from seriesloom.llm import decontaminate, exact, jaccard, mixing, packing, queries, sharding, toxicity
from seriesloom.llm.words import shingle_sets, words
from seriesloom.session import shared_folder

PATH = queries.tokenizer_path()


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD).cache()


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def corpus():
    """Families of near copies of several degrees, passages that many texts share, exact copies."""
    dice, known = random.Random(3), vocabulary()
    passage = prose(dice, known, 60)
    texts = [prose(dice, known, dice.randint(6, 90)) for _ in range(60)]
    for _ in range(8):
        first = prose(dice, known, dice.randint(40, 120))
        texts += [first] + [edited(dice, known, first, dice.choice([0.01, 0.02, 0.04, 0.06])) for _ in range(12)]
    texts += [f"{prose(dice, known, 30)} {passage} {prose(dice, known, 20)}" for _ in range(30)]
    texts += texts[:10] + [t.upper() for t in texts[10:14]]
    centre = prose(dice, known, 150)
    texts += [centre] + [edited(dice, known, centre, 0.025) for _ in range(40)]
    dice.shuffle(texts)
    return list(enumerate(texts))


# --- words ----------------------------------------------------------------------------------


def test_words_and_shingles_are_those_of_a_plain_loop():
    texts = [t for _, t in ODD] + ["a b c d e f a b c d e f", " lead", "trail ", "a\x00b"]
    got = defaultdict(list)
    for part in words(pa.array(texts)):
        for t, s, e in zip(part.text, part.starts, part.ends, strict=True):
            got[part.first + t].append(part.data[s:e].tobytes().decode())
    assert [got[i] for i in range(len(texts))] == [plain_words(t) for t in texts]
    assert [len(s) for _, s in shingle_sets(pa.array(texts))] == [len(plain_shingles(t)) for t in texts]


def test_equal_words_have_equal_hashes_across_slices(monkeypatch):
    monkeypatch.setattr("seriesloom.llm.words.SLICE_BYTES", 10)
    texts = ["alpha beta", "beta Alpha gamma", "gamma alpha beta"]
    sets = dict(shingle_sets(pa.array(texts), 1))
    assert len(set(sets[1]) & set(sets[2])) == 3 and len(set(sets[0]) & set(sets[1])) == 2


# --- toxicity -------------------------------------------------------------------------------


def test_toxicity_learns_words_and_keeps_clean_texts(spark):
    dice, known = random.Random(5), vocabulary()
    bad = ["grumlin", "voxter", "snarp", "dreck"]
    rows, labels = [], []
    for i in range(900):
        toxic = dice.random() < 0.15
        text = prose(dice, known, dice.randint(5, 80)).split(" ")
        for _ in range(3 if toxic else 0):
            text[dice.randrange(len(text))] = dice.choice(bad)
        rows.append((i, " ".join(text)))
        if dice.random() < 0.6:
            labels.append((i, int(toxic)))
    truth = {i: any(w in bad for w in t.split(" ")) for i, t in rows}
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = queries.toxicity_scores(spark, documents(spark, rows), table).collect()
    assert {r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got} == {True}
    held = [r for r in got if r["held_out"]]
    found = [r["predicted"] for r in held if truth[r["doc_id"]]]
    wrong = [r["predicted"] for r in held if not truth[r["doc_id"]]]
    assert np.mean(found) > 0.9 and np.mean(wrong) < 0.03
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_toxicity_learns_from_long_texts(spark):
    dice, known = random.Random(6), vocabulary(3000)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, prose(dice, known, 2000) + (" grumlin voxter" if bad else "")))
        labels.append((i, int(bad)))
    assert min(len(t) for _, t in rows) > 8000
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = [r for r in queries.toxicity_scores(spark, documents(spark, rows), table).collect() if r["held_out"]]
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in got)


@pytest.mark.parametrize("size", [0, 1, 8191, 8192, 100_000, 1 << toxicity.BITS])
def test_sets_of_buckets_come_back(size):
    buckets = np.sort(np.random.default_rng(size).permutation(1 << toxicity.BITS)[:size])
    data = toxicity.packed_set(buckets)
    assert len(data) <= (1 << toxicity.BITS) // 8
    assert (toxicity.unpacked_set(data) == buckets).all()


def test_toxicity_of_odd_rows_and_without_labels(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (None, 1), (5, 0), (6, None)], "doc_id long, toxic int")
    assert queries.toxicity_scores(spark, odd, labels).count() == len(ODD)
    assert queries.toxicity_scores(spark, odd, labels.where("false")).count() == len(ODD)
    assert queries.toxicity_scores(spark, none, labels).count() == 0


def test_the_risk_is_held_at_zero():
    x = toxicity.features(pa.array(["bad thing"] * 30 + ["good thing"] * 60))
    positive = np.arange(90) < 30
    intercept, weights = toxicity.fit(x, positive, 0.3)
    assert np.isfinite(intercept) and np.isfinite(weights).all() and weights.max() > 0


# --- packing --------------------------------------------------------------------------------


def test_packing_gives_each_id_once_in_full_windows(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    dice, known = random.Random(6), vocabulary()
    rows = [*ODD[:10], *ODD[12:], *((100 + i, prose(dice, known, dice.randint(1, 300)) + dice.choice([".", "!?", " 3.5 O'K"])) for i in range(80))]
    got = packing.pack(documents(spark, rows).repartition(7), PATH, window=64).collect()
    want = Counter()
    for i, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        want[i, np.array(ids, "<u4").tobytes()] += 1
    by_place = sorted(got, key=lambda r: (r["sequence_id"], r["offset"]))
    at, parts, have = 0, b"", Counter()
    for r in by_place:
        assert r["sequence_id"] * 64 + r["offset"] == at and r["offset"] + r["length"] <= 64
        assert len(r["ids"]) == 4 * r["length"] and r["start"] * 4 == len(parts) and r["begins"] == (not parts)
        at, parts = at + r["length"], parts + r["ids"]
        assert r["ends"] == (r["start"] + r["length"] == r["doc_tokens"])
        if r["ends"]:
            have[r["doc_id"], parts], parts = have[r["doc_id"], parts] + 1, b""
    assert have == want and parts == b""


def test_ids_of_words_are_those_of_whole_texts():
    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH)
    dice = random.Random(11)
    letters = "aeéÉèñÑüÜßöçÇæœŒİıſŁřžZA'.,!?-09\u0301\u00a0\u2003ΣσςДя中文\u200b|<>"
    texts = ["".join(dice.choice(letters) for _ in range(dice.randint(1, 12))) for _ in range(3000)]
    texts += ["réeuxment, Eauê. ÉCOLE l'été d'Été ÇA", "<|startoftext|>x<|endoftext|>", "ΟΔΟΣ İstanbul", "it's we're I'M ''s"]
    text = " ".join(texts)
    assert np.frombuffer(words.text(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_packing_of_nothing_and_a_full_cache(spark, none):
    assert packing.pack(none, PATH).count() == 0
    small = packing.WordTokenizer(PATH, cache_bytes=2000)
    large = packing.WordTokenizer(PATH)
    text = " ".join(vocabulary(300))
    assert small.text(text) == large.text(text) == small.text(text)


def test_words_with_punctuation_are_put_together_and_take_no_memory():
    words = packing.WordTokenizer(PATH)
    dice, known = random.Random(13), vocabulary(300)
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    tails = ["".join(dice.choice(marks) for _ in range(dice.randint(1, 3))) for _ in range(400)]
    text = " ".join(dice.choice([str, str.upper, str.title])(dice.choice([*known, "é", "Été", "œuvre", "x1", "İ"])) + t for t in tails)
    assert words.text(text) == np.array(words.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert not [w for w in map(bytes, words.known) if w[:-1].isalpha() and w[-1:] in b"!,.;"]


def test_words_still_met_are_kept_when_others_are_forgotten():
    words = packing.WordTokenizer(PATH, cache_bytes=40000)
    used, often = 0, [w.encode() for w in vocabulary(20)]
    for w in vocabulary(2000):
        words.text(" ".join([w, *[o.decode() for o in often]]))
        used = max(used, sum(130 + len(k) + len(v) for part in (words.known, words.older) for k, v in part.items()))
        assert all(o in words.known or o in words.older for o in often)
    assert 20000 < used <= 40000


# --- joins by shingles ----------------------------------------------------------------------


def brute_components(rows):
    sets = [plain_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        groups[find(i)].append(key)
    low = {g: min((k for k in keys if k is not None), default=None) for g, keys in groups.items()}
    return sorted(((key, len(sets[i]), low[find(i)]) for i, (key, _) in enumerate(rows)), key=repr)


def components_of(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("small, tile", [(12, 2048), (2, 8)])
def test_jaccard_components_are_those_of_all_pairs(spark, corpus, small, tile):
    links = jaccard.node_links(documents(spark, corpus).repartition(5), small=small, tile=tile)
    assert components_of(jaccard.membership(*links)) == brute_components(corpus)


def test_tiles_that_neighbours_join_do_not_meet(spark):
    dice, known = random.Random(21), vocabulary()
    first, second = (prose(dice, known, 200) for _ in range(2))
    rows = list(enumerate(edited(dice, known, dice.choice([first] * 9 + [second]), 0.005) for _ in range(150)))
    docs = documents(spark, rows)
    got = jaccard.membership(*jaccard.node_links(docs, small=2, tile=8))
    assert components_of(got) == brute_components(rows)
    tiles = spark.createDataFrame([(7, t, 10 * t + k, 5) for t in range(6) for k in range(3)], "shingle long, tile int, node long, n int")
    clusters = spark.createDataFrame([(10 * t + k, 0 if t < 5 else 50) for t in range(6) for k in range(3)], "node long, cluster long")
    far = jaccard._tile_pairs(tiles).where("j - i > 1")
    assert {(r["i"], r["j"]) for r in jaccard._mixed(tiles, far, clusters).collect()} == {(i, 5) for i in range(4)}
    assert jaccard._mixed(tiles, far, clusters.where("cluster < 0")).count() == far.count() == 10


def test_far_tiles_with_a_cover_meet_again(spark, monkeypatch):
    # Two clusters just under the threshold: far tiles keep a star cover of them, so no pair of theirs is settled before the last round.
    name = (f"w{k}" for k in range(10_000))
    words = lambda n: list(itertools.islice(name, n))
    core, left, right = words(754), words(95), words(150)
    texts = [core[20 + t :] + left for t in range(8)] + [left + core[: -20 - t] for t in range(8)]
    texts += [core + left + words(12) for _ in range(56)]
    texts += [words(12) + right + core for _ in range(24)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    meet, last = jaccard._meet, []

    def watched(tiles, meetings, nodes, cover):
        if not cover:
            last.extend(r["j"] - r["i"] for r in meetings.collect())
        return meet(tiles, meetings, nodes, cover)

    monkeypatch.setattr(jaccard, "_meet", watched)
    got = jaccard.membership(*jaccard.node_links(documents(spark, rows), small=2, tile=24))
    assert components_of(got) == brute_components(rows)
    assert max(last) > 1


def test_jaccard_of_odd_rows(spark, odd, none):
    assert components_of(jaccard.join(odd)) == brute_components(ODD)
    assert jaccard.join(none).count() == 0


def _run(steps, rows, names, kinds, size):
    """Drive a generator of batches without Spark; rows in batches of ``size``."""
    batches = [
        pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + size], strict=True), kinds, strict=True)], names)
        for i in range(0, len(rows), size)
    ]
    return [r for b in steps(iter(batches)) for r in b.to_pylist()]


def test_groups_lose_no_pair_whatever_the_batches():
    dice = random.Random(9)
    rows = [(t, dice.randrange(60), 0) for t in range(12) for _ in range(dice.choice([1, 2, 3, 5, 9, 23]))]
    rows = sorted({(t, node, 10 + node % 3) for t, node, _ in rows}, key=lambda r: (r[0], r[2], r[1]))
    rows = sorted([*rows, *dice.sample(rows, 9)], key=lambda r: (r[0], r[2], r[1]))
    want = {(min(a, b), max(a, b)) for t, a, n in rows for u, b, m in rows if t == u and a != b and 100 * min(n, m) >= 75 * max(n, m)}
    for size in (3, 7, 1000):
        out = _run(jaccard._grouped(3, 4), rows, ["shingle", "node", "n"], [pa.int64(), pa.int64(), pa.int32()], size)
        pairs = {(r["a"], r["b"]) for r in out if r["a"] is not None}
        tiles = defaultdict(set)
        for r in out:
            if r["node"] is not None:
                tiles[r["shingle"]].add(r["node"])
                assert sum(x["shingle"] == r["shingle"] and x["tile"] == r["tile"] for x in out) <= 5
        pairs |= {(min(a, b), max(a, b)) for nodes in tiles.values() for a in nodes for b in nodes if a != b}
        assert want <= pairs


def test_bitmaps_bound_the_overlap_and_fold():
    dice = np.random.default_rng(1)
    for n, m, same in ((5, 6, 5), (40, 50, 38), (300, 290, 270), (1000, 900, 880), (64, 64, 0)):
        a = np.unique(dice.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.r_[a[:same], dice.integers(0, 1 << 63, m - same).astype(np.uint64)])
        x, y = jaccard.bitmap(a)[None], jaccard.bitmap(b)[None]
        width = min(x.shape[1], y.shape[1])
        differ = int(np.bitwise_count(jaccard.fold(x, width) ^ jaccard.fold(y, width)).sum())
        assert differ <= len(np.setxor1d(a, b))
        i, _ = jaccard.passing([x.tobytes(), y.tobytes()], np.array([len(a), len(b)]), None, None)
        assert len(i) == 1 if jaccard.linked(a, b) else True


def test_a_star_cover_reaches_every_node_of_a_dense_tile():
    i, j = np.triu_indices(30, 1)
    kept = jaccard.star_cover(i, j, 30)
    assert kept.sum() == 29
    hub = np.array([0] * 29), np.arange(1, 30)
    assert jaccard.star_cover(*hub, 30).all()


# --- decontamination ------------------------------------------------------------------------


def brute_contained(rows, items):
    out = []
    for i, t in rows:
        for k, u in items:
            words = plain_words(u)
            size = min(5, len(words))
            if not size:
                continue
            own, have = plain_shingles(u, size), {tuple(w) for w in zip(*[plain_words(t)[j:] for j in range(size)], strict=False)}
            if 100 * len(own & have) >= 75 * len(own):
                out.append((i, k, len(own), len(own & have)))
    return sorted(out)


def test_contained_items_are_those_of_all_pairs(spark):
    dice, known = random.Random(8), vocabulary()
    items = [(k, prose(dice, known, dice.randint(5, 40))) for k in range(25)]
    items += [(90, "tiny item"), (91, "word"), (92, ""), (93, None), (94, items[0][1].upper()), (95, "a b c d e"), (95, "a b c d e")]
    rows = [(i, prose(dice, known, dice.randint(0, 200))) for i in range(120)]
    for i in range(0, 60, 2):
        item = edited(dice, known, items[dice.randrange(25)][1], dice.choice([0, 0.03, 0.08]))
        rows[i] = (i, f"{rows[i][1]} {item} {prose(dice, known, 10)}")
    rows += [(200, "see the Tiny\nItem there"), (201, "WORD"), (202, None), (203, "x a b c d e y"), (203, "x a b c d e y")]
    got = decontaminate.contained(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    want = brute_contained(rows, [x for x in items if x[0] != 95] + [(95, "a b c d e")])
    assert sorted(tuple(r) for r in got.select("doc_id", "item_id", "n_shingles", "n_shared").collect()) == sorted(set(want))


def test_null_and_shared_ids_lose_no_passage(spark):
    dice, known = random.Random(10), vocabulary()
    one, two, three = (prose(dice, known, 30) for _ in range(3))
    items = spark.createDataFrame([(None, one), (None, two), (7, two), (7, three)], "item_id long, text string")
    rows = [(1, f"a {one} b"), (None, f"c {two} d"), (None, f"e {three}"), (2, prose(dice, known, 40)), (3, f"{three} f"), (3, f"g {one}")]
    docs = documents(spark, rows)
    got = [tuple(r) for r in decontaminate.contained(docs, items).select("doc_id", "item_id").collect()]
    want = [(1, None), (None, None), (None, 7), (None, 7), (3, 7), (3, None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert [r["doc_id"] for r in decontaminate.clean(docs, items).collect()] == [2]


def test_decontamination_of_nothing_and_by_nothing(spark, odd, none):
    items = spark.createDataFrame([(1, "same text here in two rows of a table")], "item_id long, text string")
    assert decontaminate.contained(none, items).count() == 0
    assert decontaminate.contained(odd, items.where("false")).count() == 0
    left = decontaminate.clean(odd, items)
    assert left.columns == odd.columns and left.count() == len(ODD) - 3


# --- language model -------------------------------------------------------------------------


def test_scores_and_the_base_of_all_texts(spark):
    dice, known = random.Random(4), vocabulary(900)
    rows = [(i, prose(dice, known[: 50 + i], dice.randint(1, 120))) for i in range(300)] + ODD
    got = mixing.score(documents(spark, rows).repartition(3), toxicity.crc_of_id() % 7 == 2).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in rows if not held(i) for w in [*plain_words(t), "<end> "])
    total, distinct = sum(count.values()), len(count)
    want = Counter()
    for i, t in rows:
        tokens = [*plain_words(t), "<end> "]
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in tokens)
        want[i, held(i), len(tokens), sum(count[w] > 0 for w in tokens), total, round(base, 4)] += 1
    have = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got)
    assert have == want
    assert all(r["score"] < 0 for r in got)
    out = [r for r in got if r["held_out"] and r["doc_id"] > 20]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_distinct_hashes_are_those_of_numpy(monkeypatch):
    dice = np.random.default_rng(3)
    far = dice.integers(0, 1 << 63, 3000, dtype=np.uint64)
    cases = [far[dice.integers(0, 3000, 20000)], far[:0], far[:1], np.full(7, (1 << 64) - 1, np.uint64), np.arange(9, 0, -1).astype(np.uint64)]
    near = far[dice.integers(0, 1000, 5000)] ^ dice.integers(0, 4, 5000, dtype=np.uint64)  # alike but for the last bits
    for hashes in [*cases, near]:
        want = np.unique(hashes, return_index=True, return_inverse=True)
        assert all((a == b).all() for a, b in zip(mixing.distinct(hashes), want, strict=True))
    places_sorted = []
    monkeypatch.setattr(np, "argsort", lambda *a, **k: places_sorted.append(a))
    mixing.distinct(cases[0])  # numbers are sorted, not places by them
    assert not places_sorted


def test_word_probabilities_of_a_bucket_sum_to_at_most_one():
    known = sorted(set(vocabulary(300)))
    texts = pa.array([" ".join(known), " ".join(known[:100]), "aab aabc aabd aabbb " * 5])
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), texts, pa.array([False] * 3)], ["doc_id", "text", "held"])
    centres = np.zeros((mixing.CLASSES, 1 << mixing.CLASS_BITS))
    rows = [r for b in mixing._chunked(1, 1, centres)(iter([batch])) for r in b.to_pylist()]
    bucket = mixing.Bucket([(r["chunk"], r["size"], r["payload"]) for r in rows if r["bucket"] is not None])
    tables = [np.zeros(2 << b, np.uint32) for b in mixing.TABLE_BITS]
    mixing._add_types(bucket, tables)
    totals = bucket.by_class.sum(0) + np.array([3, 0, 0, 0])
    bits = mixing.costs(bucket, [t.astype(np.float32) for t in tables], totals)
    assert 0.3 < (2.0 ** -bits[:, 0]).sum() <= 1


def test_long_words_are_priced_to_their_last_byte():
    long = "ab" * 300
    texts = pa.array([" ".join([long + "x", long + "y", long, "abc abd"])] * 3)
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), texts, pa.array([False] * 3)], ["doc_id", "text", "held"])
    rows = [r for b in mixing._chunked(1, 1, np.zeros((mixing.CLASSES, 1 << mixing.CLASS_BITS)))(iter([batch])) for r in b.to_pylist()]
    bucket = mixing.Bucket([(r["chunk"], r["size"], r["payload"]) for r in rows if r["bucket"] is not None])
    tables = [np.zeros(2 << b, np.uint32) for b in mixing.TABLE_BITS]
    mixing._add_types(bucket, tables)
    bits = mixing.costs(bucket, [t.astype(np.float32) for t in tables], bucket.by_class.sum(0) + np.array([3, 0, 0, 0]))[:, 0]
    assert (bits > 0).all() and bits[bucket.lengths > 500].max() < 601  # under a bit a byte
    assert (2.0**-bits).sum() <= 1


def test_scores_without_rows_or_without_training(spark, none):
    assert mixing.score(none, F.lit(True)).count() == 0
    rows = mixing.score(documents(spark, ODD), F.lit(True)).collect()
    assert len(rows) == len(ODD) and {r["train_tokens"] for r in rows} == {0} and {r["base_score"] for r in rows} == {0.0}


def test_word_order_counts_in_scores(spark):
    dice, known = random.Random(6), vocabulary(60)
    follows = {w: dice.sample(known, 2) for w in known}

    def walk(n):
        out = [dice.choice(known)]
        while len(out) < n:
            out.append(dice.choice(follows[out[-1]]))
        return out

    rows = [(i, " ".join(walk(60))) for i in range(200)]
    held = walk(60)
    rows += [(1000, " ".join(held)), (1001, " ".join(dice.sample(held, len(held))))]
    got = {r["doc_id"]: r["score"] for r in mixing.score(documents(spark, rows).repartition(3), F.col("doc_id") >= 1000).collect()}
    assert got[1000] > 0.6 * got[1001]
    again = {r["doc_id"]: r["score"] for r in mixing.score(documents(spark, rows).repartition(7), F.col("doc_id") >= 1000).collect()}
    assert all(abs(got[k] - again[k]) < 1e-3 for k in got)


def test_trust_in_pairs_is_the_likeliest_share():
    ratio, times = np.array([mixing.RATIO_LEAST, 8, -4]), np.array([30.0, 50.0, 20.0])
    r = np.array([0.0, 4.0, 0.5])
    grid = np.linspace(0, 0.999, 1000)
    best = grid[np.argmax([(times * np.log(1 - x + x * r)).sum() for x in grid])]
    assert abs(mixing.trust_of(ratio, times) - best) < 2e-3


# --- sharding -------------------------------------------------------------------------------


def plain_shard(key, shards):
    draw = lambda s: int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16)
    return max(range(shards), key=lambda s: (draw(s), -s))


def test_shards_places_and_growth(spark):
    rows = [(i, f"text {i}") for i in range(500)] + ODD
    df = documents(spark, rows).withColumn("size", F.length("text"))
    got = sharding.place(sharding.assign(df, "doc_id", [1.0] * 24, extra=[1.0]), "doc_id", ["text"]).collect()
    slots = defaultdict(list)
    for r in got:
        key = "null" if r["doc_id"] is None else r["doc_id"]
        assert r["shard"] == plain_shard(key, 24) and r["grown_shard"] in (r["shard"], 24)
        assert r["grown_shard"] == plain_shard(key, 25)
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_give_shares_and_zero_gives_nothing(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    count = {r["shard"]: r["count"] for r in sharding.assign(df, "doc_id", [1.0, 3.0, 0.0]).groupBy("shard").count().collect()}
    assert set(count) == {0, 1} and 0.23 < count[0] / 20_000 < 0.27
    with pytest.raises(ValueError, match="weight"):
        sharding.assign(df, "doc_id", [0.0])


# --- exact copies ---------------------------------------------------------------------------


def brute_copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for text, ids in groups.items():
        most = max((i for i in ids if i is not None), default=None)
        digest, first = hashlib.sha256(text.encode()).hexdigest(), True
        for i in sorted(ids, key=repr):
            out.append((i, most, len(ids), i == most and first, digest))
            first = first and i != most
    return sorted(out, key=repr)


@pytest.mark.parametrize("table, bucket", [(1 << 24, 1 << 26), (3000, 4000)])
def test_copies_are_those_of_a_dictionary(spark, corpus, table, bucket):
    rows = [*corpus, *((1000 + i, "hot text " * 20) for i in range(200)), *ODD]
    got = exact.deduplicate(documents(spark, rows).repartition(6), table_bytes=table, bucket_bytes=bucket)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_copies(rows)


def test_tables_settle_equal_hashes_by_content():
    table = exact.ContentTable()
    texts = [f"text {i % 700}".encode() for i in range(3000)]
    assert [table.place(5 if i % 700 < 5 else hash(t) & 0xFFFF, t) for i, t in enumerate(texts)] == [i % 700 for i in range(3000)]


def test_keep_one_keeps_a_row_of_each_text(spark, odd, none):
    left = exact.keep_one(odd)
    assert left.columns == odd.columns
    assert sorted(t or "" for t, in left.select("text").collect()) == sorted({t or "" for _, t in ODD})
    assert exact.keep_one(none).count() == 0


def test_helper_columns_have_names_that_the_table_has_not(spark):
    rows = [(1, "a b c d e f", 5, "x"), (2, "a b c d e f", 6, "y"), (3, "some other words stand here now", 7, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, code_ int, OWN_ string")
    items = spark.createDataFrame([(1, "words stand here now")], "item_id long, text string")
    for left, ids in ((exact.keep_one(docs), [2, 3]), (jaccard.thin(docs), [1, 3]), (decontaminate.clean(docs, items), [1, 2])):
        assert left.columns == docs.columns
        assert sorted(map(tuple, left.collect())) == [rows[i - 1] for i in ids]


# --- tokenizers of other kinds, and letters that normal forms change ------------------------


def test_letters_before_full_stops_have_the_tokenizers_ids():
    words_of = packing.WordTokenizer(PATH)
    letters = [chr(c) for c in range(0x41, 0x3000) if chr(c).isalpha()]
    text = " ".join(f"{c}. a{c}b, {c}" for c in letters)
    assert words_of.by_words
    assert words_of.text(text) == np.array(words_of.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_other_tokenizers_give_their_own_ids():
    import os

    folder = os.path.dirname(PATH)
    tried = 0
    texts = ["Hello world, it's  me.", " lead \u4e2d\u6587\nnext", "a b c."]
    for name in sorted(os.listdir(folder)):
        if name.endswith(".json") and "bpe" in name or "unigram" in name and name.endswith(".json"):
            try:
                one = packing.WordTokenizer(os.path.join(folder, name))
            except Exception:  # another kind of file
                continue
            tried += 1
            for t in texts:
                assert one.text(t) == np.array(one.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), name
    assert tried >= 2


# --- language-model scores: what they may depend on ------------------------------------------


def lm_corpus():
    dice, known = random.Random(21), vocabulary()
    return [(i, prose(dice, known if i % 2 else known[:50], dice.randint(3, 60))) for i in range(240)]


def lm_scores(df):
    return {r.doc_id: (r.score, r.base_score) for r in mixing.score(df, toxicity.crc_of_id() % 7 == 2).collect()}


def test_held_out_texts_move_no_other_score(spark):
    rows = lm_corpus()
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    other = [(i, "quite other words of an other tongue " * 3 if i in held else t) for i, t in rows]
    a, b = lm_scores(documents(spark, rows)), lm_scores(documents(spark, other))
    assert len(held) > 20 and all(a[i] == pytest.approx(b[i], rel=1e-12) for i, _ in rows if i not in held)


def test_scores_do_not_depend_on_the_number_of_partitions(spark):
    rows, before = documents(spark, lm_corpus()).cache(), spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("2", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(lm_scores(rows))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(found[0][i] == pytest.approx(found[1][i], rel=1e-6) for i in found[0])


def test_classes_see_every_text(spark):
    # Four languages; the texts of the fourth are not among the first 2,000 by hash.
    dice = random.Random(8)
    short = [[f"{a}{b}" for b in "abcdefghij"] for a in "pqrs"]
    texts = [" ".join(dice.choices(short[k % 3], k=12)) for k in range(4500)]
    coded = spark.createDataFrame([(" ".join(dice.choices(short[3], k=12)),) for _ in range(500)], "text string")
    texts += [r["text"] for r in coded.where(F.xxhash64("text") > 0).collect()]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    centres = mixing.centres_of(docs.repartition(3))
    part = next(iter(words(pa.array([" ".join(s * 3) for s in short]))))
    assert len(set(mixing.class_of(mixing.short_words(part), centres))) == 4
    assert (centres == mixing.centres_of(docs.repartition(5))).all()


def test_lm_gives_back_the_disk_of_words_and_pairs_that_met(spark):
    folder = Path(shared_folder(spark).removeprefix("file://"))
    earlier = set(folder.glob("counted-*"))
    rows = [(i, f"some words of text {i} and more of them {i % 7}") for i in range(40)]
    scored = mixing.score(documents(spark, rows), F.col("doc_id") >= 30)
    (counted,) = set(folder.glob("counted-*")) - earlier
    left = spark.read.schema(mixing.COUNTED).parquet(str(counted))
    assert left.where("bucket is not null or part >= 0").isEmpty()
    assert left.where("bucket is null and part is null").count() == scored.count() == 40
