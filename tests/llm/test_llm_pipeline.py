"""The pipeline's stages and its whole against brute force."""

import random
import zlib

import pytest
from llm_data import ODD, edited, plain_shingles, prose, vocabulary
from test_llm_documents import brute_components, brute_contained

import corpus_pipeline as pipeline
from seriesloom.llm import queries, toxicity

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with toxic ones, copies, near copies, benchmark passages and odd rows."""
    dice, known = random.Random(12), vocabulary()
    bad = ["grumlin", "voxter", "snarp", "dreck"]
    items = [(k, prose(dice, known, dice.randint(8, 40))) for k in range(12)]
    rows, labels = [], []
    for i in range(100, 500):
        toxic = dice.random() < 0.15
        words = prose(dice, known, dice.randint(8, 80)).split(" ")
        for _ in range(4 if toxic else 0):
            words[dice.randrange(len(words))] = dice.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(toxic)))
    clean = [t for (_, t), (*_, toxic) in zip(rows, labels, strict=True) if not toxic]
    rows += [(600 + i, t) for i, t in enumerate(clean[:20])]
    rows += [(700 + i, edited(dice, known, t, 0.02)) for i, t in enumerate(clean[:60])]
    rows += [(800 + k, f"{prose(dice, known, 30)} {t} {prose(dice, known, 5)}") for k, t in items]
    rows += [*ODD, (50, "same text here in two rows of a table")]
    dice.shuffle(rows)
    path = tmp_path_factory.mktemp("corpus")
    table = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(table, DOCUMENTS).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}", rows, items


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=repr)


def copies_gone(rows):
    """Of each text the row with the largest id; NULL and empty texts are equal."""
    best = {}
    for i, t in rows:
        key = t or ""
        if key not in best or (i is not None and (best[key][0] is None or i > best[key][0])):
            best[key] = (i, t)
    return list(best.values())


def test_stages_against_brute_force(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    labels = queries.table(spark, path, "labels", "doc_id", "toxic")

    got = pipeline.toxic_out(spark, docs, path)
    assert got.columns == docs.columns
    scored = queries.toxicity_scores(spark, docs, labels)
    bad = {t for (t,) in docs.join(scored.where("predicted = 1"), "doc_id").select("text").collect()}
    assert pairs(got) == sorted(((i, t) for i, t in rows if t not in bad), key=repr)
    assert len(bad) > 20 and len(got.collect()) > 400

    got = pipeline.copies_out(spark, docs, path)
    assert got.columns == docs.columns
    left = copies_gone(rows)
    assert [(i, t or "") for i, t in pairs(got)] == sorted(((i, t or "") for i, t in left), key=repr)

    got = pipeline.near_copies_out(spark, docs, path)
    assert got.columns == docs.columns
    low = {}
    for (i, t), (_, _, component) in zip(sorted(rows, key=repr), _in_order(rows), strict=True):
        low[i, t] = component
    want = [(i, t) for i, t in rows if low[i, t] is None or i == low[i, t]]
    assert pairs(got) == sorted(want, key=repr) and len(want) < len(rows) - 50

    got = pipeline.benchmark_out(spark, docs, path)
    assert got.columns == docs.columns
    hit = {k[0] for k in brute_contained([(i, t) for i, (_, t) in enumerate(rows)], items)}
    assert pairs(got) == sorted(((i, t) for k, (i, t) in enumerate(rows) if k not in hit), key=repr)
    assert len(hit) >= len(items)


def _in_order(rows):
    """Brute-force components, in the order of the sorted rows."""
    ordered = sorted(rows, key=repr)
    marked = brute_components([(k, t) for k, (_, t) in enumerate(ordered)])
    groups = {}
    for k, _, first in marked:
        groups.setdefault(first, []).append(k)
    low = {}
    for members in groups.values():
        ids = [ordered[k][0] for k in members if ordered[k][0] is not None]
        for k in members:
            low[k] = min(ids, default=None)
    return [(ordered[k][0], len(plain_shingles(ordered[k][1])), low[k]) for k in range(len(ordered))]


def test_the_whole_leaves_clean_documents_alone(spark, folder):
    path, rows, items = folder
    kept = {r["doc_id"] for r in pipeline.run(spark, path).select("doc_id").collect()}
    contaminated = {800 + k for k, _ in items}
    assert not kept & contaminated
    assert len({i for i in kept if i is not None and 100 <= i < 500}) > 250
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "decontamination", "packing"]


def test_stages_of_empty_tables(spark, folder, tmp_path):
    path, _, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_folds_do_not_leak_labels(spark):
    """Labels of held-out rows change no score."""
    dice, known = random.Random(3), vocabulary()
    rows = [(i, prose(dice, known, 20) + (" grumlin" if i % 7 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    first = [(i, int(i % 7 == 0)) for i, _ in rows]
    second = [(i, 1 - t if held(i) else t) for i, t in first]
    scores = [
        {r["doc_id"]: r["score"] for r in queries.toxicity_scores(spark, docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()}
        for x in (first, second)
    ]
    assert scores[0] == scores[1] and toxicity.THRESHOLD == 0.3
