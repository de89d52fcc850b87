"""The registered queries of the training-data operators, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import decontaminate, exact, jaccard, licences, mixing, packing, periodic, resampling, sharding, toxicity, urls, warc, wrappers
from seriesloom.session import use_utc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

SHARDS = 24

# The url rules (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{folder}/{name}.parquet").select(*columns)


def tokenizer_path() -> str:
    """The tokenizer file of the packing query; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def toxicity_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of ``docs``, learnt outside the held-out fold."""
    fold = F.coalesce(toxicity.crc_of_id() % 4, F.lit(0))
    scorers = toxicity.train(docs, labels, fold != 2)
    scored = toxicity.score(docs, scorers)
    return scored.select(
        "doc_id",
        (fold == 2).alias("held_out"),
        "score",
        F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


@query
def op1_toxicity(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")
    return toxicity_scores(spark, docs, table(spark, folder, "labels", "doc_id", "toxic"))


def pieces(docs: DataFrame) -> DataFrame:
    """The pieces of ``docs`` with a digest of their ids instead of the ids."""
    packed = packing.pack(docs, tokenizer_path())
    return packed.select(
        "doc_id",
        F.col("start").cast("long").alias("start"),
        F.col("length").cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        F.col("sequence_id").cast("long").alias("sequence_id"),
        F.col("offset").cast("long").alias("offset"),
        "begins",
        "ends",
    )


@query
def op2_packing(spark, folder):
    return pieces(table(spark, folder, "documents", "doc_id", "text"))


@query
def op3_ngram_jaccard(spark, folder):
    found = jaccard.join(table(spark, folder, "documents", "doc_id", "text"))
    return found.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")


@query
def op4_warc(spark, folder):
    pages = table(spark, folder, "pages", "page_id", "url", "html")
    files = warc.write_archives(pages, warc.archive_folder(pages))
    records = warc.read_archives(files, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op5_decontamination(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")
    return decontaminate.contained(docs, table(spark, folder, "benchmark", "item_id", "text"))


@query
def op6_lm_scoring(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")
    return mixing.score(docs, toxicity.crc_of_id() % 7 == 2)


@query
def op7_sharding(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    dealt = sharding.assign(rows, "doc_id", [1.0] * SHARDS, extra=[1.0])
    placed = sharding.place(dealt, "doc_id", ["text_crc32", "size"])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        "grown_shard",
    )


@query
def op8_url_filters(spark, folder):
    pages = table(spark, folder, "pages", "page_id", "url", "html")
    edges = urls.link_edges(pages)
    rules = urls.rule_table(pages, RULES)
    judged = urls.judge(pages.select("page_id", "url"), rules, edges)
    return judged.select("page_id", "host", "path", "rule", "verdict", "component")


@query
def op9_exact_dedup(spark, folder):
    return exact.deduplicate(table(spark, folder, "documents", "doc_id", "text"))


@query
def op10_html_extraction(spark, folder):
    pages = table(spark, folder, "pages", "page_id", "url", "html")
    return wrappers.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


@query
def op11_license_scans(spark, folder):
    found = licences.scan(table(spark, folder, "documents", "doc_id", "text"))
    starts = F.transform("phrases", lambda p: p["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        licences.label_list(F.col("phrases")).alias("base_labels"),
        licences.label_list(F.col("phrases"), F.col("notices")).alias("labels"),
        licences.licence_score(F.col("phrases"), F.col("notices")).alias("score"),
    )


@query
def op12_periodic_runs(spark, folder):
    docs = periodic.with_periodic_tail(table(spark, folder, "documents", "doc_id", "text"))
    found = periodic.find_runs(docs).withColumn("longest", periodic.longest_run(F.col("runs")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "longest.start",
        "longest.length",
        "longest.period",
        F.floor(F.col("longest.length") * 1000 / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(periodic.run_lines(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op13_importance_resampling(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")
    drawn = resampling.resample(docs, table(spark, folder, "benchmark", "text"))
    return drawn.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


# --- the same in SQL ------------------------------------------------------------------------

_WORDS = r"""
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')
"""
_RUNS = """
    CASE WHEN len(words) >= 5
         THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))
         WHEN len(words) > 0 THEN [array_to_string(words, ' ')]
         ELSE [] END
"""

ORACLE["op3_ngram_jaccard"] = f"""
WITH RECURSIVE texts AS (SELECT doc_id, {_WORDS} AS words FROM documents),
sets AS MATERIALIZED (SELECT doc_id, {_RUNS} AS runs FROM texts),
shingles AS (SELECT doc_id, unnest(runs) AS run FROM sets),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
    FROM shingles a JOIN shingles b ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY ALL
),
links AS MATERIALIZED (
    SELECT a, b FROM common
    JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
    WHERE 100 * shared >= 75 * (len(x.runs) + len(y.runs) - shared)
),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
    SELECT doc_id AS node, doc_id AS seen FROM documents
    UNION
    SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen
)
SELECT doc_id, CAST(len(runs) AS BIGINT) AS n_shingles, min(seen) AS component_id
FROM sets JOIN reach ON node = doc_id GROUP BY doc_id, runs
"""

ORACLE["op4_warc"] = """
WITH bodies AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
known AS (SELECT page_id, octet_length(body) AS size, sha1(body) AS digest FROM bodies),
marked AS (SELECT *, max(page_id) OVER (PARTITION BY digest, size) AS last FROM known)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
    CASE WHEN size >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN size >= 1000 AND page_id <> last THEN last END AS refers_to
FROM marked
"""

ORACLE["op5_decontamination"] = f"""
WITH doc_words AS MATERIALIZED (SELECT doc_id, {_WORDS} AS words FROM documents),
item_words AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
sized AS (SELECT *, least(len(words), 5) AS size FROM item_words WHERE len(words) > 0),
item_runs AS MATERIALIZED (
    SELECT item_id, size, unnest(list_distinct(list_transform(range(1, len(words) - size + 2),
        lambda i: array_to_string(words[i:i + size - 1], ' ')))) AS run
    FROM sized
),
sizes AS (SELECT DISTINCT size FROM sized),
doc_runs AS (
    SELECT doc_id, size, unnest(list_distinct(list_transform(range(1, len(words) - size + 2),
        lambda i: array_to_string(words[i:i + size - 1], ' ')))) AS run
    FROM doc_words, sizes WHERE len(words) >= size
),
totals AS (SELECT item_id, count(*) AS n_shingles FROM item_runs GROUP BY item_id),
shared AS (
    SELECT doc_id, item_id, count(*) AS n_shared
    FROM doc_runs JOIN item_runs USING (size, run) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, CAST(n_shingles AS INTEGER) AS n_shingles, n_shared
FROM shared JOIN totals USING (item_id) WHERE n_shared >= ceil(0.75 * n_shingles)
"""

ORACLE["op9_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
# The test tables hold no canonical links and no redirects, so every url stands alone.
ORACLE["op8_url_filters"] = rf"""
WITH rules(verdict, host, path) AS (VALUES {_RULE_ROWS}),
rest AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
    FROM rest
),
fits AS (
    SELECT page_id, r.verdict, r.host || r.path AS rule,
        row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS place
    FROM parts p JOIN rules r
        ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict, CAST(NULL AS VARCHAR) AS component
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.place = 1
"""

# Fixed value: 3988292384 is the reversed polynomial of CRC-32.
ORACLE["op7_sharding"] = """
WITH RECURSIVE bits(n, k, c) AS (
    SELECT n, 0, n FROM (SELECT unnest(range(256)) AS n)
    UNION ALL
    SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
bodies AS (SELECT doc_id, encode(coalesce(text, '')) AS body FROM documents),
sized AS (
    SELECT doc_id, CAST(octet_length(body) + 8 AS BIGINT) AS size,
        xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
            list_transform(regexp_extract_all(hex(body), '..'), lambda x: ('0x' || x)::BIGINT)),
            lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS text_crc32
    FROM bodies, crc_table
),
draws AS (
    SELECT doc_id, s, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || s), 1, 13))::BIGINT AS draw
    FROM documents, (SELECT unnest(range(25)) AS s)
),
won AS (
    SELECT doc_id, arg_max(s, draw) FILTER (WHERE s < 24) AS shard, arg_max(s, draw) AS grown_shard FROM draws GROUP BY doc_id
)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY substr(md5('slot:' || coalesce(doc_id::VARCHAR, 'null')), 1, 3), doc_id) - 1 AS slot,
    CAST(grown_shard AS INTEGER) AS grown_shard
FROM sized JOIN won USING (doc_id)
"""

_ALNUM_WORDS = r"""
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')
"""
_KEYS = [(n, k, licences.key_place(text, key), key) for n, (_, text, keys) in enumerate(licences.NOTICES) for k, key in enumerate(keys)]
_BASE_ROWS = ", ".join(f"(-1, {n}, 0, '{phrase}')" for n, (phrase, _) in enumerate(licences.PHRASES))
_KEY_ROWS = ", ".join(f"({n}, {k}, {at}, '{key}')" for n, k, at, key in _KEYS)
_NOTICE_ROWS = ", ".join(f"({n}, '{label}', '{text}')" for n, (label, text, _) in enumerate(licences.NOTICES))
_LABEL_ROWS = ", ".join(f"({n}, '{label}')" for n, (_, label) in enumerate(licences.PHRASES))

ORACLE["op11_license_scans"] = f"""
WITH texts AS MATERIALIZED (SELECT doc_id, {_ALNUM_WORDS} AS words FROM documents),
keys(notice, k, place, phrase) AS (VALUES {_BASE_ROWS}, {_KEY_ROWS}),
notices(notice, label, phrase) AS (VALUES {_NOTICE_ROWS}),
labels(k, label) AS (VALUES {_LABEL_ROWS}),
rows AS MATERIALIZED (SELECT doc_id, unnest(range(len(words))) AS i, unnest(words) AS w FROM texts),
split AS (SELECT *, string_split(phrase, ' ') AS parts FROM keys),
places AS MATERIALIZED (
    SELECT notice, k, place, doc_id, i FROM rows JOIN split ON w = parts[1] JOIN texts USING (doc_id)
    WHERE words[i + 1:i + len(parts)] = parts
),
spelt AS (SELECT notice, label, unnest(range(len(string_split(phrase, ' ')))) AS j, unnest(string_split(phrase, ' ')) AS w FROM notices),
known AS (SELECT w, count(DISTINCT doc_id) AS n FROM rows GROUP BY w),
weighted AS (
    SELECT s.*, CAST(floor(1000 * ln(((SELECT count(*) FROM documents) + 1) / (coalesce(n, 0) + 1))) AS BIGINT) + 1 AS weight
    FROM spelt s LEFT JOIN known USING (w)
),
met AS (
    SELECT a.notice, a.doc_id, a.i - a.place AS start
    FROM places a JOIN places b ON a.notice = b.notice AND a.doc_id = b.doc_id AND a.notice >= 0 AND a.k = 0
        AND abs((b.i - b.place) - (a.i - a.place)) <= {licences.SLACK}
        JOIN (SELECT notice, count(*) AS n_keys FROM keys GROUP BY notice) c ON c.notice = a.notice
    GROUP BY a.notice, a.doc_id, a.i, a.place, n_keys HAVING count(DISTINCT b.k) = n_keys
),
agreed AS (
    SELECT m.doc_id, p.label, m.start, m.notice,
        sum(CASE WHEN m.start + p.j >= 0 AND t.words[m.start + p.j + 1] = p.w THEN p.weight ELSE 0 END) / sum(p.weight) AS agreement
    FROM met m JOIN weighted p USING (notice) JOIN texts t ON t.doc_id = m.doc_id GROUP BY m.doc_id, p.label, m.start, m.notice
),
noticed AS (SELECT doc_id, list(label) AS found, max(agreement) AS best FROM agreed GROUP BY doc_id),
based AS (
    SELECT doc_id, count(*) AS n, min(i) AS first, max(i) AS last, list(label) AS found
    FROM places JOIN labels USING (k) WHERE notice = -1 GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, CAST(b.first AS BIGINT) AS first_word,
    CAST(b.last AS BIGINT) AS last_word,
    coalesce(array_to_string(list_sort(list_distinct(b.found)), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.found, []), coalesce(o.found, [])))), ','), '') AS labels,
    CAST(greatest(coalesce(o.best, 0), CASE WHEN b.n > 0 THEN {licences.ALONE} ELSE 0 END) AS DOUBLE) AS score
FROM texts LEFT JOIN based b USING (doc_id) LEFT JOIN noticed o USING (doc_id)
"""

# Fixed value: 3988292384 is the reversed polynomial of CRC-32.
_CRC_TABLE = """
bits(n, k, c) AS (
    SELECT n, 0, n FROM (SELECT unnest(range(256)) AS n)
    UNION ALL
    SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8)
"""


def _crc(text: str) -> str:
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)),
        lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])))"""


ORACLE["op12_periodic_runs"] = rf"""
WITH RECURSIVE {_CRC_TABLE},
split AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
        {_crc("doc_id::VARCHAR")} AS h
    FROM documents, crc_table
),
dealt AS (SELECT *, len(words) AS n, h // 10 AS g FROM split),
tailed AS (
    SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a,
        CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p
    FROM dealt
),
texts AS MATERIALIZED (
    SELECT doc_id, n, list_transform(range(n), lambda i: words[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) AS words
    FROM tailed
),
fives AS MATERIALIZED (
    SELECT doc_id, n, unnest(range(n - 4)) AS i,
        unnest(list_transform(range(n - 4), lambda i: array_to_string(words[i + 1:i + 5], ' '))) AS run
    FROM texts WHERE n >= 6
),
again AS (
    SELECT x.doc_id, x.i, y.i - x.i AS d
    FROM fives x JOIN fives y ON x.doc_id = y.doc_id AND x.run = y.run AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS island FROM again),
stretches AS (SELECT doc_id, d, min(i) AS start, max(i) + 5 - min(i) + d AS length FROM islands GROUP BY doc_id, d, island),
runs AS MATERIALIZED (
    SELECT doc_id, start, length, min(d) AS period FROM stretches
    WHERE length >= greatest(6, 4 * d) GROUP BY doc_id, start, length
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) AS place FROM runs),
listed AS (
    SELECT doc_id, count(*) AS n_runs, list({{'s': start + period, 'e': start + length}}) AS gone,
        string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
    FROM runs GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length,
    CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256,
    sha256(CASE WHEN gone IS NULL THEN array_to_string(words, ' ') ELSE array_to_string(list_transform(
        list_filter(range(n), lambda i: len(list_filter(gone, lambda r: r.s <= i AND i < r.e)) = 0), lambda i: words[i + 1]), ' ') END)
        AS collapsed_sha256
FROM texts t LEFT JOIN listed l ON l.doc_id = t.doc_id LEFT JOIN ranked r ON r.doc_id = t.doc_id AND r.place = 1
"""

ORACLE["op13_importance_resampling"] = f"""
WITH RECURSIVE {_CRC_TABLE},
texts AS MATERIALIZED (SELECT doc_id, {_ALNUM_WORDS} AS words FROM documents),
doc_words AS MATERIALIZED (SELECT doc_id, unnest(words) AS w FROM texts),
item_words AS MATERIALIZED (SELECT unnest({_ALNUM_WORDS}) AS w FROM benchmark),
every AS (SELECT w FROM doc_words UNION SELECT w FROM item_words),
hashed AS MATERIALIZED (SELECT w, {_crc("w")} % 10000 AS bucket FROM every, crc_table),
raw AS (SELECT bucket, count(*) AS s FROM doc_words JOIN hashed USING (w) GROUP BY bucket),
wanted AS (SELECT bucket, count(*) AS t FROM item_words JOIN hashed USING (w) GROUP BY bucket),
gains AS (
    SELECT b AS bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM doc_words) + 10000)::DOUBLE
        / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM item_words) + 10000)::DOUBLE))) AS BIGINT) AS gain
    FROM (SELECT unnest(range(10000)) AS b) LEFT JOIN raw ON raw.bucket = b LEFT JOIN wanted ON wanted.bucket = b
),
weights AS (
    SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM doc_words JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY doc_id
),
scored AS (
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
            / 4294967296::DOUBLE))) AS BIGINT) AS score
    FROM texts LEFT JOIN weights USING (doc_id)
),
ranked AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
