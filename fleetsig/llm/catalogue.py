"""Registered queries of the operators on training text, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsig.llm import (
    ann, decontam, langid, lines, mixing, negatives, packing, quality, simhash, spelling, suffixes, templates, urls,
)
from fleetsig.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return add


@register("op3_simhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_distance=4)
    return found.select(
        F.col("key").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


# (host, path, verdict): the list the query is judged by
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

OP1_SQL = f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
parts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM hosts
),
hits AS (
  SELECT p.page_id, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS n
  FROM parts p JOIN rules r
    ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN hits h ON h.page_id = p.page_id AND h.n = 1
"""


@register("op1_url_filter", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules).withColumnRenamed("page", "page_id")


OP4_SQL = """
WITH split AS (
  SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM split
),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
),
judged AS (
  SELECT x.doc_id, x.pos, x.line, s.k IS NOT NULL AND x.doc_id <> s.keeper AS lost
  FROM keyed x LEFT JOIN shared s ON s.k = x.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN lost THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@register("op4_line_dedup", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), into="kept", counts=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@register("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs)).withColumnRenamed("key", "doc_id")


@register("op10_nearest_neighbours")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = ann.nearest(vectors.where("vec_id % 20 = 0"), vectors, k=20)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("neighbour").alias("vec_id"), "score")


@register("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("key", "doc_id")


@register("op5_suffix_array_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        F.col("doc").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@register("op6_html_extraction")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(table(spark, sf_dir, "pages")).withColumnRenamed("page", "page_id")


@register("op7_benchmark_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"doc": "doc_id", "item": "item_id", "start": "start_word", "end": "end_word"})


@register("op8_mix_sources", mixing.sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dims = mixing.dimensions()
    drawn = mixing.calibrated(docs.withColumn("topic", dims["topic"]), dims)
    return drawn.select(
        "doc_id", "source", "lang", "topic", F.col("__tokens").alias("tokens"), F.round("__p", 9).alias("probability"),
        F.col("__sampled").alias("sampled"),
    )


OP11_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM usable a JOIN usable r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) <= 3
"""


@register("op11_hard_negatives", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", shifted)
    found = negatives.mine(rows.where("vec_id % 50 = 0"), rows)
    return found.withColumnsRenamed({"anchor": "anchor_id", "positive": "positive_id", "negative": "negative_id"})


# CRC-32 byte by byte over the hexadecimal UTF-8 of each key; near words share a masked or a shortened string
OP12_SQL = """
WITH RECURSIVE steps(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
),
crc_table AS (SELECT i, c FROM steps WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
    FROM documents
  ) GROUP BY doc_id, run
),
keyed AS (SELECT DISTINCT doc_id, run, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS h FROM runs),
crc(doc_id, run, h, pos, c) AS (
  SELECT doc_id, run, h, 0, CAST(4294967295 AS BIGINT) FROM keyed
  UNION ALL
  SELECT k.doc_id, k.run, k.h, k.pos + 1, xor(k.c >> 8, t.c)
  FROM crc k JOIN crc_table t
    ON t.i = xor(k.c, (instr('0123456789ABCDEF', substr(k.h, 2 * k.pos + 1, 1)) - 1) * 16
                      + instr('0123456789ABCDEF', substr(k.h, 2 * k.pos + 2, 1)) - 1) & 255
  WHERE 2 * k.pos < length(k.h)
),
hashed AS (SELECT doc_id, run, xor(c, 4294967295) AS h FROM crc WHERE 2 * pos = length(h)),
spoilt AS (
  SELECT r.n, CASE WHEN h.h % 97 = 0
                   THEN substr(r.run, 1, h.h % length(r.run)) || substr(r.run, h.h % length(r.run) + 2) ELSE r.run END AS word
  FROM runs r JOIN hashed h ON h.run = r.run AND h.doc_id IS NOT DISTINCT FROM r.doc_id
),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spoilt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM places),
pairs AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM cuts x JOIN cuts y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION
  SELECT x.word, w.word, w.n FROM cuts x JOIN words w ON w.word = x.a || x.b
  UNION
  SELECT w.word, x.word, x.n FROM cuts x JOIN words w ON w.word = x.a || x.b
),
best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word
),
judged AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form,
         CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
),
paths(word, last, step) AS (
  SELECT word, word, 0 FROM judged
  UNION ALL
  SELECT p.word, j.form, p.step + 1 FROM paths p JOIN judged j ON j.word = p.last WHERE j.form IS NOT NULL
),
roots AS (SELECT word, first(last ORDER BY step DESC) AS root FROM paths GROUP BY word)
SELECT j.word, j.form, r.root, j.n, j.n_near, j.form_n FROM judged j JOIN roots r ON r.word = j.word
"""


@register("op12_spelling_variants", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), least_letters=5, least=3, ratio=2, spoil=97)


@register("op13_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(table(spark, sf_dir, "documents"), capacity=2048)
    return found.withColumnsRenamed({"key": "doc_id", "sequence": "sequence_id"})
