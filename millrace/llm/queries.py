"""Thin queries over whole tables, one per training-data operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table


def held_out(modulus: int, remainder: int) -> Column:
    """Does the CRC-32 of the id's text leave the remainder?"""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard of 0.85 or more."""
    from .op02_parity import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"), k=4, num=85, den=100).drop("n_links", "text_hash")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words found in documents."""
    from .op05_decontaminate import contamination

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark"), width=10)[0].drop("text")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from two thirds of the ids."""
    from .op06_language import predict, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(3, 1))
    parser = train(docs.where("not held_out").select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text", "held_out"), parser)[0].drop("text")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, and the terms that disclose it."""
    from .op07_pii import pii_digest

    return pii_digest(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    from .op08_licenses import license_labels

    return license_labels(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels of two thirds of the ids."""
    from .op10_quality import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, table(spark, sf_dir, "labels").where(~held_out(3, 1)))
    return score(docs.withColumn("held_out", held_out(3, 1)), rules).drop("text")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels of four fifths of the ids."""
    from .op09_toxicity import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = fit(docs, table(spark, sf_dir, "labels").where(~held_out(5, 0)))
    return score(docs.withColumn("held_out", held_out(5, 0)), grammar).drop("text")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    from .op03_neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)), k=5)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by place and digest of the value."""
    from .op01_secrets import fit, secret_findings

    found = secret_findings(table(spark, sf_dir, "documents"), fit(spark))
    return found.select("doc_id", F.col("start").cast("long"), F.col("end").cast("long"), "kind", F.sha2("value", 256).alias("value_sha256"), "score")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents sampled to tempered shares of source, language and topic."""
    from .op04_mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))[0].select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "p_include")


QUERIES = {"op1_secrets": op1_secrets, "op4_mixing": op4_mixing, "op3_neighbours": op3_neighbours, "op9_toxicity": op9_toxicity, "op10_quality": op10_quality, "op7_pii": op7_pii, "op8_licenses": op8_licenses, "op6_language": op6_language, "op5_decontaminate": op5_decontaminate, "op2_ngram_jaccard": op2_ngram_jaccard}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict = {
    "op2_ngram_jaccard": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(c) AS component_id FROM r GROUP BY a) c USING (doc_id)
""",
    "op5_decontaminate": f"""
WITH i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, m, array_to_string(ws[s:s + m - 1], ' ') AS win FROM (
  SELECT item_id, ws, least(len(ws), 10) AS m, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS s FROM i WHERE len(ws) > 0)),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
dw AS (SELECT doc_id, m, s, array_to_string(ws[s:s + m - 1], ' ') AS win FROM (
  SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM iw))),
f AS (SELECT doc_id, item_id, s, m FROM dw JOIN iw USING (m, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM f) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM f) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
""",
}
