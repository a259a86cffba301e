"""A corpus pipeline of five stages, each on all that the stage before kept.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

Edge cases, the same in all stages: an empty table gives an empty one; columns
beyond those of documents pass through whatever their names, and the last stage's
own columns get underscores in front where they clash; null and empty texts, null
ids and very long texts are handled as the operators say, so rows without a text
stay unless mixing leaves them out; repeated rows are judged alike, and one of
them stays in near_duplicates, unless their id is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import op02_parity, op04_mixing, op05_decontaminate, op07_pii, op09_toxicity
from millrace.llm.queries import held_out
from millrace.llm.store import Workspace, table
from millrace.llm.words import fresh

#: Most ids of dropped copies that are broadcast; more are joined by shuffle.
FEW_IDS = 500_000
#: Words of a benchmark item that a document mustn't hold in a row.
WINDOW = 10


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar predicts toxic go."""
    source = table(spark, sf_dir, "documents")
    grammar = op09_toxicity.fit(source, table(spark, sf_dir, "labels").where(~held_out(5, 0)))
    ids = docs.columns
    scored = op09_toxicity.score(docs, grammar)
    verdict = next(c for c in reversed(scored.columns) if c.strip("_") == "predicted")
    return scored.where(F.col(verdict) == 0).select(*ids)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles with a Jaccard of 0.8 or more
    the document with the smallest id stays; of rows with one id, one row.
    Documents without words link with nothing and stay, as do those without an id."""
    classes = op02_parity.jaccard_classes(docs, k=5, num=80, den=100)
    gone, text, once = (fresh(c, docs.columns) for c in ("_gone", "_text", "_row"))
    rows = classes.where("doc_id is not null").groupBy("doc_id", "text_hash", "component_id").agg(F.count("*").alias("n"))
    first = rows.where("doc_id = component_id").groupBy("doc_id").agg(F.min("text_hash").alias("stays"))
    # a row is known by id and text; nearly all are the only one of their id, and stay
    drop = rows.join(first, "doc_id", "left").where("doc_id <> component_id or text_hash <> stays").select(F.col("doc_id").alias(gone), F.col("text_hash").alias(text))
    few = drop.count() <= FEW_IDS
    kept = docs.join(F.broadcast(drop) if few else drop, (F.col("doc_id") == F.col(gone)) & (F.xxhash64("text") == F.col(text)), "left_anti")
    if rows.where("n > 1").isEmpty():
        return kept
    # rows of one id and text are copies too
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(1))
    return kept.withColumn(once, F.row_number().over(same)).where((F.col(once) == 1) | F.col("doc_id").isNull()).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go.

    An item of fewer words, such as a short answer, stands in clean documents too,
    and doesn't make them go.
    """
    items = table(spark, sf_dir, "benchmark")
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    found, names = op05_decontaminate.contamination(docs, items.where(words >= WINDOW), width=WINDOW)
    return found.where(~F.col(names["contaminated"])).select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms are generalised in the text; n_chars follows."""
    clean = op07_pii.sanitise(docs)
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast("long"))
    return clean.select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to tempered shares of source, language and topic."""
    return op04_mixing.mix_sources(docs)[0]


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("mixing", mixing)]

#: Learning, connected components and raking aren't expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table goes when the next one is written."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, work.table(stage(spark, docs, sf_dir), name)
        work.drop(before)
    return docs
