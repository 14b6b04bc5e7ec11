"""From raw documents to a training mix: five stages, each the table of the one before.

Every stage takes ``(spark, docs, sf_dir)`` and returns rows with the columns of ``docs``; between stages the table is
written as Parquet and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsig.llm import decontam, langid, lines, mixing, simhash
from fleetsig.llm.shared import materialise, table

MIN_LANGUAGE_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the byte network names with some confidence; texts without a letter go."""
    guess = langid.predictor(langid.fit(docs))(F.col("text"))
    named = docs.withColumn("__guess", guess)
    sure = (F.col("__guess.lang_pred") != langid.UNKNOWN) & (F.col("__guess.score") >= MIN_LANGUAGE_SCORE)
    return named.where(sure).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents share stay in the last of them; a document may be left empty, but stays."""
    kept = lines.dedup_lines(docs, into="text")
    counted = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return kept.withColumns(counted).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, that with the smallest id (one of them, where an id is repeated)."""
    rows = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = simhash.near_duplicates(rows.select("__row", "text"), shingle=4, max_distance=4, key="__row")
    grouped = rows.select("__row", "doc_id").join(found.select(F.col("key").alias("__row"), "component"), "__row")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__row")
    first = grouped.groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.__row").alias("__row"))
    return rows.join(first, "__row", "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by calibrated probabilities."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("benchmark_decontamination", decontaminate),
    ("mixing", mix),
]

ORACLE_SQL = None  # a trained network, fingerprints and alignments; the stages are tested against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
