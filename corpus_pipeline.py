"""A training-data pipeline of five stages over ``documents``: each takes (spark, docs, sf_dir) and returns a DataFrame.

All stages but the last return the columns of ``documents``. Language identification drops what it rejects, the n-gram
Jaccard join keeps one document of each group of near duplicates, decontamination drops documents with benchmark passages,
the privacy stage sanitises texts, and packing deals the documents' token sequences to length buckets and batches.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm import decontamination, jaccard_join, language_id, packing, privacy
from lexgrove.llm.queries import WORD_BPE, table
from lexgrove.llm.shared_folder import written


def small_batches(spark: SparkSession) -> None:
    """Whole documents pass through all stages in one set of workers: fewer of them in a batch than in a single query."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return language_id.keep_accepted(docs, language_id.train(docs))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard_join.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark")
    small_batches(spark)
    return decontamination.keep_clean(docs, benchmark)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sanitised texts; n_chars is that of the new text."""
    small_batches(spark)
    return privacy.sanitise(docs).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.char_length("text").cast("long"), "n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path(WORD_BPE))


STAGES = [("language_id", identify_language), ("jaccard_join", join_near_duplicates), ("decontamination", decontaminate), ("privacy", sanitise), ("packing", pack)]

#: A trained model and a graph's components can't be written in SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; each stage but the last is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
