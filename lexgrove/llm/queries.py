"""The queries opN_<name>: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import shared_folder
from . import clustering, conversations, decontamination, jaccard_join, language_id, nearest, oracles, packing, privacy, simhash, substring_dedup, suffix_dedup, token_counts, token_files

#: Vocabulary files, by their public names.
WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def small_batches(spark: SparkSession) -> None:
    """Texts are longer than numbers: fewer rows in a batch between the JVM and Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _removed(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["begin"])


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", _removed().alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", _removed().alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = language_id.train(docs.where(~held_out))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.digest(privacy.find_spans(table(spark, sf_dir, "documents")))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = decontamination.n_hit()
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-files")
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(WORD_BPE))
    return token_files.read_documents(manifest, folder)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = conversations.digest(conversations.repair(conversations.damage(turns)))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = turns.select("conv_id").distinct().alias("e").join(found.alias("f"), F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    return every.select("e.conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clustering.cluster(table(spark, sf_dir, "embeddings"))
    hashes = F.array(*(F.lit(clustering.centroid_hash(c)) for c in centroids)).cast("array<string>")
    return found.withColumn("centroid_sha256", F.get(hashes, "cluster"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_token_counts, op3_suffix_dedup, op4_language_id, op5_jaccard_join, op6_privacy, op7_benchmark_decontamination, op8_nearest_neighbours, op9_packing, op10_token_files, op11_conversation_repair, op12_centroid_clustering, op13_simhash)}
#: What needs a model, a tokenizer or a graph of real distances has no SQL; the tests have plain versions.
ORACLES = {"op1_substring_dedup": oracles.SUBSTRING_DEDUP, "op3_suffix_dedup": oracles.SUFFIX_DEDUP, "op5_jaccard_join": oracles.JACCARD_JOIN, "op7_benchmark_decontamination": oracles.DECONTAMINATION, "op11_conversation_repair": oracles.CONVERSATION_REPAIR, "op12_centroid_clustering": oracles.CENTROID_CLUSTERING}
