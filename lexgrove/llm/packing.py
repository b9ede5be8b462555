"""Packing into optimal length buckets.

Documents become sequences of at most ``max_length`` tokens (a longer document makes several). The global histogram of
sequence lengths, which has at most ``max_length`` rows however large the corpus, goes to the driver; dynamic programming
chooses the ``buckets`` upper bounds that minimise the padding of all sequences to their bucket's bound. Inside a
bucket, batches of ``budget`` tokens form: each has ``budget // bound`` sequences. A bucket is dealt over shards of about
``shard_rows`` sequences, a number that follows from the histogram, and rows are numbered inside a shard, so no task
holds a bucket; only the last batch of each shard may be short.

Every document gives at least one sequence: null and empty texts have the end token alone. Repeated rows are packed
each. Equal lengths go to one bucket; inside a shard, sequences stand in order of document and part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import arrow_text as at
from .encoding import encoder as encoder_of
from .shared_folder import written


def token_lengths(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and n_tokens, with one end token."""
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in at.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(encoder.lengths(batch.column("text")) + 1, pa.int64())], ["doc_id", "n_tokens"])

    return read.mapInArrow(measure, "doc_id long, n_tokens long")


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds (ascending, the last is the largest length) of at most ``buckets`` buckets with the least padding."""
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths, np.float64)[order], np.asarray(counts, np.float64)[order]
    n = len(lengths)
    if not n:
        return []
    rows = np.concatenate(([0.0], np.cumsum(counts)))
    tokens = np.concatenate(([0.0], np.cumsum(counts * lengths)))
    # cost[j]: least padding of the first j lengths; the last bucket of it begins at cut[k][j]
    cost = np.concatenate(([0.0], lengths * rows[1:] - tokens[1:]))
    cuts = [np.zeros(n + 1, np.int64)]
    for _ in range(1, min(buckets, n)):
        new, cut = cost.copy(), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            total = cost[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            cut[j] = int(np.argmin(total))
            new[j] = total[cut[j]]
        cost = new
        cuts.append(cut)
    bounds, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j])
    return bounds[::-1]


def pack(lengths: DataFrame, *, max_length: int = 2048, buckets: int = 16, budget: int = 65_536, shard_rows: int = 50_000) -> DataFrame:
    """lengths: doc_id, n_tokens. Returns a row for each sequence: doc_id, part (from 0), begin and length (tokens of the
    document), bucket (the padded length), shard, batch (number inside bucket and shard) and slot (place in the batch)."""
    if budget < max_length:
        raise ValueError("budget must hold a sequence of max_length")
    sequences = lengths.select("doc_id", F.col("n_tokens").alias("_n"), F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / max_length) - 1, F.lit(0)).cast("int"))).alias("part"))
    sequences = sequences.select("doc_id", "part", (F.col("part").cast("long") * max_length).alias("begin"), F.least(F.lit(max_length).cast("long"), F.col("_n") - F.col("part") * max_length).alias("length"))
    histogram = sequences.groupBy("length").count().collect()  # at most max_length rows
    sizes, counts = np.array([r[0] for r in histogram], np.int64), np.array([r[1] for r in histogram], np.int64)
    bounds = optimal_bounds(sizes, counts, buckets)
    if not bounds:
        bounds = [max_length]
    place = np.searchsorted(bounds, sizes)
    shards = [max(1, int(-(-counts[place == i].sum() // shard_rows))) for i in range(len(bounds))]
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("_at"))
    dealt = sequences.withColumn("_at", F.lit(1) + sum((F.col("length") > b).cast("int") for b in bounds[:-1])) if len(bounds) > 1 else sequences.withColumn("_at", F.lit(1))
    dealt = dealt.withColumn("bucket", pick(bounds).cast("long")).withColumn("shard", F.pmod(F.xxhash64("doc_id", "part"), pick(shards)).cast("int"))
    inside = W.partitionBy("bucket", "shard").orderBy("doc_id", "part")
    numbered = dealt.withColumn("_row", F.row_number().over(inside) - 1).withColumn("_fits", F.floor(F.lit(budget) / F.col("bucket")).cast("int"))
    return numbered.select("doc_id", "part", "begin", "length", "bucket", "shard", F.floor(F.col("_row") / F.col("_fits")).cast("long").alias("batch"), (F.col("_row") % F.col("_fits")).cast("int").alias("slot"))


def pack_documents(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Measures whole texts with the tokenizer (once; the lengths are written to the shared folder) and packs them."""
    return pack(written(token_lengths(docs, tokenizer, doc_id=doc_id, text=text), "token-lengths"), **options)
