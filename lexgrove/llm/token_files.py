"""Token-id output: Arrow files of fixed-size-list batches, with random access to equal-length sequences and masks.

Documents are range-partitioned by id; each task encodes its range and writes one uncompressed Arrow IPC file of rows
(ids: fixed_size_list<uint16 or uint32>[length], mask: fixed_size_list<bool>[length]) and a second file that says which
document has how many ids. Ids of consecutive documents run on through the sequences; only the last sequence of a file is
padded, where its mask is false. A manifest (Parquet, a row for each file) gives the files' order.

A task that is run again writes files of other names; the manifest names those of the attempt that Spark kept, so lost
executors and speculative attempts do no harm. Null and empty texts have the end id alone. Documents of equal id stay
next to each other, in any order; rows without an id come first. Empty tables give an empty manifest and no documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import arrow_text as at
from .encoding import encoder as encoder_of

MANIFEST = "part int, file string, n_docs long, n_tokens long, n_sequences long"
#: Sequences in a record batch of a file.
BATCH = 512


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, length: int = 2048) -> DataFrame:
    """Writes all documents' ids in ascending order of doc_id to new files in ``folder``; returns the manifest as read back."""
    spark = docs.sparkSession
    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("_row", F.monotonically_increasing_id())
    # rows of one id may be in several tasks
    ordered = ordered.repartitionByRange("doc_id", "_row").sortWithinPartitions("doc_id", "_row").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, place = _open(folder)
        fs.create_dir(place, recursive=True)
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        encoder = encoder_of(tokenizer)
        kind = pa.from_numpy_dtype(encoder.dtype)
        schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        n_docs = n_tokens = n_sequences = 0
        rest = np.zeros(0, encoder.dtype)
        parts = at.slices(batches, "text")
        if (part := next(parts, None)) is None:
            return
        with fs.open_output_stream(f"{place}/{name}.arrow") as data, pa.ipc.new_file(data, schema) as out, fs.open_output_stream(f"{place}/{name}.docs.arrow") as listed, pa.ipc.new_file(listed, pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])) as index:

            def put(ids: np.ndarray, real: int) -> None:
                mask = np.arange(len(ids)) < real
                arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), length) for x in (ids, mask)]
                out.write_batch(pa.RecordBatch.from_arrays(arrays, schema=schema))

            while part is not None:
                ids, ends = encoder.encode(part.column("text"))
                stream = np.insert(ids, ends[1:], np.array(end_id, encoder.dtype))
                count = np.diff(ends) + 1
                index.write_batch(pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count)], ["doc_id", "n_tokens"]))
                n_docs, n_tokens = n_docs + len(count), n_tokens + len(stream)
                rest = np.concatenate((rest, stream))
                while len(rest) >= length * BATCH:
                    put(rest[: length * BATCH], length * BATCH)
                    rest, n_sequences = rest[length * BATCH :], n_sequences + BATCH
                part = next(parts, None)
            if len(rest):
                last = -(-len(rest) // length)
                put(np.concatenate((rest, np.zeros(last * length - len(rest), encoder.dtype))), len(rest))
                n_sequences += last
        yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], pa.int32()), pa.array([name]), *(pa.array([x], pa.int64()) for x in (n_docs, n_tokens, n_sequences))], ["part", "file", "n_docs", "n_tokens", "n_sequences"])

    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder, with the number of ids in all files before each; a row for each file."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    return files.withColumn("start", F.coalesce(before, F.lit(0)))


class TokenFile:
    """Random access to the sequences of one file; the arrays are views of the mapped file."""

    def __init__(self, folder: str, file: str):
        fs, place = _open(folder)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        self.source = pa.memory_map(f"{place}/{file}.arrow") if local else fs.open_input_file(f"{place}/{file}.arrow")
        self.reader = pa.ipc.open_file(self.source)
        with fs.open_input_file(f"{place}/{file}.docs.arrow") as f:
            self.docs = pa.ipc.open_file(f).read_all()

    def batches(self) -> Iterator[np.ndarray]:
        """The real ids of each record batch."""
        for i in range(self.reader.num_record_batches):
            batch = self.reader.get_batch(i)
            ids, mask = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1))
            yield ids if mask.all() else ids[mask]

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i."""
        batch = self.reader.get_batch(i // BATCH)
        ids, mask = (batch.column(k)[i % BATCH].values for k in (0, 1))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Each document's id and its token ids, in order; holds one record batch and one document."""
        source, held = self.batches(), np.zeros(0, np.uint16)
        for doc, n in zip(self.docs["doc_id"].to_pylist(), self.docs["n_tokens"].to_pylist(), strict=True):
            while len(held) < n:
                more = next(source)
                held = np.concatenate((held, more)) if len(held) else more
            yield doc, held[:n]
            held = held[n:]


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """A task for each file. A row for each document as the files have it: doc_id, start, n_tokens, ids_crc32 (of little-endian 32-bit ids)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                ids, starts, counts, sums = [], [], [], []
                for doc, tokens in TokenFile(folder, file).documents():
                    ids.append(doc)
                    starts.append(start)
                    counts.append(len(tokens))
                    sums.append(zlib.crc32(tokens.astype("<u4").tobytes()))
                    start += len(tokens)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, counts, sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("file", "start")
    return files.repartition(max(1, files.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
