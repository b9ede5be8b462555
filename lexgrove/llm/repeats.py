"""What the repeat removers share: exchanging packed entries, finding each window's first document, and cutting.

Map tasks read text in *stretches* of bounded size. An entry (a code and its place) names its document by its place in the
stretch alone; the stretch's table of documents travels once. Entries go to buckets of their codes, one binary row for each
bucket and stretch, with places as differences, so an entry costs its code and one or two bytes (with 8,192 buckets some 9 in all; where
much text makes more buckets, and a row holds few entries, up to 14). Before anything is sent, a stretch is combined: of equal codes only the smallest document's entries travel, the
others are settled where they are. So a window that a third of all documents share reaches its bucket once from each
stretch, not once from each document. What is found goes back to the stretches, where places become documents again.

A document is known by its id and a hash of its text, so rows that repeat an id are kept apart. A stretch's number
follows from its partition, so a task that runs again makes the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrow_text as at

#: Bytes of text in a stretch.
STRETCH_BYTES = 8 << 20
#: Bytes of text for each bucket; and how many buckets there are before they grow, up to so many times as large.
BUCKET_BYTES, MANY_BUCKETS, GROWTH = 8 << 20, 1 << 13, 8

#: Rows of the exchanges: packed entries; kind says of what.
ROW = "kind int, bucket int, stretch long, ids binary, keys binary, counts binary, codes binary, marks binary, sides binary, places binary, sizes binary"
ROW_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("stretch", pa.int64()), *((c, pa.binary()) for c in ("ids", "keys", "counts", "codes", "marks", "sides", "places", "sizes"))])
PACKED, WINDOWS, COVERED, ASKED, TABLE = range(5)


def prepared(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text, and the keys that spans are joined by. The keys are never null, so Spark puts no filter before an inner
    join, and an inner and an outer join of one query share one shuffle of the texts. A row without an id has a text_key
    that spans of documents don't have."""
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return read.withColumns({"doc_key": F.coalesce("doc_id", F.lit(0)), "text_key": text_key(F.col("doc_id"), F.col("text"))})


def text_key(doc_id: Column, text: Column) -> Column:
    """The hash that tells rows of one id apart; rows without an id have keys of their own."""
    return F.xxhash64(text.cast("string"), doc_id.cast("long").isNull())


def bucket_count(docs: DataFrame) -> int:
    """Buckets for the text there is; as many as shuffle partitions at least."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets_for(total))


def buckets_for(total: int) -> int:
    """A stretch has a row for each bucket, and a row costs as much as some entries; so beyond MANY_BUCKETS buckets become larger before
    they become more."""
    buckets = -(-total // BUCKET_BYTES)
    return min(buckets, max(MANY_BUCKETS, -(-buckets // GROWTH)))


@dataclass
class Stretch:
    number: int
    ids: np.ndarray
    keys: np.ndarray
    bounds: np.ndarray  # the first place of each document, and the end
    place: np.ndarray  # of each entry
    fields: list[np.ndarray]

    def docs(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, place, "right") - 1

    def table(self, buckets: int) -> pa.RecordBatch:
        binary = {"ids": self.ids, "keys": self.keys, "counts": np.diff(self.bounds)}
        return rows_of(1, kind=pa.array([TABLE], pa.int32()), bucket=pa.array(stretch_buckets(np.array([self.number]), buckets)), stretch=pa.array([self.number]), **{k: pa.array([v.astype(np.int64).tobytes()], pa.binary()) for k, v in binary.items()})


def stretch_buckets(numbers_: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets for rows that are of a stretch and only pass the buckets' exchange. Numbers are mixed, as those of different
    partitions differ in high bits alone."""
    return (at.mix(numbers_.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def stretches(batches: Iterator[pa.RecordBatch], read: Callable[[pa.RecordBatch], tuple[np.ndarray, list[np.ndarray]]], limit: int, scan: int = 0) -> Iterator[Stretch]:
    """Reads slices until a stretch has ``limit`` bytes. read: of a slice, its documents' bounds, the entries' places and
    fields. scan: tells the stretches of a query's scans apart."""
    base = (scan << 60) | (TaskContext.get().partitionId() << 28)
    ids, keys, bounds, held, size, end, n = [], [], [np.zeros(1, np.int64)], [], 0, 0, 0

    def made() -> Stretch:
        place, *fields = (np.concatenate(x) for x in zip(*held, strict=True))
        return Stretch(base | n, np.concatenate(ids), np.concatenate(keys), np.concatenate(bounds), place, fields)

    for batch in at.slices(batches, "text", min(limit, at.SLICE_BYTES)):
        own, (place, *fields) = read(batch)
        ids.append(batch.column("doc_id").to_numpy())
        keys.append(batch.column("text_key").to_numpy())
        bounds.append(own[1:] + end)
        held.append([place + end, *fields])
        end += int(own[-1])
        size += batch.column("text").nbytes
        if size >= limit:
            yield made()
            ids, keys, bounds, held, size, end, n = [], [], [np.zeros(1, np.int64)], [], 0, 0, n + 1
            at.release()
    if held:
        yield made()
    held.clear()
    at.release()


def rows_of(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in ROW_SCHEMA], schema=ROW_SCHEMA)


def cut(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary array of values[a:b] for consecutive bounds."""
    values = np.ascontiguousarray(values)
    width = values.itemsize * int(np.prod(values.shape[1:]))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(values)])


def planes(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Each values[a:b] of consecutive bounds as differences, all low bytes first, then the next ones: small differences are
    one byte each and zeros, which compress to nothing."""
    step = values.copy()
    step[1:] -= values[:-1]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    step[first] = values[first]
    flat = step.view(np.uint8).reshape(-1, step.itemsize)
    return pa.array([flat[a:b].T.tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())


def numbers(column: pa.Array | pa.ChunkedArray, kind=np.int32) -> list[np.ndarray]:
    """The numbers of each row of a column that ``planes`` made."""
    width = np.dtype(kind).itemsize
    return [np.cumsum(np.ascontiguousarray(x.reshape(width, -1).T).view(kind).reshape(-1), dtype=kind) for x in at.arrays(column, np.uint8)]


def together(parts: list[np.ndarray], kind=np.int32) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def packed(kind: int, buckets: int, bucket: np.ndarray, stretch: Stretch, place: np.ndarray, *, ids: np.ndarray | None = None, **fields: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket that has entries, which ascend by place. ids: the entries' document ids, if the bucket has to
    compare them; neighbours mostly share one, so runs of them are packed."""
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    bucket = bucket[order]
    turn = runs_of(bucket)
    bounds = np.append(turn, len(bucket))
    columns = {k: (planes(v[order].astype(np.int32), bounds) if k == "sizes" else cut(v[order], bounds)) for k, v in fields.items()}
    if ids is not None:
        ids = ids[order]
        run = runs_of(bucket, ids)
        of = np.searchsorted(run, bounds)
        columns |= {"ids": planes(ids[run], of), "counts": planes(np.diff(np.append(run, len(ids))).astype(np.int32), of)}
    return rows_of(len(turn), kind=pa.array(np.full(len(turn), kind, np.int32)), bucket=pa.array(bucket[turn].astype(np.int32)), stretch=pa.array(np.full(len(turn), stretch.number)), places=planes(place[order].astype(np.int32), bounds), **columns)


def entry_ids(table: pa.Table) -> np.ndarray:
    """Document ids of all entries of rows that were packed with them."""
    return np.repeat(together(numbers(table["ids"], np.int64), np.int64), together(numbers(table["counts"])))


def spans_row(kind: int, buckets: int, stretch: Stretch, place: np.ndarray, size: np.ndarray | None = None) -> pa.RecordBatch:
    """Spans of a stretch: places and lengths (1 if not given)."""
    order = np.argsort(place, kind="stable")
    return spans_rows(kind, buckets, np.array([stretch.number]), np.zeros(len(place), np.int64), place[order], None if size is None else size[order])


def spans_rows(kind: int, buckets: int, numbers_: np.ndarray, row: np.ndarray, place: np.ndarray, size: np.ndarray | None = None) -> pa.RecordBatch:
    """Spans of several stretches; row: which of the stretches each is of, ascending."""
    bounds = np.searchsorted(row, np.arange(len(numbers_) + 1))
    some = np.flatnonzero(np.diff(bounds))
    bounds = np.append(bounds[some], len(row))
    size = np.ones(len(place), np.int32) if size is None else size.astype(np.int32)
    own = numbers_[some]
    return rows_of(len(some), kind=pa.array(np.full(len(some), kind, np.int32)), bucket=pa.array(stretch_buckets(own, buckets)), stretch=pa.array(own), places=planes(place.astype(np.int32), bounds), sizes=planes(size, bounds))


def runs_of(*sorted_keys: np.ndarray) -> np.ndarray:
    """The first place of each run of equal keys."""
    n = len(sorted_keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def spread(values: np.ndarray, runs: np.ndarray, n: int) -> np.ndarray:
    """A run's value for each of its places."""
    return np.repeat(values, np.diff(np.append(runs, n)))


def not_first(code: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which entries' documents are not the smallest with their code."""
    order = np.argsort(code, kind="stable")
    runs = runs_of(code[order])
    later = np.zeros(len(code), bool)
    if len(code):
        later[order] = ids[order] > spread(np.minimum.reduceat(ids[order], runs), runs, len(code))
    return later


def send_windows(buckets: int, stretch: Stretch, place: np.ndarray, code: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows for windows: of equal codes only the smallest document's go on, the others are covered."""
    ids = stretch.ids[stretch.docs(place)]
    later = not_first(code, ids)
    if later.any():
        yield spans_row(COVERED, buckets, stretch, place[later])
    on = np.flatnonzero(~later)
    on = on[np.argsort(place[on], kind="stable")]
    yield packed(WINDOWS, buckets, (code[on] % np.uint64(buckets)).astype(np.int64), stretch, place[on], ids=ids[on], codes=code[on])


def row_numbers(parts: list[np.ndarray]) -> np.ndarray:
    return np.repeat(np.arange(len(parts)), [len(x) for x in parts])


def _first_documents(table: pa.Table, buckets: int) -> pa.Table:
    """Of the windows in a bucket, those that also start in a smaller document; other rows pass."""
    kinds = table["kind"].to_numpy()
    out = [table.filter(pa.array(kinds != WINDOWS))]
    own = table.filter(pa.array(kinds == WINDOWS))
    if own.num_rows:
        parts = numbers(own["places"])
        later = np.flatnonzero(not_first(at.joined(own["codes"], np.uint64), entry_ids(own)))
        out.append(pa.Table.from_batches([spans_rows(COVERED, buckets, own["stretch"].to_numpy(), row_numbers(parts)[later], together(parts)[later])]))
        at.release()
    return pa.concat_tables(out)


def covered_windows(rows: DataFrame, buckets: int) -> DataFrame:
    """Spans of the windows that also start in a document with a smaller id, with the stretches' tables."""
    return rows.groupBy("bucket").applyInArrow(lambda t: _first_documents(t, buckets), ROW)


def tables_and(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """Of a stretch's rows: ids, keys and bounds of its documents, and the other rows."""
    kinds = table["kind"].to_numpy()
    own = table.filter(pa.array(kinds == TABLE))
    ids, keys, counts = (at.joined(own[c], np.int64) for c in ("ids", "keys", "counts"))
    return ids, keys, np.concatenate(([0], np.cumsum(counts))), table.filter(pa.array(kinds != TABLE))


def _merge(table: pa.Table) -> pa.Table:
    ids, keys, bounds, rows = tables_and(table)
    place, size = together(numbers(rows["places"])).astype(np.int64), together(numbers(rows["sizes"]))
    order = np.argsort(place, kind="stable")
    doc = np.searchsorted(bounds, place[order], "right") - 1
    start = place[order] - bounds[doc]
    end = start + size[order]
    # documents after each other on one line, far enough apart
    away = doc << 32
    reach = np.maximum.accumulate(end + away)
    new = np.ones(len(doc), bool)
    new[1:] = (start + away)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    spans = np.stack((start[first], (reach - away)[last] - start[first]), 1).astype(np.int32).reshape(-1)
    turn = runs_of(doc)
    of = np.searchsorted(first, np.append(turn, len(doc)))
    return pa.Table.from_arrays([pa.array(ids[doc[turn]]), pa.array(keys[doc[turn]]), cut(spans, 2 * of)], ["doc_key", "text_key", "spans"])


def merged(rows: DataFrame) -> DataFrame:
    """One row for each document that has spans: doc_key, text_key, spans (a list of binaries, of each stretch that the
    document is in; start and length of 32 bits each). rows: spans and tables of the same stretches."""
    found = rows.groupBy("stretch").applyInArrow(_merge, "doc_key long, text_key long, spans binary")
    return found.groupBy("doc_key", "text_key").agg(F.collect_list("spans").alias("spans"))


def mask(spans: list[bytes] | None, n: int, wider: int = 0) -> np.ndarray:
    """Which of n places the spans cover, each span being longer by ``wider``."""
    change = np.zeros(n + 1, np.int64)
    if spans:
        s = np.frombuffer(b"".join(spans), np.int32).reshape(-1, 2).astype(np.int64)
        np.add.at(change, s[:, 0], 1)
        np.add.at(change, np.minimum(s[:, 0] + s[:, 1] + wider, n), -1)
    return np.cumsum(change[:-1]) > 0


def ranges(covered: np.ndarray) -> np.ndarray:
    """Begin and end of each run of true places, as two columns."""
    turn = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
    return turn.reshape(-1, 2)
