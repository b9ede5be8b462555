"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A test string is a run of ``n`` consecutive words of a benchmark item, or a whole item of fewer words. Strings of equal
length share one index: a SHIFT table over blocks of two words says how far a cursor may skip, a suffix-hash bucket
selects the strings that may end at a cursor which may not skip, and comparing all words confirms an occurrence: by their
codes first, then by their bytes with those of the benchmark's words.
Cursors of many stretches of text advance side by side in numpy, so each step of the search is one vector operation.

The documents are read once and never shuffled. The test strings are split into blocks of bounded size; each block is
broadcast and searched on its own, and the blocks' results are merged by row.

Null and empty texts have no words and no hits. Repeated documents are each judged. Items without words find nothing.
An item_id that is null is reported as the string "null". Extra columns of either table are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, LongType

from . import arrow_text as at
from .shared_folder import written

#: Between words: everything but ASCII digits and lower-case letters and non-ASCII bytes.
APART = ~at.byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Words that one cursor runs over.
LANE = 256
RANGES = "array<struct<begin: long, end: long>>"


@dataclass
class Words:
    """All words of some texts: bytes, starts and ends, codes, and each text's first word (one more than texts)."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    codes: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, salt: int = 0) -> Words:
        """salt: of the codes; with 0 they are those of other operators."""
        raw, offsets = at.flat(texts)
        raw = at.LOWER[raw]
        starts, ends, first = at.word_bounds(raw, offsets, APART)
        codes = at.word_codes(raw, starts, ends) if not salt else salted_codes(raw, starts, ends, salt)
        return cls(raw, starts, ends, codes, first)

    def same(self, own: np.ndarray, other: Words, others: np.ndarray) -> np.ndarray:
        """Whether the words of the given numbers have the same bytes as the other's."""
        size = self.ends[own] - self.starts[own]
        good = size == other.ends[others] - other.starts[others]
        size[~good] = 1
        differ = self.raw[at.expand(self.starts[own], size)] != other.raw[at.expand(other.starts[others], size)]
        return good & ~np.logical_or.reduceat(differ, np.cumsum(size) - size) if len(own) else good


def salted_codes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    """Codes of words by a keyed hash, for benchmarks with two words of one code."""
    text, key = raw.tobytes(), salt.to_bytes(8, "little")
    return np.array([int.from_bytes(hashlib.blake2b(text[a:b], digest_size=8, key=key).digest(), "little") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)


class WuManber:
    """The index of test strings of one length: strings begin at words ``begin`` of the benchmark's, and belong to items."""

    def __init__(self, words: np.ndarray, begin: np.ndarray, length: int, owners: np.ndarray, bounds: np.ndarray):
        """words: the benchmark's codes; owners[bounds[i]:bounds[i + 1]]: the items that have the i-th string."""
        self.length, self.words = length, words
        self.block = min(2, length)
        size = 1 << int(np.clip(np.ceil(np.log2(8 * len(begin) * length + 64)), 10, 24))
        self.mask = np.uint64(size - 1)
        self.shift = np.full(size, length - self.block + 1, np.int16)
        key = lambda last: self._key(words[begin + last], words[begin + last - 1] if self.block == 2 else None)
        for last in range(self.block - 1, length):
            np.minimum.at(self.shift, key(last), np.int16(length - 1 - last))
        suffix = key(length - 1)
        self.order = np.argsort(suffix, kind="stable")
        self.begin, self.owners, self.bounds = begin, owners, bounds
        self.bucket = np.searchsorted(suffix[self.order], np.arange(size + 1)).astype(np.int32)

    def _key(self, last: np.ndarray, before: np.ndarray | None) -> np.ndarray:
        code = last if before is None else at.mix(last + before * np.uint64(0x9E3779B97F4A7C15))
        return (code & self.mask).astype(np.int64)

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last words' positions and numbers of the strings that end there."""
        none = np.zeros(0, np.int64)
        cursor = np.arange(0, len(words), LANE, dtype=np.int64)
        stop = np.minimum(cursor + LANE, len(words))
        cursor = np.maximum(cursor, self.length - 1)
        ends, keys = [none], [none]
        while True:
            live = cursor < stop
            cursor, stop = cursor[live], stop[live]
            if not len(cursor):
                break
            key = self._key(words[cursor], words[cursor - 1] if self.block == 2 else None)
            skip = self.shift[key]
            stay = skip == 0
            ends.append(cursor[stay])
            keys.append(key[stay])
            cursor = cursor + np.maximum(skip, 1)
        end, key = np.concatenate(ends), np.concatenate(keys)
        count = self.bucket[key + 1] - self.bucket[key]
        string = self.order[at.expand(self.bucket[key].astype(np.int64), count)]
        end = np.repeat(end, count)
        for back in range(self.length):  # from the first word on, which is the cheaper test: the last block is known
            same = words[end - self.length + 1 + back] == self.words[self.begin[string] + back]
            end, string = end[same], string[same]
        return end, string


class Index:
    """The indexes of some items' test strings, one for each length."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        self.names = [name for name, _ in items]
        texts = pa.array([t for _, t in items], pa.string())
        self.salt, self.words = 0, Words.of(texts)
        while not self._told_apart():  # two words of the benchmark have one code
            self.salt += 1
            self.words = Words.of(texts, self.salt)
        codes, first = self.words.codes, self.words.first
        runs, count = at.Runs(codes), np.diff(first)
        width = np.minimum(count, n)
        self.parts = []
        for length in np.unique(width[width > 0]).tolist():
            own = np.flatnonzero(width == length)
            begin = at.expand(first[own], count[own] - length + 1)
            item = np.repeat(own, count[own] - length + 1)
            code = runs.codes(begin, begin + length)
            order = np.lexsort((item, code))
            begin, item, code = begin[order], item[order], code[order]
            new = np.ones(len(code), bool)
            new[1:] = (code[1:] != code[:-1]) | np.any([codes[begin[1:] + k] != codes[begin[:-1] + k] for k in range(length)], axis=0)
            turn = np.flatnonzero(new)
            self.parts.append(WuManber(codes, begin[turn], length, item, np.append(turn, len(item))))

    def _told_apart(self) -> bool:
        codes = self.words.codes
        by = np.argsort(codes, kind="stable")
        turn = np.flatnonzero(np.concatenate(([True], codes[by][1:] != codes[by][:-1]))) if len(by) else by
        return bool(self.words.same(by, self.words, by[np.repeat(turn, np.diff(np.append(turn, len(by))))]).all())

    def occurrences(self, words: Words) -> Iterator[tuple[WuManber, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length: the index, and of each occurrence its first word, its text and its string."""
        for part in self.parts:
            end, string = part.search(words.codes)
            begin = end - part.length + 1
            row = np.searchsorted(words.first, end, "right") - 1
            whole = words.first[row] <= begin  # a string doesn't cross documents
            begin, row, string = begin[whole], row[whole], string[whole]
            step = np.arange(part.length)
            own, at_ = np.unique((begin[:, None] + step).reshape(-1), return_index=True)
            theirs = (part.begin[string][:, None] + step).reshape(-1)[at_]
            wrong = own[~words.same(own, self.words, theirs)]
            if len(wrong):  # words of one code that differ
                true = np.searchsorted(wrong, begin) == np.searchsorted(wrong, begin + part.length)
                begin, row, string = begin[true], row[true], string[true]
            yield part, begin, row, string


def _scan(batches: Iterator[pa.RecordBatch], index: Index, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in at.slices(batches, "text"):
        words = Words.of(batch.column("text"), index.salt)
        first = words.first
        cover = np.zeros(len(words.codes) + 1, np.int64)
        items: dict[int, set[str]] = defaultdict(set)
        for part, begin, row, string in index.occurrences(words):
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + part.length, -1)
            for r, s in set(zip(row.tolist(), string.tolist(), strict=True)):
                items[r].update(index.names[i] for i in part.owners[part.bounds[s] : part.bounds[s + 1]].tolist())
        hit = np.cumsum(cover[:-1]) > 0
        turn = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
        begin, end = turn[::2], turn[1::2]
        # a run of hit words may go on over the end of a document
        cuts = first[(first > 0) & (first < len(words.codes))]
        cuts = np.unique(cuts[hit[cuts] & hit[cuts - 1]]) if len(cuts) else cuts
        begin, end = np.sort(np.concatenate((begin, cuts))), np.sort(np.concatenate((end, cuts)))
        row = np.searchsorted(first, begin, "right") - 1
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for r, b, e in zip(row.tolist(), (begin - first[row]).tolist(), (end - first[row]).tolist(), strict=True):
            spans[r].append((b, e))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(schema.names[0]),
                pa.array(np.diff(first), pa.int64()),
                pa.array([[{"begin": b, "end": e} for b, e in spans.get(i, ())] for i in range(batch.num_rows)], schema.field("hits").type),
                pa.array([sorted(items.get(i, ())) for i in range(batch.num_rows)], pa.list_(pa.string())),
            ],
            schema=schema,
        )


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """For each document: doc_id, n_words, hits (disjoint ranges of hit words, end exclusive) and items (ids as strings, sorted).

    block_bytes: text of the items whose strings are indexed (in the driver, in arrays of about ten times that) and broadcast together; more text makes more blocks, each
    with a scan of the documents, which are then written once with numbers of their rows. An item stands whole in one
    block. The result is the same for every number of blocks.
    """
    spark = docs.sparkSession
    indexes = _indexes(benchmark, item_id, item_text, n, block_bytes)
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type = read.schema["doc_id"].dataType
    out = f"n_words long, hits {RANGES}, items array<string>"
    first = next(indexes)
    second = next(indexes, None)
    if second is None:
        index = spark.sparkContext.broadcast(first)
        return read.mapInArrow(lambda batches: _scan(batches, index.value, _schema("doc_id", id_type)), f"doc_id {id_type.simpleString()}, {out}")
    # rows are numbered once, as ids may repeat or be null; every block's scan reads the same numbers
    rows = written(read.withColumn("row", F.monotonically_increasing_id()), "numbered")
    results = []
    for built in itertools.chain((first, second), indexes):
        index = spark.sparkContext.broadcast(built)

        def scan(batches, index=index):
            return _scan(batches, index.value, _schema("row", LongType()))

        own = rows.select("row", "text").mapInArrow(scan, f"row long, {out}")
        results.append(own.where(F.size("hits") > 0) if results else own)
    merged = results[0]
    for more in results[1:]:
        merged = merged.unionByName(more)
    every = merged.groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # ranges of different blocks may overlap or meet: those are one range, as in one scan
    range_ = lambda begin, end: F.struct(begin.alias("begin"), end.alias("end"))
    joined = F.aggregate(
        "hits",
        F.struct(F.array().cast(RANGES).alias("done"), range_(F.lit(-1).cast("long"), F.lit(-1).cast("long")).alias("last")),
        lambda a, x: F.struct(
            F.when(x["begin"] <= a["last"]["end"], a["done"]).otherwise(F.concat(a["done"], F.array(a["last"]))).alias("done"),
            range_(F.when(x["begin"] <= a["last"]["end"], a["last"]["begin"]).otherwise(x["begin"]), F.greatest(x["end"], a["last"]["end"])).alias("last"),
        ),
        lambda a: F.filter(F.concat(a["done"], F.array(a["last"])), lambda x: x["begin"] >= 0),
    )
    return rows.select("row", "doc_id").join(every.withColumn("hits", joined), "row").select("doc_id", "n_words", "hits", "items")


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """The documents in which no test string occurs, with all their columns."""
    for built in _indexes(benchmark, item_id, item_text, n, block_bytes):
        index = docs.sparkSession.sparkContext.broadcast(built)

        def keep(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in at.slices(batches, text):
                clean = np.ones(batch.num_rows, bool)
                for _, _, row, _ in index.value.occurrences(Words.of(batch.column(text), index.value.salt)):
                    clean[row] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def _indexes(benchmark: DataFrame, item_id: str, item_text: str, n: int, block_bytes: int) -> Iterator[Index]:
    """The index of each block of items."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(item_text).cast("string").alias("words"))
    total = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    for block in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block)
        yield Index([(r.item, r.words) for r in own.toLocalIterator()], n)


def _schema(key: str, kind: DataType) -> pa.Schema:
    return pa.schema([(key, to_arrow_type(kind)), ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def n_hit(hits: str = "hits"):
    """The number of words in the ranges."""
    return F.aggregate(hits, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["begin"])
