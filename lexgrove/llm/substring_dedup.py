"""Substring de-duplication by fixed-block anchors, over words.

A repeat is a window of ``window`` consecutive words of a document that also starts in a document with a smaller id. Half
a window is a block. Every window holds one of its document's non-overlapping blocks whole, so

1. the blocks of all documents are the index, and every rolling run of a block's length in any document probes it: codes
   are dealt to buckets, and a code that stands in two documents, in one of them as a block, makes each place where it
   stands an anchor;
2. around each anchor the windows that hold it are taken, and each window's first document is found (repeats.py). Windows
   that also start in a smaller document follow each other along a maximal exact repeat, whose words their union covers.

Codes have 64 bits for windows; anchors, which only choose what is looked at more closely, have 32 and the bucket's.
Null, empty and wordless texts have no words. Documents shorter than a window are never cut. Repeated ids are not smaller
than each other. Rows without an id take no part and are returned uncut. Ties don't occur: order is by id alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow_text as at
from . import repeats as r


def _word_codes(texts: pa.Array) -> tuple[at.Runs, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw, offsets = at.flat(texts)
    starts, ends, first = at.word_bounds(raw, offsets, at.SPACE)
    return at.Runs(at.word_codes(raw, starts, ends)), first, raw, starts, ends


def _inside(first: np.ndarray, width: int) -> np.ndarray:
    """The starts of all runs of ``width`` words that stay in their document."""
    return at.expand(first[:-1], np.maximum(np.diff(first) - width + 1, 0))


def _probe(batches: Iterator[pa.RecordBatch], block: int, buckets: int, limit: int) -> Iterator[pa.RecordBatch]:
    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        runs, first, *_ = _word_codes(batch.column("text"))
        start = _inside(first, block)
        return first, [start, runs.codes(start, start + block)]

    for stretch in r.stretches(batches, read, limit):
        place, (code,) = stretch.place, stretch.fields
        yield stretch.table(buckets)
        if not len(code):
            continue
        doc = stretch.docs(place)
        is_block = (place - stretch.bounds[doc]) % block == 0
        order = np.argsort(code, kind="stable")
        runs = r.runs_of(code[order])
        shared = np.minimum.reduceat(doc[order], runs) != np.maximum.reduceat(doc[order], runs)
        anchor = np.zeros(len(code), bool)
        anchor[order] = r.spread(shared, runs, len(code))
        # a code that several documents here share travels once, as a block if it is one anywhere
        lead = np.minimum.reduceat(np.where(is_block[order], 0, len(code)) + np.arange(len(code)), runs) % len(code)
        on = ~anchor
        on[order[lead[shared]]] = True
        if anchor.any():
            yield r.spans_row(r.COVERED, buckets, stretch, place[anchor])
        yield r.packed(r.PACKED, buckets, (code[on] % np.uint64(buckets)).astype(np.int64), stretch, place[on], codes=(code[on] >> np.uint64(32)).astype(np.uint32), marks=is_block[on])


def _anchors(table: pa.Table, buckets: int) -> pa.Table:
    """Codes from two stretches are of two documents, as codes that documents of one stretch share were combined there."""
    kinds = table["kind"].to_numpy()
    out = [table.filter(pa.array(kinds != r.PACKED))]
    own = table.filter(pa.array(kinds == r.PACKED))
    if own.num_rows:
        parts = r.numbers(own["places"])
        code, is_block, row = at.joined(own["codes"], np.uint32), at.joined(own["marks"], np.bool_), r.row_numbers(parts)
        order = np.argsort(code, kind="stable")
        runs = r.runs_of(code[order])
        good = (np.minimum.reduceat(row[order], runs) != np.maximum.reduceat(row[order], runs)) & np.logical_or.reduceat(is_block[order], runs)
        hit = np.zeros(len(code), bool)
        hit[order] = r.spread(good, runs, len(code))
        out.append(pa.Table.from_batches([r.spans_rows(r.COVERED, buckets, own["stretch"].to_numpy(), row[hit], r.together(parts)[hit])]))
    return pa.concat_tables(out)


def _extend(batches: Iterator[pa.RecordBatch], window: int, block: int, buckets: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Windows around the anchors."""

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        runs, first, *_ = _word_codes(batch.column("text"))
        starts = [np.zeros(0, np.int64)]
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            n = int(first[i + 1] - first[i]) - window + 1
            if n <= 0:
                continue
            # an anchor at p is whole in the windows from p - (window - block) to p
            hit = np.flatnonzero(r.mask(spans, n + window - 1))
            change = np.zeros(n + 1, np.int64)
            low, high = np.maximum(hit - (window - block), 0), np.minimum(hit + 1, n)
            ok = low < high
            np.add.at(change, low[ok], 1)
            np.add.at(change, high[ok], -1)
            starts.append(np.flatnonzero(np.cumsum(change[:-1]) > 0) + first[i])
        start = np.concatenate(starts)
        return first, [start, runs.codes(start, start + window)]

    for stretch in r.stretches(batches, read, limit):
        yield stretch.table(buckets)
        yield from r.send_windows(buckets, stretch, stretch.place, stretch.fields[0])


def _cut(batches: Iterator[pa.RecordBatch], window: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in at.slices(batches, "text"):
        raw, offsets = at.flat(batch.column("text"))
        starts, ends, first = at.word_bounds(raw, offsets, at.SPACE)
        spans = []
        gone = [np.zeros(0, bool)]
        for i, own in enumerate(batch.column("spans").to_pylist()):
            gone.append(r.mask(own, int(first[i + 1] - first[i]), window - 1))
            spans.append([{"begin": b, "end": e} for b, e in r.ranges(gone[-1]).tolist()])
        stay = np.flatnonzero(~np.concatenate(gone))
        # each kept word and a space after it, but for the last
        size = ends[stay] - starts[stay]
        text = np.full(int(size.sum()) + len(stay), 32, np.uint8)
        begin = np.cumsum(size + 1) - size - 1
        text[at.expand(begin, size)] = raw[at.expand(starts[stay], size)]
        bounds = np.append(begin, len(text))[np.searchsorted(stay, first)]
        data = text.tobytes()
        kept = [data[a : max(a, b - 1)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(spans, schema.field("spans").type), pa.array(kept, pa.binary()).cast(pa.string())], schema=schema)


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 50, stretch: int = r.STRETCH_BYTES) -> DataFrame:
    """For each document: doc_id, n_words, spans (ranges of removed words, end exclusive) and kept (the other words, joined
    by one space). stretch: bytes of text whose entries a task combines and sends together."""
    block = window // 2
    if block < 1:
        raise ValueError("window must have two words at least")
    read = r.prepared(docs, doc_id, text)
    buckets = r.bucket_count(read)
    some = read.where(F.col("doc_id").isNotNull())
    probes = some.mapInArrow(lambda b: _probe(b, block, buckets, stretch), r.ROW)
    anchors = r.merged(probes.groupBy("bucket").applyInArrow(lambda t: _anchors(t, buckets), r.ROW))
    around = read.join(anchors, ["doc_key", "text_key"]).mapInArrow(lambda b: _extend(b, window, block, buckets, stretch), r.ROW)
    covered = r.merged(r.covered_windows(around, buckets))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])
    return read.join(covered, ["doc_key", "text_key"], "left").mapInArrow(lambda b: _cut(b, window, schema), "doc_id long, n_words long, spans array<struct<begin: long, end: long>>, kept string")
