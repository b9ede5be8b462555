"""Suffix-array de-duplication by a depth-limited radix sort, over bytes.

A repeat is a string of ``threshold`` bytes of a document that also starts in a document with a smaller id. Groups of
suffixes that agree on their first ``threshold`` bytes are exactly the repeated strings, so suffixes are ordered by
most-significant-digit passes that go no deeper, and a group that one document has alone is not looked at again.

Ordering every suffix would move several times the input, so the passes order *runs* of neighbouring suffixes. A string's
lead is the one of its ``digit``-byte pieces with the smallest code (the first among equals); strings that agree have
their lead in the same place, and neighbouring strings mostly share one. The digits of a run are

1. its lead's code: the first pass deals runs by it; a lead in one document alone ends here;
2. the code of the whole run: equal runs agree in all their strings, and all but the smallest document's are covered;
3. where runs of one lead differ, the whole codes of their strings: the last pass, to depth ``threshold``. A string has at
   least half of its other bytes on one side of its lead, so runs that agree with no other document's on either side (16
   bits of a code for each side) share no string and stop before it.

A digit's order is that of its 64-bit code; any order of the digits gives the same groups. Before a pass sends anything,
entries of a stretch of text are combined (repeats.py); a lead with over ``HOT`` different runs in one stretch (as at the
end of a licence line) goes on to the last pass at once and leaves only a mark in its bucket, so no bucket grows with it.

Runs of one lead are told apart by 48 bits of their code (and 32 and the bucket's of the lead's), strings in the last pass
by 64. Null and empty texts have no bytes. Documents shorter than the threshold are never cut. Repeated ids are not smaller than
each other. Rows without an id take no part and are returned uncut. Removed bytes may leave a text that is not UTF-8, so
``kept`` is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow_text as at
from . import repeats as r
from .shared_folder import written

#: Different runs of one lead in a stretch from which the lead is hot.
HOT = 64
_PLACE = np.uint64((1 << 31) - 1)


def leads(codes: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each ``width`` consecutive codes, the first among equals (of the leading 33 bits)."""
    best = (codes & ~_PLACE) | np.arange(len(codes), dtype=np.uint64)
    reach = 1
    while reach * 2 <= width:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    if width > reach:
        best = np.minimum(best[: len(best) - (width - reach)], best[width - reach :])
    return (best & _PLACE).astype(np.int64)


def _runs(batch: pa.RecordBatch, threshold: int, digit: int) -> tuple[np.ndarray, ...]:
    """Documents' bounds, and of each run: place, number of strings, the codes of its lead, of all its bytes, and of the
    lead's sides."""
    raw, offsets = at.flat(batch.column("text"))
    maker = at.ByteRuns(raw)
    if len(raw) < threshold:
        none = np.zeros(0, np.int64)
        return offsets, none, none, none.astype(np.uint64), none.astype(np.uint64), np.zeros((0, 2), np.uint16)
    piece = maker.rolling(digit)
    lead = leads(piece, threshold - digit + 1)
    inside = np.ones(len(lead) + 1, bool)  # strings that stay in a document
    inside[-1] = False
    for k in range(1, threshold):
        near = offsets[1:] - k
        inside[near[(near >= 0) & (near < len(lead))]] = False
    # an empty or short document's end may lie before its begin's strings: those are outside by another document's end
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2] | (lead[1:] != lead[:-1])
    begin = np.flatnonzero(first)
    last = inside[:-1].copy()
    last[:-1] &= ~inside[1:-1] | (lead[1:] != lead[:-1])
    end = np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, begin, "right") - 1
    # half of the other bytes on either side of the lead; 0 where the document has fewer there
    spot, half = lead[begin], -(-(threshold - digit) // 2)
    sides = np.zeros((len(begin), 2), np.uint16)
    for side, (low, high) in enumerate(((spot - half, spot), (spot + digit, spot + digit + half))):
        there = (low >= offsets[row]) & (high <= offsets[row + 1])
        sides[there, side] = (maker.codes(low[there], high[there]) >> np.uint64(48)).astype(np.uint16)
    return offsets, begin, end - begin, at.mix(piece[spot]), maker.codes(begin, end + threshold - 1), sides


def _first_pass(batches: Iterator[pa.RecordBatch], threshold: int, digit: int, buckets: int, limit: int, most: int) -> Iterator[pa.RecordBatch]:
    kept: list[pa.RecordBatch] = []  # of the stretch that is being read

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        offsets, place, size, lead, code, sides = _runs(batch, threshold, digit)
        kept.append(batch)
        return offsets, [place, size, lead, code, sides]

    for stretch in r.stretches(batches, read, limit):
        texts, kept[:] = list(kept), []
        place, (size, lead, code, sides) = stretch.place, stretch.fields
        yield stretch.table(buckets)
        if not len(code):
            continue
        ids = stretch.ids[stretch.docs(place)]
        # runs by their code: all but the smallest document's are covered
        later = r.not_first(code, ids)
        if later.any():
            yield r.spans_row(r.COVERED, buckets, stretch, place[later], size[later])
        on = np.flatnonzero(~later)
        # leads with many different runs
        order = on[np.argsort(lead[on], kind="stable")]
        runs = r.runs_of(lead[order])
        many = np.diff(np.append(runs, len(order))) > most
        many &= np.minimum.reduceat(ids[order], runs) != np.maximum.reduceat(ids[order], runs)
        hot = np.zeros(len(code), bool)
        hot[order] = r.spread(many, runs, len(order))
        if hot.any():
            yield from r.send_windows(buckets, stretch, *_windows(texts, place[hot], size[hot], threshold))
            hot[order[runs[many]]] = False  # one run of each stays; size 0 is the mark
            size = size.copy()
            size[order[runs[many]]] = 0
        cold = on[~hot[on]]
        yield r.packed(r.PACKED, buckets, (lead[cold] % np.uint64(buckets)).astype(np.int64), stretch, place[cold], ids=ids[cold], codes=code[cold].view(np.uint8).reshape(-1, 8)[:, :6], marks=(lead[cold] >> np.uint64(32)).astype(np.uint32), sides=sides[cold], sizes=size[cold])


def _windows(texts: list[pa.RecordBatch], place: np.ndarray, size: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and code of every string of runs; places go on through the texts."""
    codes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    begin = 0
    for batch in texts:
        raw, _ = at.flat(batch.column("text"))
        own = np.flatnonzero((place >= begin) & (place < begin + len(raw)))
        if len(own):
            start = at.expand(place[own].astype(np.int64) - begin, size[own].astype(np.int64))
            codes.append(at.ByteRuns(raw).codes(start, start + threshold))
            places.append(start + begin)
        begin += len(raw)
    return np.concatenate(places), np.concatenate(codes)


def _second_pass(table: pa.Table, buckets: int) -> pa.Table:
    kinds = table["kind"].to_numpy()
    out = [table.filter(pa.array(kinds != r.PACKED))]
    own = table.filter(pa.array(kinds == r.PACKED))
    if own.num_rows:
        stretch, parts = own["stretch"].to_numpy(), r.numbers(own["places"])
        row, place, size, ids = r.row_numbers(parts), r.together(parts), r.together(r.numbers(own["sizes"])), r.entry_ids(own)
        lead, sides = at.joined(own["marks"], np.uint32), at.joined(own["sides"], np.uint16).reshape(-1, 2)
        code = np.zeros((len(lead), 8), np.uint8)
        code[:, :6] = at.joined(own["codes"], np.uint8).reshape(-1, 6)
        code = code.view(np.uint64)[:, 0]
        order = np.argsort(lead, kind="stable")
        runs = r.runs_of(lead[order])
        marked = np.logical_or.reduceat(size[order] == 0, runs)
        wanted = (np.minimum.reduceat(ids[order], runs) != np.maximum.reduceat(ids[order], runs)) | marked
        alive = order[r.spread(wanted, runs, len(order))]  # leads in several documents
        marks = lead[order[runs[marked]]]
        alive = alive[size[alive] > 0]
        alive = alive[np.lexsort((ids[alive], code[alive], lead[alive]))]
        if len(alive):
            runs = r.runs_of(lead[alive], code[alive])
            smallest = r.spread(ids[alive][runs], runs, len(alive))
            later = np.sort(alive[ids[alive] > smallest])
            out.append(pa.Table.from_batches([r.spans_rows(r.COVERED, buckets, stretch, row[later], place[later], size[later])]))
            # leads whose runs differ: the first documents' runs go on
            firsts = alive[ids[alive] == smallest]
            ask = np.isin(lead[firsts], marks)
            for side in sides[firsts].T:  # those that agree with another document's on a side of the lead
                by = np.lexsort((side, lead[firsts]))
                runs = r.runs_of(lead[firsts][by], side[by])
                id_ = ids[firsts][by]
                ask[by] |= r.spread(np.minimum.reduceat(id_, runs) != np.maximum.reduceat(id_, runs), runs, len(by))
            ask = np.sort(firsts[ask])
            out.append(pa.Table.from_batches([r.spans_rows(r.ASKED, buckets, stretch, row[ask], place[ask], size[ask])]))
    return pa.concat_tables(out)


def _last_pass(batches: Iterator[pa.RecordBatch], threshold: int, buckets: int, limit: int) -> Iterator[pa.RecordBatch]:
    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        _, offsets = at.flat(batch.column("text"))
        lists = [np.frombuffer(b"".join(x), np.int32).reshape(-1, 2) for x in batch.column("spans").to_pylist()]
        spans = np.concatenate(lists).astype(np.int64) if lists else np.zeros((0, 2), np.int64)
        start = spans[:, 0] + np.repeat(offsets[:-1], [len(x) for x in lists])
        return offsets, list(_windows([batch], start, spans[:, 1], threshold))

    for stretch in r.stretches(batches, read, limit, scan=1):
        yield stretch.table(buckets)
        yield from r.send_windows(buckets, stretch, stretch.place, stretch.fields[0])


def _cut(batches: Iterator[pa.RecordBatch], threshold: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in at.slices(batches, "text"):
        raw, offsets = at.flat(batch.column("text"))
        kept, spans = [], []
        for i, own in enumerate(batch.column("spans").to_pylist()):
            text = raw[offsets[i] : offsets[i + 1]]
            gone = r.mask(own, len(text), threshold - 1) if own else None
            spans.append([] if gone is None else [{"begin": b, "end": e} for b, e in r.ranges(gone).tolist()])
            kept.append(text.tobytes() if gone is None else text[~gone].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(spans, schema.field("spans").type), pa.array(kept, pa.binary())], schema=schema)


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: int = 50, stretch: int = r.STRETCH_BYTES, hot: int = HOT) -> DataFrame:
    """For each document: doc_id, n_bytes, spans (ranges of removed bytes, end exclusive) and kept (the other bytes).
    stretch: bytes of text whose entries a task combines and sends together."""
    digit = max(1, (threshold + 2) // 3)
    read = r.prepared(docs, doc_id, text)
    buckets = r.bucket_count(read)
    some = read.where(F.col("doc_id").isNotNull())
    passed = written(some.mapInArrow(lambda b: _first_pass(b, threshold, digit, buckets, stretch, hot), r.ROW).groupBy("bucket").applyInArrow(lambda t: _second_pass(t, buckets), r.ROW), "suffix-runs")
    kinds = lambda *k: passed.where(F.col("kind").isin(*k))
    asked = r.merged(kinds(r.TABLE, r.ASKED))
    deeper = read.join(asked, ["doc_key", "text_key"]).mapInArrow(lambda b: _last_pass(b, threshold, buckets, stretch), r.ROW)
    last = r.covered_windows(kinds(r.WINDOWS).unionByName(deeper), buckets)
    # a document has spans from its stretches in both scans
    covered = r.merged(kinds(r.TABLE, r.COVERED).unionByName(last))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
    return read.join(covered, ["doc_key", "text_key"], "left").mapInArrow(lambda b: _cut(b, threshold, schema), "doc_id long, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary")
