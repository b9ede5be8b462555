"""SimHash near-duplicates: 64-bit fingerprints of three-word shingles, linked where at most two bits differ.

A fingerprint's bit is 1 if it is set in over half of the XXH64 codes (seed 42) of the text's shingles, repeats included.
Links are found among *distinct* fingerprints, so a group of copies, however large, asks once.

The index is inverted over byte positions. Two fingerprints with at most ``bits`` differing bits share at least 8 - bits
of their 8 positional bytes: that is the count a pair must reach. The postings of a single (position, byte) would hold a 256th
of all fingerprints each, and counting over them would form all their pairs; so postings are kept for every choice of
as many positions as the count asks for (28 choices of six), and pairs that meet have reached it. A posting has at most
256**bits different entries, whatever the corpus. Its pairs' shared bytes are counted, those below the minimum dropped, and the
differing bits verified; in a long posting an entry looks up the few values at that distance instead of meeting all
others. A pair that shares more bytes meets in several postings and is taken in the first alone. Of the links in a posting
a spanning forest goes on, which keeps components as they are and rows in proportion to fingerprints.

Null and empty texts and texts of white space alone have fingerprint zero, which is linked like any other; fewer words than a
shingle has are one shingle. Rows without an id take no part in links and have no component. Rows that repeat an id or
repeat wholly are each returned. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow_text as at
from .components import components
from .shared_folder import Scratch

#: Shingles whose codes are counted at once.
CHUNK = 1 << 15
#: Entries up to which a posting's pairs are all compared.
SHORT = 64
#: Distinct fingerprints for each bucket of postings.
BUCKET_ROWS = 1 << 15


def fingerprint(text: bytes, words: int = 3) -> int:
    """Of a UTF-8 text. A-Z are lower-cased, words stand between ASCII white space."""
    found = text.lower().split()  # of bytes: ASCII alone
    if not found:
        return 0
    joined, size = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    width = min(words, len(found))
    n = len(found) - width + 1
    set_ = np.zeros(64, np.int64)
    for low in range(0, n, CHUNK):
        high = min(n, low + CHUNK)
        codes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[low:high].tolist(), ends[low + width - 1 : high + width - 1].tolist(), strict=True)), np.uint64, high - low)
        set_ += np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_ > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in at.slices([batch], "text"):
            codes = np.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", words) for x in part.column("text").cast(pa.binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(codes.view(np.int64))], ["doc_id", "code"])


def choices(bits: int) -> list[tuple[int, ...]]:
    """The positions that a choice leaves out."""
    return list(combinations(range(8), bits))


def _mask(left_out: tuple[int, ...]) -> np.uint64:
    return np.uint64((1 << 64) - 1 - sum(255 << 8 * p for p in left_out))


def _post(batches: Iterator[pa.RecordBatch], bits: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Entries of all postings: one row for each bucket, with the fingerprints of each choice."""
    for batch in batches:
        codes = batch.column("code").to_numpy().view(np.uint64)
        if not len(codes):
            continue
        which = np.repeat(np.arange(len(choices(bits)), dtype=np.uint8), len(codes))
        keys = np.concatenate([at.mix(codes & _mask(out)) for out in choices(bits)])
        entries = np.tile(codes, len(choices(bits)))
        order, bounds = at.in_parts((keys % np.uint64(buckets)).astype(np.int64), buckets)
        some = np.flatnonzero(np.diff(bounds))
        cut = lambda x, f=order, b=bounds: pa.array([x[f[b[i] : b[i + 1]]].tobytes() for i in some.tolist()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), cut(which), cut(entries)], ["bucket", "choices", "codes"])


def _differing(bits: int) -> list[int]:
    """All values of ``bits`` bytes with 1 to ``bits`` bits set."""
    return [sum(1 << p for p in places) for n in range(1, bits + 1) for places in combinations(range(8 * bits), n)]


def _spread(rest: np.ndarray, left_out: tuple[int, ...]) -> np.ndarray:
    """Puts the bytes of numbers to the positions left out."""
    return sum(((rest >> np.uint64(8 * i)) & np.uint64(255)) << np.uint64(8 * p) for i, p in enumerate(left_out))


def posting_pairs(codes: np.ndarray, left_out: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (places) of fingerprints, ascending by posting and then value, that meet in one posting of a choice."""
    key = codes & _mask(left_out)
    runs = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(runs, len(key)))
    short = np.flatnonzero((size > 1) & (size <= SHORT))
    for away in range(1, int(size[short].max(initial=1))):
        short = short[size[short] > away]
        a = at.expand(runs[short], size[short] - away)
        yield a, a + away
    for run in np.flatnonzero(size > SHORT).tolist():
        own = codes[runs[run] : runs[run] + size[run]]
        for other in _spread(np.array(_differing(bits), np.uint64), left_out):
            want = own ^ other
            place = np.minimum(np.searchsorted(own, want), len(own) - 1)
            a = np.flatnonzero((own[place] == want) & (want > own))
            yield runs[run] + a, runs[run] + place[a]


def linked(codes: np.ndarray, a: np.ndarray, b: np.ndarray, left_out: tuple[int, ...], bits: int) -> np.ndarray:
    """Which pairs share enough positional bytes, have their first posting here and differ in few bits."""
    x = codes[a] ^ codes[b]
    differs = np.stack([(x >> np.uint64(8 * p) & np.uint64(255)) != 0 for p in range(8)])
    shared = 8 - differs.sum(axis=0)
    # the first choice that leaves out all differing positions fills up with the last ones that don't differ
    spare = bits - differs.sum(axis=0)
    first = np.ones(len(x), bool)
    for p in range(7, -1, -1):
        fill = ~differs[p] & (spare > 0)
        spare = spare - fill
        first &= (differs[p] | fill) == (p in left_out)
    return (shared >= 8 - bits) & first & (np.bitwise_count(x) <= bits)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each place with the least place of its component, of links a-b."""
    if not len(a):
        return a, b
    places, at_ = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at_[: len(a)], at_[len(a) :]
    up = np.arange(len(places))
    while True:
        low = np.minimum(up[a], up[b])
        new = up.copy()
        for x in (a, b, up[a], up[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == up).all():
            break
        up = new
    below = np.flatnonzero(up < np.arange(len(places)))
    return places[below], places[up[below]]


def _links(table: pa.Table, bits: int) -> pa.Table:
    """Links of the postings in a bucket."""
    which, codes = at.joined(table["choices"], np.uint8), at.joined(table["codes"], np.uint64)
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, left_out in enumerate(choices(bits)):
        own = codes[which == i]
        if len(own) < 2:
            continue
        own = own[np.lexsort((own, own & _mask(left_out)))]
        ends_a, ends_b = [], []
        for a, b in posting_pairs(own, left_out, bits):
            on = linked(own, a, b, left_out, bits)
            ends_a.append(a[on])
            ends_b.append(b[on])
        if ends_a:
            a, b = forest(np.concatenate(ends_a), np.concatenate(ends_b))
            found_a.append(own[a].view(np.int64))
            found_b.append(own[b].view(np.int64))
    at.release()
    return pa.table({"a": np.concatenate(found_a), "b": np.concatenate(found_b)})


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 3, bits: int = 2) -> DataFrame:
    """For each row: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id of its component)."""
    if not 1 <= bits <= 3:
        raise ValueError("bits must be from 1 to 3")
    scratch = Scratch()
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    codes = scratch.written(read.mapInArrow(lambda b: _fingerprints(b, words), "doc_id long, code long"), "fingerprints")
    distinct = scratch.written(codes.where(F.col("doc_id").isNotNull()).groupBy("code").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-distinct.count() // BUCKET_ROWS))
    posted = distinct.select("code").mapInArrow(lambda b: _post(b, bits, buckets), "bucket int, choices binary, codes binary")
    links = posted.groupBy("bucket").applyInArrow(lambda t: _links(t, bits), "a long, b long")
    labels = components(links)
    named = scratch.written(distinct.join(labels.select(F.col("node").alias("code"), "label"), "code", "left").select("code", "least", F.coalesce("label", "code").alias("label")), "fingerprint-labels")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    known = named.join(least, "label").select("code", "component_id")
    out = codes.join(known, "code", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
