"""Vectorised views of Arrow text columns, shared by the operators of this subpackage.

Operators read text with ``mapInArrow``; these helpers cut the batches into slices of a bounded number of bytes and
turn a slice into numpy arrays: bytes, document offsets, word bounds and 64-bit codes of words or of runs of tokens.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one slice holds at most (a longer text is a slice of its own).
SLICE_BYTES = 1 << 20

U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15)


def release() -> None:
    """Gives freed memory back to the system: a Python worker lives on between tasks and would hold it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """A boolean table over the 256 byte values, true in the given inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: ASCII white space: space and 0x09 to 0x0D.
SPACE = byte_table((0x20, 0x20), (0x09, 0x0D))
#: ASCII A-Z to a-z, as a translation table.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts the batches so that each piece has at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = held = 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows after each other, and the rows' offsets (one more than rows). Null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_bounds(raw: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, which are runs of bytes not in ``apart`` within a row; and each row's first word."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~apart[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
#: Bytes up to which a word is read in eights; a longer one is hashed by the library.
LONG = 64
_EIGHTS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Codes of two parts after each other. The shift makes it no polynomial, so words or runs of a pattern (as the
    Thue-Morse word and its complement) don't meet in one code."""
    x = left * U64(0xD1342543DE82EF95)
    x += right
    x ^= x >> U64(32)
    x *= U64(0xAEF17502108EF2D9)
    return x


class Runs:
    """Codes of runs of tokens. A level holds the code of every 2**j tokens, made of two of the level below; a run's code
    joins the levels of its length's bits, from the highest down."""

    def __init__(self, *levels: np.ndarray):
        """levels: 64-bit codes of tokens, and of all runs of 2, 4, ... of them, if known."""
        self.levels = list(levels)

    def _level(self, j: int) -> np.ndarray:
        while len(self.levels) <= j:
            last, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(join(last[:-half], last[half:]) if len(last) > half else last[:0])
        return self.levels[j]

    def codes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit codes of tokens[start:end] for each pair; equal runs have equal codes."""
        length = ends - starts
        out, at_ = np.zeros(len(starts), np.uint64), starts.astype(np.int64)
        for j in range(int(length.max(initial=0)).bit_length() - 1, -1, -1):
            on = np.flatnonzero(length >> j & 1)
            part = self._level(j)[at_[on]] if len(on) else out[:0]
            out[on] = np.where(length[on] >> (j + 1) > 0, join(out[on], part), part)
            at_[on] += 1 << j
        return mix(out + length.astype(np.uint64) * _STEP)

    def rolling(self, width: int) -> np.ndarray:
        """Codes of all runs of ``width`` tokens."""
        n = len(self.levels[0]) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out, at_ = None, 0
        for j in range(width.bit_length() - 1, -1, -1):
            if width >> j & 1:
                part = self._level(j)[at_ : at_ + n]
                out = part if out is None else join(out, part)
                at_ += 1 << j
        return mix(out + U64(width * int(_STEP) & (1 << 64) - 1))


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; zeros follow the last."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    return np.ndarray((len(raw),), "<u8", padded.data, strides=(1,)).copy()


class ByteRuns(Runs):
    """Runs of bytes: up to eight of them are their own code."""

    def __init__(self, raw: np.ndarray):
        self.size, eights = len(raw), _eights(raw)
        super().__init__(eights, eights, eights, eights[: max(0, len(raw) - 7)])

    def _level(self, j: int) -> np.ndarray:
        own = super()._level(j)
        return own if j > 2 else own[: max(0, self.size - (1 << j) + 1)] & _EIGHTS[1 << j]


def word_codes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit codes of the words raw[start:end]."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    eights, length = _eights(raw), ends - starts
    out = join(length.astype(np.uint64), eights[starts] & _EIGHTS[np.minimum(length, 8)])
    on = np.flatnonzero((length > 8) & (length <= LONG))
    for done in range(8, LONG, 8):
        on = on[length[on] > done]
        if not len(on):
            break
        out[on] = join(out[on], eights[starts[on] + done] & _EIGHTS[np.minimum(length[on] - done, 8)])
    for i in np.flatnonzero(length > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(out)


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start+1, ... of each range, after each other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(total, dtype=np.int64) + shift


def text_array(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary Arrow array of raw[start:end]; the ranges ascend and do not overlap."""
    counts = ends - starts
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=at[1:])
    data = raw[expand(starts, counts)] if len(starts) else raw[:0]
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def arrays(column: pa.Array | pa.ChunkedArray, dtype) -> list[np.ndarray]:
    """Each row of a binary column as a numpy array."""
    return [np.frombuffer(x.as_buffer(), dtype) if x.is_valid else np.zeros(0, dtype) for x in column]


def joined(column: pa.Array | pa.ChunkedArray, dtype) -> np.ndarray:
    """All rows of a binary column as one numpy array."""
    parts = arrays(column, dtype)
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def in_parts(part: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that groups entries by part (keeping their order within), and the parts' offsets."""
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(n + 1))
