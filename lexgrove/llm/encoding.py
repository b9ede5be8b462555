"""Token ids of whole texts by a vocabulary file of the tokenizers library, each distinct piece encoded once a task.

The vocabulary's pre-tokeniser never joins text over white space, nor over the place after an ASCII letter that some
other ASCII character than a letter follows, nor over the place after an ASCII digit that ASCII follows. Texts are cut
there, each distinct piece is encoded by the library, and the ids are gathered again; the result equals encoding whole
texts. Texts with the mark of a special token are encoded whole. Pieces are looked up by a 64-bit code, and every piece of a
text is then compared with the bytes of the one that was found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import arrow_text as at

LETTER = at.byte_table((0x41, 0x5A), (0x61, 0x7A))
DIGIT = at.byte_table((0x30, 0x39))
ASCII = at.byte_table((0, 0x7F))
PLAIN = ASCII & ~LETTER & ~at.SPACE
SPECIAL = "<|"


#: Encoders of this process, which serves several tasks.
_MADE: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder of a vocabulary file."""
    if path not in _MADE:
        _MADE[path] = Encoder(path)
    return _MADE[path]


class Encoder:
    """Encodes Arrow text columns; keeps the ids of every piece that it has seen, up to ``keep`` pieces."""

    def __init__(self, path: str, keep: int = 1_500_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype(np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32)
        self.closes = np.zeros(max(self.library.get_vocab().values()) + 1, bool)
        self.closes[[i for piece, i in self.library.get_vocab().items() if piece.endswith("</w>")]] = True
        self.keep = keep
        self._forget()

    def _forget(self) -> None:
        self.codes, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # by code
        self.ids, self.raw = Grown(self.dtype), Grown(np.uint8)

    def _known(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers for pieces that are new."""
        first, texts = len(self.ids.size), [p.decode() for p in pieces]
        single = [p for p in texts if p.isalpha()]
        ids = np.array(self.library.encode_batch_fast([" ".join(single)], add_special_tokens=False)[0].ids, self.dtype) if single else np.zeros(0, self.dtype)
        stops = np.flatnonzero(self.closes[ids]) + 1
        if len(stops) != len(single) or (len(ids) and stops[-1] != len(ids)):
            ids, stops, alone = ids[:0], stops[:0], np.zeros(len(texts), bool)
        else:
            alone = np.array([p.isalpha() for p in texts], bool)
        rest = [p for p, x in zip(texts, alone.tolist(), strict=True) if not x]
        more = [np.array(e.ids, self.dtype) for e in self.library.encode_batch_fast(rest, add_special_tokens=False)] if rest else []
        order = np.concatenate((np.flatnonzero(alone), np.flatnonzero(~alone)))
        self.ids.add(np.concatenate([ids, *more]), np.concatenate((np.diff(stops, prepend=0), np.array([len(x) for x in more], np.int64))).astype(np.int64))
        self.raw.add(np.frombuffer(b"".join(pieces[i] for i in order.tolist()), np.uint8), np.array([len(pieces[i]) for i in order.tolist()], np.int64))
        numbers = np.empty(len(pieces), np.int64)
        numbers[order] = np.arange(first, first + len(pieces))
        return numbers

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of each piece, and each text's first piece (one more than texts)."""
        raw, offsets = at.flat(texts)
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        inside = ~at.SPACE[raw]
        cut = np.ones(len(raw) + 1, bool)  # before each byte, and at the end
        cut[1:-1] = ~inside[1:] | ~inside[:-1] | (LETTER[raw[:-1]] & PLAIN[raw[1:]]) | (DIGIT[raw[:-1]] & ASCII[raw[1:]])
        cut[offsets] = True
        starts, ends = np.flatnonzero(cut[:-1] & inside), np.flatnonzero(cut[1:] & inside) + 1
        if len(self.codes) > self.keep:
            self._forget()
        found = pa.array(at.word_codes(raw, starts, ends)).dictionary_encode()
        code, which = found.dictionary.to_numpy(), found.indices.to_numpy()
        new = np.flatnonzero(~self._has(code))
        if len(new):
            lead = np.zeros(len(code), np.int64)
            lead[which[::-1]] = np.arange(len(which))[::-1]  # the first place of each
            numbers = self._known([raw[a:b].tobytes() for a, b in zip(starts[lead[new]].tolist(), ends[lead[new]].tolist(), strict=True)])
            order = np.argsort(code[new])
            at_ = np.searchsorted(self.codes, code[new][order])
            self.codes, self.number = np.insert(self.codes, at_, code[new][order]), np.insert(self.number, at_, numbers[order])
        piece = self.number[np.searchsorted(self.codes, code)][which]
        size = ends - starts
        wrong = size != self.raw.size[piece]
        at_ = np.where(wrong, 0, size)
        differ = raw[at.expand(starts, at_)] != self.raw.values[at.expand(self.raw.begin[piece], at_)]
        if differ.any() or wrong.any():  # pieces of one code that differ
            bad = np.unique(np.concatenate((np.flatnonzero(wrong), np.repeat(np.arange(len(piece)), at_)[differ])))
            texts_ = [raw[starts[i] : ends[i]].tobytes() for i in bad.tolist()]
            once = list(dict.fromkeys(texts_))
            numbers = dict(zip(once, self._known(once).tolist(), strict=True))
            piece[bad] = [numbers[t] for t in texts_]
        return piece, np.searchsorted(starts, offsets)

    def _has(self, code: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(len(code), bool)
        return self.codes[np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)] == code

    def _whole(self, texts: pa.Array) -> dict[int, np.ndarray]:
        """Ids of the texts with the mark of a special token, by their number."""
        marked = np.flatnonzero(pc.fill_null(pc.match_substring(texts, SPECIAL), False).to_numpy(zero_copy_only=False))
        return {int(i): np.array(e.ids, self.dtype) for i, e in zip(marked, self.library.encode_batch_fast(texts.take(pa.array(marked)).to_pylist(), add_special_tokens=False) if len(marked) else (), strict=True)}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts after each other, and the texts' offsets (one more than texts). Null is empty."""
        piece, first = self._pieces(texts)
        size = self.ids.size[piece]
        ids = self.ids.values[at.expand(self.ids.begin[piece], size)]
        ends = np.concatenate(([0], np.cumsum(size)))[first]
        if whole := self._whole(texts):
            parts = [whole.get(i, ids[ends[i] : ends[i + 1]]) for i in range(len(texts))]
            ids, ends = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        return ids, ends

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Numbers of ids of the texts."""
        piece, first = self._pieces(texts)
        count = np.diff(np.concatenate(([0], np.cumsum(self.ids.size[piece])))[first])
        for i, ids in self._whole(texts).items():
            count[i] = len(ids)
        return count


class Grown:
    """Short runs of values after each other, to which more are added: where each begins, and its size."""

    def __init__(self, dtype: np.dtype):
        self.values, self.begin, self.size = np.zeros(0, dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        begin = len(self.values) + np.cumsum(sizes) - sizes
        self.values, self.begin, self.size = np.concatenate((self.values, values)), np.concatenate((self.begin, begin)), np.concatenate((self.size, sizes))
