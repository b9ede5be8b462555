"""Token counts by unigram dynamic programming over a trie of the distinct pre-tokens.

A text's pre-tokens are its words, each with the vocabulary's word mark before it. The best segmentation of a pre-token
is that of the highest sum of piece scores (fewest tokens among equals). The distinct pre-tokens of a stretch of text
form a trie, and the forward score and token count of each trie node, which is a prefix shared by many pre-tokens, are
computed once: level by level, all nodes of a depth as one vector, from the nodes up to the longest piece's length
above. The count at a pre-token's last node is stored and reused for the rest of the task. Nothing is shuffled.

A character outside the vocabulary counts as its UTF-8 bytes. Null and empty texts have 0 tokens. Repeated documents are
each counted. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow_text as at

#: The sentencepiece library's word mark (a fixed value of the file format).
MARK = "▁"


def load_pieces(path: str) -> dict[str, float]:
    """The pieces of a sentencepiece file and their log-probabilities, by Zipf's law over the file's order of rank."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
    total = np.log(np.sum(1.0 / np.arange(1, len(ranked) + 1)))
    return {model.id_to_piece(i): float(-np.log(r + 1) - total) for r, i in enumerate(ranked)}


class Unigram:
    """Counts tokens of pre-tokens."""

    #: Pre-tokens of more characters are computed one by one.
    LONG = 256

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.byte_score = min(pieces.values(), default=0.0) - 1.0
        points = self._points("".join(pieces))
        ends = np.cumsum([len(p) for p in pieces]).astype(np.int64)
        codes = at.Runs(at.mix(points)).codes(np.concatenate(([0], ends[:-1])).astype(np.int64), ends)
        order = np.argsort(codes)
        self.codes, self.scores = codes[order], np.array(list(pieces.values()))[order]
        self.may = np.zeros(1 << 20, bool)
        self.may[codes & np.uint64(0xFFFFF)] = True
        self.known: dict[str, int] = {}

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)

    def _score(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the codes that are pieces, and their scores."""
        some = np.flatnonzero(self.may[codes & np.uint64(0xFFFFF)])
        at_ = np.minimum(np.searchsorted(self.codes, codes[some]), len(self.codes) - 1)
        good = self.codes[at_] == codes[some]
        return some[good], self.scores[at_[good]]

    def count_one(self, word: str) -> int:
        """The plain computation, without a trie."""
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            found = (-np.inf, 0)
            for size in range(1, min(end, self.longest) + 1):
                score = self.pieces.get(word[end - size : end])
                more = 1
                if score is None and size == 1:
                    more = len(word[end - 1].encode("utf-8", "surrogatepass"))
                    score = more * self.byte_score
                if score is not None:
                    before = best[end - size]
                    found = max(found, (before[0] + score, before[1] - more))
            best.append(found)
        return -best[-1][1]

    def count(self, words: list[str]) -> np.ndarray:
        """Numbers of tokens of distinct words, by a trie over them."""
        out = np.array([self.count_one(w) if len(w) > self.LONG else 0 for w in words], np.int64)
        short = np.array([i for i, w in enumerate(words) if 0 < len(w) <= self.LONG], np.int64)
        if not len(short):
            return out
        text = [words[i] for i in short]
        points = self._points("".join(text))
        wide = (1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.int64)
        size = np.array([len(w) for w in text], np.int64)
        start = np.cumsum(size) - size
        runs = at.Runs(at.mix(points))
        # by depth: each word's node, and the nodes' scores and counts
        node, score, count = [np.zeros(len(text), np.int64)], [np.zeros(1)], [np.zeros(1, np.int64)]
        live = np.arange(len(text))
        for depth in range(1, int(size.max()) + 1):
            live = live[size[live] >= depth]
            _, one, back = np.unique(runs.codes(start[live], start[live] + depth), return_index=True, return_inverse=True)
            of = live[one]  # a word for each node
            end = start[of] + depth
            best, least = np.full(len(of), -np.inf), np.zeros(len(of), np.int64)
            for width in range(1, min(depth, self.longest) + 1):
                hit, points_ = self._score(runs.codes(end - width, end))
                if width == 1:
                    more = wide[end - 1]
                    value = more * self.byte_score
                    value[hit], more[hit] = points_, 1
                    hit, add = np.arange(len(of)), more
                else:
                    value, add = points_, np.ones(len(hit), np.int64)
                above = node[-width][of[hit]]
                value, total = score[-width][above] + value, count[-width][above] + add
                better = (value > best[hit]) | ((value == best[hit]) & (total < least[hit]))
                best[hit[better]], least[hit[better]] = value[better], total[better]
            own = np.zeros(len(text), np.int64)
            own[live] = back
            out[short[of[size[of] == depth]]] = 0
            done = live[size[live] == depth]
            out[short[done]] = least[own[done]]
            node, score, count = [*node, own][-self.longest :], [*score, best][-self.longest :], [*count, least][-self.longest :]
        return out

    def texts(self, column: pa.Array, keep: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words and of tokens of the texts."""
        raw, offsets = at.flat(column)
        starts, ends, first = at.word_bounds(raw, offsets, at.SPACE)
        words = at.text_array(raw, starts, ends).dictionary_encode()
        distinct = [MARK + w.decode("utf-8", "surrogatepass") for w in words.dictionary.to_pylist()]
        if len(self.known) > keep:
            self.known = {}
        if new := [w for w in distinct if w not in self.known]:
            self.known.update(zip(new, self.count(new).tolist(), strict=True))
        per_word = np.array([self.known[w] for w in distinct], np.int64)[words.indices.to_numpy()] if len(starts) else np.zeros(0, np.int64)
        return np.diff(first), np.diff(np.concatenate(([0], np.cumsum(per_word)))[first])


def count_tokens(docs: DataFrame, model: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: doc_id, n_words, n_tokens. model: path of a sentencepiece file, on every machine."""
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = Unigram(load_pieces(model))
        for batch in at.slices(batches, "text", 8 << 20):
            words, tokens = unigram.texts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return read.mapInArrow(count, "doc_id long, n_words long, n_tokens long")
