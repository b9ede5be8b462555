"""Language identification: averaged hashed subword embeddings with a linear softmax and calibrated rejection.

A text's features are its byte n-grams (2 to 4 bytes of lower-cased text, everything but letters as white space), hashed
to ``buckets`` rows of an embedding table; their mean goes through a linear layer and a softmax. Both layers are trained
together by stochastic gradient descent in numpy, on a bounded sample of labelled documents (``sample``: about so many,
chosen by a hash of id and text and measured where they are; at most twice as many reach the driver, as sparse counts). A part of the sample stays out of
training: on it a temperature is fitted that makes the scores probabilities, and the score under which a prediction is
rejected, so that at most ``lose`` of the right predictions fall under it; it is never above 0.5.

Prediction reads whole texts in one scan without a shuffle: as the network is linear up to the softmax, embedding and
output weights multiply into one table of a row of logits for each bucket, and a text's logits are a mean of rows.

Null texts and texts without a letter are `und` with score 0 and rejected; so is every text when there was nothing to
learn from. Labels that are null take no part in training. Repeated documents are each judged; rows without an
id, too, and they train the model like any other. Ties between languages go
to the smaller name. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow_text as at

ORDERS = (2, 3, 4)
#: ASCII letters to lower case; other ASCII to a space; all other bytes, which are parts of letters mostly, as they are.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
UND = "und"


def _features(texts: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: every n-gram's bucket (``buckets`` if it doesn't count) and each text's first n-gram. Texts stand in
    one buffer with a space before and after each; an n-gram counts if it has a letter and stays inside a text."""
    raw, offsets = at.flat(texts)
    text = np.insert(LETTERS[raw], offsets, 32)
    apart = offsets + np.arange(len(offsets))  # the spaces between texts
    code = text.astype(np.uint32)
    letter = text != 32
    for order in range(2, max(ORDERS) + 1):
        code = (code[:-1] << np.uint32(8)) | text[order - 1 :]
        if order not in ORDERS:
            continue
        counts = letter[: len(code)].copy()
        for k in range(1, order):
            counts |= letter[k : k + len(code)]
        for k in range(1, order - 1):
            before = apart - k
            before = before[(before >= 0) & (before < len(code))]
            counts[before] = False
        mixed = code * np.uint32(0x9E3779B1)
        bucket = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(8)) % np.uint32(buckets)
        bucket[~counts] = buckets
        yield bucket, np.minimum(apart, len(code))


def _has_letter(texts: pa.Array) -> np.ndarray:
    raw, offsets = at.flat(texts)
    found = np.concatenate(([0], np.cumsum(at.byte_table((65, 90), (97, 122))[raw])))
    out = found[offsets[1:]] > found[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[i] = any(map(str.isalpha, texts[i].as_py()))
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # (buckets + 1, languages): a row of logits for each bucket, zeros for n-grams that don't count
    bias: np.ndarray
    temperature: float
    reject_below: float

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language (-1: und) and score of each text."""
        n, k = len(texts), len(self.languages)
        if not k:
            return np.full(n, -1), np.zeros(n)
        total, count = np.zeros((n, k)), np.zeros(n)
        for bucket, first in _features(texts, len(self.table) - 1):
            if not len(bucket):
                continue
            real = np.concatenate(([0], np.cumsum(bucket != len(self.table) - 1)))
            count += np.diff(real[first])
            for c in range(k):  # float32 rows gathered a language at a time; sums in double
                sums = np.concatenate(([0.0], np.cumsum(self.table[:, c][bucket], dtype=np.float64)))
                total[:, c] += np.diff(sums[first])
        logits = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        p = _softmax(logits)
        best = np.argmax(p, axis=1)
        score = p[np.arange(n), best]
        some = _has_letter(texts)
        return np.where(some, best, -1), np.where(some, score, 0.0)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _sgd(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, buckets: int, dim: int, epochs: int, rate: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rows: buckets and weights (which sum to 1) of each text. Returns embedding, output weights and bias."""
    embed = rng.normal(0, 1 / dim, (buckets, dim)).astype(np.float32)
    weights, bias = np.zeros((dim, k), np.float32), np.zeros(k, np.float32)
    size, batch = len(rows), 32
    steps = max(1, epochs * -(-size // batch))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(size)
        for start in range(0, size, batch):
            own = order[start : start + batch]
            pull = rate * (1 - step / steps)
            step += 1
            bucket = np.concatenate([rows[i][0] for i in own])
            weight = np.concatenate([rows[i][1] for i in own])
            sizes = np.array([len(rows[i][0]) for i in own])
            if not len(bucket):
                continue
            of = np.repeat(np.arange(len(own)), sizes)
            hidden = np.stack([np.bincount(of, weight * embed[bucket, d], len(own)) for d in range(dim)], 1)
            error = _softmax(hidden @ weights + bias)
            error[np.arange(len(own)), y[own]] -= 1
            error /= len(own)
            back = error @ weights.T
            weights -= (pull * hidden.T @ error).astype(np.float32)
            bias -= (pull * 0.1 * error.sum(0)).astype(np.float32)
            for d in range(dim):
                embed[:, d] -= (pull * np.bincount(bucket, weight * back[of, d], buckets)).astype(np.float32)
    return embed, weights, bias


def _logits(rows, embed, weights, bias) -> np.ndarray:
    hidden = np.array([w @ embed[b] if len(b) else np.zeros(embed.shape[1]) for b, w in rows])
    return hidden @ weights + bias


def train(labelled: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 4000, buckets: int = 1 << 15, dim: int = 16, epochs: int = 5, rate: float = 20.0, lose: float = 0.001, seed: int = 7) -> LanguageModel:
    """Learns from the rows with text and lang; see the module's text for ``sample`` and ``lose``."""
    rows = labelled.select(F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    count = rows.select("lang").count()
    if not count:
        return LanguageModel([], np.zeros((buckets + 1, 0), np.float32), np.zeros(0), 1.0, 1.0)
    share = min(1.0, sample / count)
    chosen = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in at.slices(batches, "text"):
            parts = [np.zeros(0, np.int64)] * batch.num_rows
            for bucket, first in _features(batch.column("text"), buckets):
                parts = [np.concatenate((p, bucket[a:b])) for p, a, b in zip(parts, first[:-1], first[1:], strict=True)]
            found = [np.unique(p[p < buckets], return_counts=True) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), *(pa.array([zlib.compress(x[k].astype(np.int32).tobytes(), 1) for x in found], pa.binary()) for k in (0, 1))], ["id", "lang", "bucket", "count"])

    drawn = lambda df: df.mapInArrow(measure, "id string, lang string, bucket binary, count binary").limit(2 * sample).collect()
    # rows that all repeat a few texts may all miss the draw
    got = sorted(drawn(chosen) or drawn(rows), key=lambda r: (r.id or "", r.lang, r.bucket))
    languages = sorted({r.lang for r in got})
    y = np.array([languages.index(r.lang) for r in got])
    data = []
    for r in got:
        bucket, count_ = (np.frombuffer(zlib.decompress(x), np.int32) for x in (r.bucket, r["count"]))
        data.append((bucket, (count_ / max(1, count_.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    apart = rng.random(len(got)) < 0.2 if len(got) >= 50 else np.zeros(len(got), bool)
    fit = [i for i in range(len(got)) if not apart[i]]
    embed, weights, bias = _sgd([data[i] for i in fit], y[fit], len(languages), buckets, dim, epochs, rate, rng)
    held = np.flatnonzero(apart) if apart.any() else np.arange(len(got))
    logits, truth = _logits([data[i] for i in held], embed, weights, bias), y[held]
    # smoothed targets: even where all are right, the scores claim no more than so many documents can show
    target = np.full(logits.shape, 1 / (len(truth) + len(languages)))
    target[np.arange(len(truth)), truth] = (len(truth) + 1) / (len(truth) + len(languages))
    nll = lambda t: -np.mean((target * np.log(_softmax(logits / t) + 1e-300)).sum(1))
    temperature = float(min(np.geomspace(0.02, 50, 161), key=nll))
    p = _softmax(logits / temperature)
    right = p.max(1)[p.argmax(1) == truth]
    reject = min(0.5, float(np.quantile(right, lose))) if len(right) else 0.5
    table = np.concatenate((embed @ weights, np.zeros((1, len(languages)), np.float32))).astype(np.float32)
    return LanguageModel(languages, table, bias.astype(np.float64), temperature, reject)


def identify(docs: DataFrame, model: LanguageModel, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: doc_id, lang_pred, score (0 to 1), accepted. The model's size is fixed by its parameters and the
    number of languages; it is broadcast."""
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UND], object)
        for batch in at.slices(batches, "text"):
            best, score = m.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score), pa.array((best >= 0) & (score >= m.reject_below))], ["doc_id", "lang_pred", "score", "accepted"])

    return read.mapInArrow(predict, "doc_id long, lang_pred string, score double, accepted boolean")


def keep_accepted(docs: DataFrame, model: LanguageModel, *, text: str = "text") -> DataFrame:
    """The documents whose language the model accepts, with all their columns and nothing more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in at.slices(batches, text):
            best, score = m.predict(batch.column(text))
            yield batch.filter(pa.array((best >= 0) & (score >= m.reject_below)))

    return docs.mapInArrow(keep, docs.schema)
