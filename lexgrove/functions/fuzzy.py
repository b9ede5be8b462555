"""Text distances that Spark has no function for, as Arrow-vectorised UDFs. ``levenshtein`` is built in; these are not it."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def places(a: str) -> dict[str, int]:
    """The places of each character, as bits."""
    found: dict[str, int] = {}
    for i, c in enumerate(a):
        found[c] = found.get(c, 0) | 1 << i
    return found


def lcs_of(place: dict[str, int], n: int, b: str) -> int:
    """Longest common subsequence of a text of n characters, given by its places, and another: a row of bits at a time (Hyyrö, 2004)."""
    full = (1 << n) - 1
    row = full
    for c in b:
        if here := place.get(c):
            match = row & here
            row = ((row + match) | (row - match)) & full
    return n - row.bit_count()


def lcs_length(a: str, b: str) -> int:
    return lcs_of(places(a), len(a), b)


def indel_distance(a: str, b: str) -> int:
    return len(a) + len(b) - 2 * lcs_length(a, b)


def partial_ratio(a: str, b: str) -> float:
    """Best similarity (0 to 100) of the shorter text to a stretch of the longer that is no longer than it: all stretches of
    its length, and shorter ones at either end."""
    short, long_ = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long_ else 0.0
    n, best, place = len(short), 0.0, places(short)
    known = [c in place for c in long_]
    met = sum(known[: min(n, len(long_))])  # of a stretch, the characters that the shorter text has at all
    stretches = [(0, end) for end in range(1, n)] + [(start, min(start + n, len(long_))) for start in range(len(long_))]
    for start, end in stretches:
        if end - start == n:
            met = met if start == 0 else met - known[start - 1] + known[end - 1]
        size = n + end - start
        bound = met if end - start == n else end - start
        # no stretch is looked at that can't be better
        if 200.0 * min(n, bound) / size > best:
            best = max(best, 200.0 * lcs_of(place, n, long_[start:end]) / size)
            if best == 100.0:
                break
    return best


def ngram_score(n: int, a: str, b: str) -> int:
    """Number of the 1- to n-grams of a that b contains, ending at a length with less than two; less what b is longer by."""
    score = 0
    for size in range(1, n + 1):
        hits = sum(a[i : i + size] in b for i in range(len(a) - size + 1))
        score += hits
        if hits < 2:
            break
    return score - max(0, abs(len(b) - len(a)) - 2)


def strip_code(text: str) -> str:
    """The text without // and /* */ comments and without what stands in string and character literals."""
    return re.sub(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?""", lambda m: "" if m[0][0] == "/" else m[0][0] * 2, text, flags=re.S)


def graphemes(text: str, *, marks: bool = True, case: bool = True) -> list[str]:
    """Characters as they are seen: a base character (decomposed) with its combining marks. Without ``marks`` those go, and
    without ``case`` letters are folded."""
    out: list[str] = []
    for c in unicodedata.normalize("NFD", text if case else text.casefold()):
        if unicodedata.combining(c):
            if out and marks:
                out[-1] += c
        else:
            out.append(c)
    return out


def grapheme_distance(a: str, b: str, **options) -> int:
    """Edits (replace, insert, delete) between two texts as they are seen."""
    x, y = graphemes(a, **options), graphemes(b, **options)
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        before, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
    return row[-1]


def subsequence_class(text: str, typed: str) -> int | None:
    """How well letters that were typed in order, if not together, complete a symbol (from 30 on; lower is better): a skip costs 1,
    a skipped capital 2 more, and a capital that was met gains 1. Null if they don't, or if the first letters differ."""
    if not text or not typed or text[0].lower() != typed[0].lower():
        return None
    at = skips = met = passed = 0
    for c in typed:
        start = at
        while at < len(text) and text[at].lower() != c.lower():
            if not (text[at].isalnum() or text[at] in "_@$"):
                return None
            passed += "A" <= text[at] <= "Z"
            at += 1
        if at == len(text):
            return None
        skips += at > start
        met += "A" <= text[at] <= "Z"
        at += 1
    return 30 + skips - met + 2 * passed


def _two(fn, kind: str):
    """A UDF over batches of pairs, each different pair of a batch once."""

    def both(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = pd.MultiIndex.from_arrays([a, b])
        number, once = pairs.factorize()
        found = pd.Series([None if x is None or y is None or x != x or y != y else fn(x, y) for x, y in once] + [None], dtype="object")
        return found.iloc[number].reset_index(drop=True)

    return F.pandas_udf(both, kind)


def grapheme_distance_of(a: Column, b: Column, **options) -> Column:
    return _two(lambda x, y: grapheme_distance(x, y, **options), "long")(a, b)


def partial_ratio_of(a: Column, b: Column) -> Column:
    return _two(partial_ratio, "double")(a, b)


def indel_of(a: Column, b: Column) -> Column:
    return _two(indel_distance, "long")(a, b)


def ngram_score_of(a: Column, b: Column, n: int = 3) -> Column:
    return _two(lambda x, y: ngram_score(n, x, y), "long")(a, b)


def strip_code_of(c: Column) -> Column:
    # row by row, as Arrow batches hold as many whole texts as they have rows
    return F.udf(lambda t: None if t is None else strip_code(t), "string", useArrow=False)(c)


def subsequence_class_of(text: Column, typed: Column) -> Column:
    return _two(subsequence_class, "long")(text, typed)
