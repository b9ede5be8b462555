"""Spelling: dictionary words that a misspelt word may be. Words meet by what they share (what is left when a character goes, a
folded form, an n-gram), so that no word is compared with the whole dictionary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import without_one
from ..tables import cut_lineage

#: How many dictionary words are looked at more closely, and how many are suggested (fixed values).
ROOTS, GUESSES = 10, 10


def swapped(a: Column, b: Column) -> Column:
    """Whether b is a with two neighbours exchanged."""
    swaps = F.transform(F.sequence(F.lit(1), F.length(a) - 1), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))))
    return F.when((F.length(a) > 1) & (F.length(a) == F.length(b)) & (a != b), F.array_contains(swaps, b)).otherwise(False)


def _known(dictionary: DataFrame, word: str) -> DataFrame:
    return dictionary.select(F.col(word).alias("candidate")).where(F.length("candidate") > 0).distinct()


def _asked(words: DataFrame, known: DataFrame, word: str, least: int = 1) -> DataFrame:
    """Different words that the dictionary doesn't have."""
    return words.select(word).where(F.length(word) >= least).distinct().join(known, F.col(word) == F.col("candidate"), "left_anti")


def candidates(words: DataFrame, dictionary: DataFrame, word: str = "word") -> DataFrame:
    """(word, candidate, edit): dictionary words one edit away. Edits: swap of neighbours, a missing, extra or wrong character.
    A word of the dictionary has none."""
    known = _known(dictionary, word)
    asked = _asked(words, known, word)
    left = asked.select(word, F.explode(without_one(F.col(word))).alias("_key"))
    right = known.select("candidate", F.explode(without_one(F.col("candidate"))).alias("_key"))
    a, b = F.col(word), F.col("candidate")
    edit = F.when(swapped(a, b), "swap").when(F.levenshtein(a, b) != 1, None).when(F.length(a) < F.length(b), "missing").when(F.length(a) > F.length(b), "extra").otherwise("wrong")
    return left.join(right, "_key").select(word, "candidate").distinct().withColumn("edit", edit).where("edit is not null")


def two_words(words: DataFrame, dictionary: DataFrame, word: str = "word") -> DataFrame:
    """(word, candidate): two dictionary words that were written as one, with a space between."""
    known = dictionary.select(F.col(word).alias("_part")).distinct()
    c = F.col(word)
    asked = words.select(word).where(F.length(word) > 1).distinct()
    cut = asked.select(word, F.explode(F.sequence(F.lit(1), F.length(c) - 1)).alias("_at")).select(word, F.substring(c, F.lit(1), F.col("_at")).alias("_first"), F.substring(c, F.col("_at") + 1, F.length(c)).alias("_second"))
    first, second = known.withColumnRenamed("_part", "_first"), known.withColumnRenamed("_part", "_second")
    return cut.join(first, "_first", "left_semi").join(second, "_second", "left_semi").select(word, F.concat_ws(" ", "_first", "_second").alias("candidate"))


def related(words: DataFrame, dictionary: DataFrame, sets: list[str], word: str = "word") -> DataFrame:
    """(word, candidate): dictionary words that differ in related characters alone, at any number of places. sets: characters
    that are related, as ``aàâ``; sets with a character in common are one. Words meet by their form with each set's first character."""
    known = _known(dictionary, word)
    first: dict[str, str] = {}
    for own in sets:
        lead = min((first[c] for c in own if c in first), default=own[:1])
        joined = {first[c] for c in own if c in first}
        first = {c: lead if f in joined else f for c, f in first.items()} | dict.fromkeys(own, lead)
    folded = lambda c: F.translate(c, "".join(first), "".join(first.values()))
    asked = _asked(words, known, word, 2)
    return asked.withColumn("_key", folded(F.col(word))).join(known.withColumn("_key", folded(F.col("candidate"))), "_key").select(word, "candidate")


def replaced(words: DataFrame, dictionary: DataFrame, table: list[tuple[str, str]], word: str = "word") -> DataFrame:
    """(word, candidate): dictionary words that come of replacing one occurrence of a pattern of the table (pattern, replacement);
    occurrences may overlap."""
    known, c = _known(dictionary, word), F.col(word)
    at = lambda p: F.filter(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, i, F.lit(len(p))) == p)
    swap = lambda p, r: F.transform(at(p), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.lit(r), F.substring(c, i + len(p), F.length(c))))
    made = [swap(p, r) for p, r in table]
    every = F.array_distinct(reduce(lambda x, y: F.concat(x, y), made, F.array().cast("array<string>")))
    return _asked(words, known, word, 2).select(word, F.explode(every).alias("candidate")).join(known, "candidate", "left_semi").select(word, "candidate")


def ngram_score(a: Column, b: Column, most: Column, *, shorter_too: bool) -> Column:
    """The places of a from which its n-grams (of 1 to ``most`` characters, up to the first length with fewer than two) stand somewhere
    in b, less by what b is longer than a and two; shorter_too: or shorter."""
    hits = lambda n: F.size(F.filter(F.sequence(F.lit(1), F.length(a) - n + 1), lambda i: F.contains(b, F.substring(a, i, n))))
    step = lambda s, n: F.when(s["more"], F.struct((s["score"] + hits(n)).alias("score"), (hits(n) >= 2).alias("more"))).otherwise(s)
    score = F.aggregate(F.sequence(F.lit(1), F.least(most, F.length(a))), F.struct(F.lit(0).alias("score"), F.lit(True).alias("more")), step)["score"]
    apart = F.length(b) - F.length(a)
    return score - F.greatest(F.lit(0), (F.abs(apart) if shorter_too else apart) - 2)


def threshold(a: Column) -> Column:
    """What a suggestion must score more than: less by one than the mean score of the word with every fourth character lost, from
    the second, third and fourth on."""
    kept = lambda start: F.array_join(F.transform(F.sequence(F.lit(0), F.length(a) - 1), lambda i: F.when((i >= start) & ((i - start) % 4 == 0), "*").otherwise(F.substring(a, i + 1, F.lit(1)))), "")
    return F.floor(reduce(lambda x, y: x + y, (ngram_score(a, kept(s), F.length(a), shorter_too=True) for s in (1, 2, 3))) / 3).cast("int") - 1


def _grams(c: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.filter(F.sequence(F.lit(1), F.length(c)), lambda i: i <= F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n))))


def _best(pairs: DataFrame, word: str, score: str, most: int) -> DataFrame:
    turn = F.row_number().over(W.partitionBy(word).orderBy(F.desc(score), "candidate"))
    return pairs.withColumn("_turn", turn).where(F.col("_turn") <= most).drop("_turn")


def resembling(words: DataFrame, dictionary: DataFrame, word: str = "word", *, roots: int = ROOTS, guesses: int = GUESSES) -> DataFrame:
    """(word, candidate, score): for words that are spelt very poorly, of the ``roots`` dictionary words with the best scores of
    1- to 3-grams those whose score of all n-grams is above the word's threshold, the best ``guesses``; ties to the smaller.

    An inverted index of two-character grams finds what a word is scored against. A dictionary word that shares none
    can't score more than the word has characters; where so many have that the last root scores more, the roots are
    those of the whole dictionary. The few other words, mostly short ones, are met by single characters as well."""
    known, a, b = _known(dictionary, word), F.col(word), F.col("candidate")
    asked = _asked(words, known, word)
    score = ngram_score(a, b, F.lit(3), shorter_too=False)

    def scored(some: DataFrame, n: int) -> DataFrame:
        index = known.select("candidate", F.explode(_grams(b, n)).alias("_gram"))
        met = some.select(word, F.explode(_grams(a, n)).alias("_gram")).join(index, "_gram").select(word, "candidate").distinct()
        return _best(met.withColumn("_score", score), word, "_score", roots)

    pairs = cut_lineage(scored(asked, 2))
    settled = pairs.groupBy(word).agg((F.count("*") >= roots).alias("_full"), F.min("_score").alias("_least")).where(F.col("_full") & (F.col("_least") > F.length(word))).select(word)
    rest = asked.join(settled, word, "left_anti")
    top = pairs.join(settled, word, "left_semi").unionByName(scored(rest, 1))
    judged = top.select(word, "candidate", ngram_score(a, b, F.length(a), shorter_too=True).alias("score")).where(F.col("score") > threshold(a))
    return _best(judged, word, "score", guesses)


def suggestions(words: DataFrame, dictionary: DataFrame, word: str = "word", *, sets: list[str] = (), table: list[tuple[str, str]] = ()) -> DataFrame:
    """(word, candidate, edit): all that is near a misspelt word (swap, related, replaced, missing, extra, wrong, two words); for words
    with nothing near, what resembles them (n-grams). A candidate has the first of the edits that make it."""
    order = ["swap", "related", "replaced", "missing", "extra", "wrong", "two words"]
    named = lambda df, edit: df.select(word, "candidate", F.lit(edit).alias("edit"))
    known = _known(dictionary, word)
    near = candidates(words, dictionary, word).unionByName(named(related(words, dictionary, list(sets), word), "related")).unionByName(named(replaced(words, dictionary, list(table), word), "replaced"))
    two = two_words(words, dictionary, word).join(known.withColumnRenamed("candidate", word), word, "left_anti")
    place = F.array_position(F.array(*map(F.lit, order)), F.col("edit"))
    near = cut_lineage(near.unionByName(named(two, "two words")).groupBy(word, "candidate").agg(F.min_by("edit", place).alias("edit")))
    far = words.select(word).join(near.select(word).distinct(), word, "left_anti")
    return near.unionByName(named(resembling(far, dictionary, word), "n-grams"))
