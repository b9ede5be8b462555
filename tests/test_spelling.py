"""Spelling beside an exhaustive search of the dictionary."""

import random

from lexgrove.operators import spelling


def score(n, a, b, shorter_too):
    total = 0
    for j in range(1, n + 1):
        hits = sum(a[i : i + j] in b for i in range(len(a) - j + 1))
        total += hits
        if hits < 2:
            break
    apart = len(b) - len(a)
    return total - max(0, (abs(apart) if shorter_too else apart) - 2)


def exhaustive(word, dictionary):
    roots = sorted(((-score(3, word, w, False), w) for w in dictionary))[:10]
    lost = ["".join("*" if i >= s and (i - s) % 4 == 0 else c for i, c in enumerate(word)) for s in (1, 2, 3)]
    least = sum(score(len(word), word, m, True) for m in lost) // 3 - 1
    found = sorted((-s, w) for _, w in roots if (s := score(len(word), word, w, True)) > least)
    return [(w, -s) for s, w in found[:10]]


def test_resembling_equals_an_exhaustive_search(spark):
    rng = random.Random(4)
    draw = lambda: "".join(rng.choices("abcdeé", k=rng.choice([1, 2, 3, 4, 5, 6, 8, 12])))
    dictionary = sorted({draw() for _ in range(400)})
    words = {draw() for _ in range(60)} | {"a", "zz", "", "abcabcabcabc", dictionary[0]} | {w[::-1] + "x" for w in dictionary[:20]}
    got = {}
    for r in spelling.resembling(spark.createDataFrame([(w, 1) for w in words] + [(None, 2)], "word string, candidate int"), spark.createDataFrame([(w,) for w in dictionary] + [(None,), ("",)], "word string")).collect():
        got.setdefault(r.word, []).append((r.candidate, r.score))
    for w in words:
        want = exhaustive(w, dictionary) if w and w not in dictionary else []
        assert sorted(got.get(w, []), key=lambda x: (-x[1], x[0])) == want, w


def test_most_words_never_meet_by_single_characters(spark):
    """Where two-character grams find enough, nothing else is looked at."""
    dictionary = [f"ab{i:04d}cd" for i in range(300)]
    rows = spelling.resembling(spark.createDataFrame([("ab0120cd5",)], "word string"), spark.createDataFrame([(w,) for w in dictionary], "word string")).collect()
    assert [(r.candidate, r.score) for r in sorted(rows, key=lambda r: (-r.score, r.candidate))] == exhaustive("ab0120cd5", dictionary)


def test_suggestions_take_the_first_edit(spark):
    words = spark.createDataFrame([("lihgt",), ("naive",), ("foto",), ("ligh",), ("redgear",), ("thgilgear",), ("light",)], "word string")
    dictionary = spark.createDataFrame([(w,) for w in ("light", "naïve", "photo", "red", "gear", "lightgear")], "word string")
    got = {(r.word, r.candidate, r.edit) for r in spelling.suggestions(words, dictionary, sets=["iï"], table=[("f", "ph")]).collect()}
    assert {("lihgt", "light", "swap"), ("naive", "naïve", "related"), ("foto", "photo", "replaced"), ("ligh", "light", "missing"), ("redgear", "red gear", "two words")} <= got
    assert {w for w, _, e in got if e == "n-grams"} == {"thgilgear"} and not any(w == "light" for w, _, _ in got)


def test_related_sets_that_share_a_character_are_one(spark):
    words, dictionary = spark.createDataFrame([("xbz",)], "word string"), spark.createDataFrame([("xaz",), ("xcz",), ("xdz",)], "word string")
    assert sorted(r.candidate for r in spelling.related(words, dictionary, ["ab", "cd", "bc"]).collect()) == ["xaz", "xcz", "xdz"]
