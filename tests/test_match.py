"""The rank expressions against a plain model of the rules, on random texts and terms."""

import random

import pytest
from lexgrove.operators import match
from pyspark.sql import functions as F

ALPHABET = list("aAbB_.: $1é") + ["ab", "Ab", "\x02"]


def is_ident(c):
    return c.isascii() and (c.isalnum() or c in "_@$") or not c.isascii()


def model(text, term):
    """Scans places from the left, and stops at the first that ranks."""
    text = text.split("\x02")[0].split("\x00")[0]
    if not term.text:
        return int(term.excludes)
    fold = (lambda s: s) if term.case_sensitive else lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    for i in range(len(text)):
        if not fold(text[i:]).startswith(fold(term.text)):
            continue
        beginning = i == 0 or (term.eats_mark and i == 1 and text[0] == term.eats_mark)
        starts = beginning or not is_ident(text[i - 1])
        after = text[i + len(term.text) : i + len(term.text) + 1]
        ends = not after or not is_ident(after)
        if term.ends and not ends or term.starts and not starts:
            continue
        if term.excludes:
            return 0
        return ((5 if beginning else 4 if starts else 3) if term.ends else (4 if beginning else 2 if starts else 1))
    return int(term.excludes)


TERMS = ["a", "A", "ab", ".a", "a.", ".ab.", "-a", "-.b", "-b.", "b", "_", "é", "1.", ".B", "a_", "", ".", "-", "..", "-.a."]


@pytest.mark.parametrize("eats", [None, ":"])
def test_ranks_equal_the_model(spark, eats):
    rng = random.Random(1)
    texts = ["", "a", "ab", ":ab", "b ab", "aab ab"] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(12))) for _ in range(400)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    terms = [match.compile_term(t, eats_mark=eats) for t in TERMS]
    for row in frame.select("i", *(match.rank(F.col("t"), t).alias(f"r{k}") for k, t in enumerate(terms))).collect():
        for k, t in enumerate(terms):
            assert row[f"r{k}"] == model(texts[row.i], t), (texts[row.i], t)


def test_filters(spark):
    frame = spark.createDataFrame([(1, "red ring"), (2, "ring"), (3, "blue ring"), (4, "red gear")], "seq int, t string")
    ids = lambda df: sorted(r.seq for r in df.collect())
    t = F.col("t")
    assert ids(match.filter_set(frame, t, "")) == [1, 2, 3, 4]
    assert ids(match.filter_set(frame, t, "ring -blue")) == [1, 2]
    assert ids(match.filter_set(frame, t, "-ring")) == [4]
    assert match.suggested(match.filter_set(frame, t, "ring"), "seq").first().seq == 2
    assert [r.x for r in frame.select(match.rank_any(t, "gear,red").alias("x")).collect()] == [4, 0, 0, 2]
    assert match.normalise_filter(" a::b--") == "a.b" and match.normalise_filter(".") == "" and match.normalise_filter("a .") == "a"
    assert match.normalise_filter("a.b", mark=":") == "a:b"
    assert ids(frame.where(match.fuzzy_rank(t, match.compile_term("rign")) > 0)) == [1, 2, 3]
    names = spark.createDataFrame([("ThreadingBuildingBlocks",), ("threading_building_blocks",), ("tbl",), ("Tab",)], "t string")
    assert [r.x for r in names.select(match.acronym_rank(t, match.compile_term("tbb")).alias("x")).collect()] == [1, 1, 0, 0]
    assert [r.x for r in names.select(match.completion_class(t, "t").alias("x")).collect()] == [7, 5, 5, 7]
