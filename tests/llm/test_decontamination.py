import random
import re

import numpy as np
import pyarrow as pa
import pytest
from lexgrove.llm import decontamination
from lexgrove.llm.decontamination import find_contamination, n_hit

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, n=10):
    strings = {}
    for item, t in items:
        w = words(t)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            strings.setdefault(tuple(w[i : i + k]), set()).add(str(item) if item is not None else "null")
    for t in texts:
        w, hit, found = words(t), set(), set()
        for i in range(len(w)):
            for k in {len(s) for s in strings}:
                if tuple(w[i : i + k]) in strings and i + k <= len(w):
                    hit |= set(range(i, i + k))
                    found |= strings[tuple(w[i : i + k])]
        yield len(w), len(hit), sorted(found)


ITEMS = [(1, "The quick brown fox jumps over the lazy dog and then it sleeps again"), (2, "un été"), (3, "Solo"), (4, None), (5, "..."), (None, "three word item"), (10, "a b a b a b a b a b a b"), (1, "second text of one two three four five six seven eight nine ten")]
TEXTS = [
    None, "", "nothing here", "xx The QUICK brown fox, jumps over the lazy dog AND then it sleeps yy", "the quick brown fox jumps over the lazy dog and", "the quick brown fox jumps over the lazy dog", "Un Été!", "un", "été solo three word", "item three word item", "a b " * 40, "b a " * 300 + "solo",
    "text of one two three four five six seven eight nine ten un", "été",
]


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_against_brute_force(spark, block_bytes):
    rng = random.Random(1)
    pool = [w for _, t in ITEMS for w in words(t)]
    texts = TEXTS + [" ".join(rng.choice(["a", "b", "solo", "un", "été", rng.choice(pool)]) for _ in range(rng.randrange(500))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, items string, hits int").repartition(3)
    bench = spark.createDataFrame([(i, t, 5) for i, t in ITEMS], "item_id long, text string, doc_id int")
    got = {r.doc_id: (r.n_words, r.n, r["items"]) for r in find_contamination(docs, bench, block_bytes=block_bytes).withColumn("n", n_hit()).collect()}
    assert [got[i] for i in range(len(texts))] == list(brute(texts, ITEMS))


def test_rows_that_repeat_ids_or_have_none_are_judged_alike_by_any_number_of_blocks(spark):
    texts = [*TEXTS, *TEXTS[3:6], "clean text", "the quick brown fox jumps over the lazy dog and solo un été"]
    ids = [None, None, 1, 1, 1, *([None] * 4), *([7] * (len(texts) - 9))]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = [sorted(str((r.doc_id, r.n_words, [tuple(h) for h in r.hits], list(r["items"]))) for r in find_contamination(docs, bench, block_bytes=size).collect()) for size in (1 << 20, 40)]
    assert got[0] == got[1] and len(got[1]) == len(texts)
    counts = sorted(str((r.doc_id, r.n_words, r.n, list(r["items"]))) for r in find_contamination(docs, bench, block_bytes=40).withColumn("n", n_hit()).collect())
    assert counts == sorted(str((i, *found)) for i, found in zip(ids, brute(texts, ITEMS), strict=True))


def test_empty_tables(spark, empty, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(empty, none).count() == 0
    assert {len(r["items"]) for r in find_contamination(docs, none).collect()} == {0}


def test_words_are_compared_by_their_bytes():
    of = lambda *texts: decontamination.Words.of(decontamination.pa.array(texts))
    bench, docs = of("red fox sat", "solo"), of("x RED fox sat y red fox ran", "solo solos")
    pairs = decontamination.np.array([(1, 0), (2, 1), (3, 2), (7, 2), (8, 3), (9, 3)])
    assert docs.same(pairs[:, 0], bench, pairs[:, 1]).tolist() == [True, True, True, False, True, False]


def test_words_of_one_code_are_told_apart(spark, monkeypatch):
    """Where the usual codes of two words of the benchmark meet, others are taken."""
    from lexgrove.llm import arrow_text as at

    texts = pa.array(["red fox", "blue", "Red", None])
    real = at.word_codes
    monkeypatch.setattr(at, "word_codes", lambda raw, starts, ends: real(raw, starts, ends) & np.uint64(0))
    index = decontamination.Index([("1", "red"), ("2", "blue fox")], 10)
    assert index.salt == 1
    found = sorted((int(row), index.names[part.owners[part.bounds[s]]]) for part, _, rows, strings in index.occurrences(decontamination.Words.of(texts, index.salt)) for row, s in zip(rows.tolist(), strings.tolist(), strict=True))
    assert found == [(0, "1"), (2, "1")]
