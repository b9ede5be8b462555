import random

import pyarrow as pa
import pytest
from lexgrove.llm import language_id

LANGS = {"aa": "tora kami sura nato ".split(), "bb": "plost grund schlem brakt ".split(), "cc": "éàlé œuvrè çàna ûtré ".split()}


def made(rng, lang, n):
    return " ".join(rng.choice(LANGS[lang]) + rng.choice(LANGS[lang])[:3] for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows = [(i, made(rng, lang, rng.randrange(3, 60)), lang, "x") for i in range(400) for lang in [rng.choice(list(LANGS))]]
    rows += [(900, None, "aa", "x"), (901, "tora", None, "x"), (902, "", "bb", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")


def test_held_out_accuracy_and_odd_texts(spark, labelled, docs):
    model = language_id.train(labelled, buckets=1 << 12)
    assert model.languages == ["aa", "bb", "cc"] and 0 < model.reject_below <= 0.5
    rng = random.Random(2)
    truth = [rng.choice(list(LANGS)) for _ in range(300)]
    test = spark.createDataFrame([(i, made(rng, lang, rng.randrange(2, 40)), 1.0) for i, lang in enumerate(truth)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in language_id.identify(test, model).collect()}
    assert sum(got[i].lang_pred == lang for i, lang in enumerate(truth)) >= 297
    assert all(0 <= r.score <= 1 for r in got.values())
    assert sum(r.accepted for r in got.values()) >= 297
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ... !!"), (4, "漢字"), (5, "tora kami"), (5, "tora kami"), (6, "é"), (7, "– “”")], "doc_id long, text string")
    rows = language_id.identify(odd, model).collect()
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {1, 2, 3, 7} and len(rows) == 8
    assert all((r.score == 0.0 and not r.accepted) for r in rows if r.lang_pred == "und")
    kept = language_id.keep_accepted(docs, model)
    assert kept.schema == docs.schema and kept.where("text is null or trim(text) = ''").count() == 0


def test_a_text_is_judged_alone(labelled):
    """Texts in one batch don't change each other's features."""
    model = language_id.train(labelled.limit(100), buckets=1 << 10)
    texts = ["tora kami", "x", "", "çàna", None, "grund!", "a"]
    both = model.predict(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        one = model.predict(pa.array([t], pa.string()))
        assert one[0][0] == both[0][i] and abs(one[1][0] - both[1][i]) < 1e-9


def test_nothing_to_learn_from(empty, docs):
    model = language_id.train(empty)
    assert {r.lang_pred for r in language_id.identify(docs, model).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def test_labels_of_one_repeated_row(spark, docs):
    rows = [(5, "tora kami sura", "aa")] * 9000 + [(None, "tora nato", "aa")]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), buckets=1 << 10, sample=20)
    assert model.languages == ["aa"]
    assert {r.lang_pred for r in language_id.identify(docs, model).collect()} == {"aa", "und"}


def test_scores_equal_a_plain_network(labelled):
    """The folded table gives what embedding, mean, linear layer and softmax give n-gram by n-gram."""
    model = language_id.train(labelled, buckets=1 << 10)
    k = len(model.languages)
    for text in ["tora kami", "Plost, GRUND!", "çàna ûtré x", "a"]:
        spaced = b" " + bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()) + b" "
        rows = []
        for n in (2, 3, 4):
            for i in range(len(spaced) - n + 1):
                gram = spaced[i : i + n]
                if gram.strip(b" "):
                    code = int.from_bytes(gram, "big")
                    mixed = code * 0x9E3779B1 % 2**32
                    rows.append(model.table[((mixed ^ mixed >> 15) * 0x85EBCA77 % 2**32 >> 8) % (1 << 10)].astype(float))
        logits = (sum(rows) / len(rows) + model.bias) / model.temperature
        p = [float(x) for x in (2.718281828459045 ** (logits - max(logits)))]
        best, score = model.predict(pa.array([text], pa.string()))
        assert best[0] == max(range(k), key=lambda c: p[c]) and abs(score[0] - max(p) / sum(p)) < 1e-6
