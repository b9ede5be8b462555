import random

import pytest

WORDS = "alpha Beta gamma, delta's 42 ÉTÉ naïve ß x-y foo.bar don't J̌ık 漢字 ok! 'some été a1b2 q".split(" ")


@pytest.fixture(scope="session")
def texts():
    """Odd texts: null, empty, white space only, repeats, one long text, special marks, near and exact copies."""
    rng = random.Random(5)
    sentence = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base = sentence(120)
    near = base.split(" ")
    near[60] = "changed"
    unique = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(6)]
    return [
        None, "", " \t\n ", "one", base, base, " ".join(near), base + " tail " + sentence(70), sentence(3000), "a" * 700 + " b",
        "x <|endoftext|> y<|startoftext|>z", "tabs\tand\x0bvertical\x0cfeeds\r\nlines", unique[0], unique[0] + " " + unique[1],
        unique[1] + "\n" + unique[2], "p " * 130, "p " * 130 + "end", unique[3].upper(), unique[3], unique[4], None, "", "İstanbul ΣΑΣ ǅ  nbsp em", "don't we'll I'M o'clock 's",
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents in several partitions with extra columns whose names clash with those the operators use inside."""
    rows = [(i * 7 + 3, t, "en", i, "z", b"k") for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, bucket string, items binary").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
