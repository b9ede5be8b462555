import random
import re

import pytest
from lexgrove.llm.components import components
from lexgrove.llm import jaccard_join
from lexgrove.llm import repeats as r
from lexgrove.llm.jaccard_join import near_duplicates
from pyspark.sql import functions as F


def shingles(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def roots(n, edges):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in edges:
        up[find(a)] = find(b)
    return [find(i) for i in range(n)]


def brute(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    edges = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = roots(len(rows), edges)
    least = {}
    for (i, _), k in zip(rows, root, strict=True):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    return [(i, len(s), None if i is None else least[k]) for (i, _), s, k in zip(rows, sets, root, strict=True)]


def corpus(rng, n):
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(60))
    common = " ".join(word() for _ in range(12))
    texts = [None, "", " ", "one two", "One  TWO", "one two three four five", "one two three four"]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.55 and len(texts) > 20:
            t = (rng.choice(texts[7:]) or "z").split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                t[rng.randrange(len(t))] = word()
            if rng.random() < 0.3:
                t = t[: max(5, int(len(t) * rng.choice([0.76, 0.8, 0.95])))]
            texts.append(" ".join(t))
        else:
            texts.append(" ".join([common] * rng.randrange(3) + [word() for _ in range(rng.choice([6, 30, 80]))]))
    return texts


@pytest.mark.parametrize(("seed", "probes", "rows", "stretch"), [(1, 6, 1000, 1 << 24), (2, 1, 7, 3000), (3, 2, 3, 1500), (4, 0, 1000, 1 << 24)])
def test_components_equal_brute_force(spark, seed, probes, rows, stretch):
    rng = random.Random(seed)
    texts = corpus(rng, 260)
    ids = rng.sample(range(-100, 10**6), len(texts))
    ids[30], ids[31], ids[50] = ids[32], ids[32], None
    data = list(zip(ids, texts, strict=True))
    data += data[60:64]
    frame = spark.createDataFrame([(i, t, "k", 1) for i, t in data], "doc_id long, text string, set_key string, n int").repartition(4)
    got = near_duplicates(frame, probes=probes, group_rows=rows, query_rows=rows, stretch=stretch).collect()
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(str, brute(data)))


def test_many_near_copies_of_one_text_and_patterned_words(spark):
    """Near copies about the threshold, many of which link with few others; and words that a polynomial can't tell apart."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(90)]
    texts = []
    for _ in range(500):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            t[rng.randrange(len(t))] = f"x{rng.randrange(30)}"
        texts.append(" ".join(t))
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    texts += [one, one.translate(str.maketrans("ab", "ba"))]
    data = list(zip(rng.sample(range(10**6), len(texts)), texts, strict=True))
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    want = sorted(map(str, brute(data)))
    for options in ({}, {"probes": 1, "group_rows": 40, "query_rows": 30, "group_tokens": 3000}):
        got = near_duplicates(frame, **options).collect()
        assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == want


def test_near_misses_about_a_common_passage_are_no_candidates(spark):
    """Documents that share 80 of 100 shingles don't link; what is looked at grows with documents, not with pairs. Those of
    fitting sizes still find each other."""
    rng = random.Random(3)
    core = " ".join(f"w{k}" for k in range(84))
    own = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    found = []
    for n in (400, 1600):
        texts = [f"{core} {own(20)}" for _ in range(n)] + [f"{core} {own(8)}", f"{core} {own(7)}"]
        data = list(zip(rng.sample(range(10**6), len(texts)), texts, strict=True))
        frame = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
        counted = []
        got = near_duplicates(frame, group_rows=50, query_rows=50, counted=counted).collect()
        component = {r.doc_id: r.component_id for r in got}
        short = sorted(i for i, _ in data[-2:])
        # the two short ones link (80 of 95), and with the others they don't: 80 of 107
        sizes = {i: len(shingles(t)) for i, t in data}
        assert set(sizes.values()) == {100, 88, 87}
        assert all(component[i] == c for i, _, c in brute(data[-60:])) and component[short[1]] == short[0]
        found += counted
    assert max(found) <= 2 * 1600 / 50 + 1602


def test_no_bucket_has_the_settled_tokens_of_many_stretches(spark):
    texts = [" ".join(f"w{k}" for k in range(40))] * 2 + [" ".join(f"w{k}" for k in range(38))] * 2
    frame = r.prepared(spark.createDataFrame([(i, texts[i % 4]) for i in range(1600)], "doc_id long, text string").repartition(8), "doc_id", "text")
    rows = frame.mapInArrow(lambda b: jaccard_join._scan(b, 5, 64, 1500), r.ROW)
    for kind in (jaccard_join.SHARED, r.TABLE):
        held = [x.n for x in rows.where(F.col("kind") == kind).groupBy("bucket").agg(F.count_distinct("stretch").alias("n")).collect()]
        assert sum(held) >= 50 and max(held) <= 0.15 * sum(held)


def test_nothing(empty):
    assert near_duplicates(empty).count() == 0


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(1)
    n = 300
    edges = [(i, i + 1) for i in range(80)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(160, n), rng.randrange(160, n)) for _ in range(90)] + [(5, 5)]
    rng.shuffle(edges)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = roots(n, edges)
    least = {}
    for i in range(n):
        least.setdefault(root[i], i)
    assert [got.get(i, i) for i in range(n)] == [least[root[i]] for i in range(n)]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
