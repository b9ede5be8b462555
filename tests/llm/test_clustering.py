"""Clustering of distinct vectors beside plain Lloyd rounds over all vectors."""

import hashlib
import math
import random

import pytest
from lexgrove.llm import clustering


def plain(rows, k, rounds, dim):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    drawn = lambda i: hashlib.sha256(f"2:{'null' if i is None else i}".encode()).hexdigest()
    as_bytes = lambda v: b"".join(x.to_bytes(4, "little", signed=True) for x in v)
    centroids = [v for _, v in sorted(good, key=lambda r: (drawn(r[0]), as_bytes(r[1])))[:k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((distance(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = {}
        for _, v in good:
            own.setdefault(near(v)[1], []).append(v)
        for n, members in own.items():
            centroids[n] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [(i, *near(v)) for i, v in good]
    by = {}
    for _, d, n in found:
        by[n] = by.get(n, 0) + d
    return sorted(((i, n, d, by[n], sum(by.values())) for i, d, n in found), key=str), centroids


def run(spark, rows, kind="double", **options):
    frame = spark.createDataFrame([(v, i, 1, b"x") for i, v in rows], f"embedding array<{kind}>, vec_id long, cluster int, vec binary").repartition(3)
    found, centroids = clustering.cluster(frame, **options)
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia) for r in found.collect()), key=str), centroids


@pytest.mark.parametrize("seed", range(2))
def test_equals_plain_rounds(spark, seed):
    rng = random.Random(seed)
    draw = lambda s: [round(rng.gauss(0, s), 2) for _ in range(4)]
    copy = draw(1)
    rows = [(i, draw(rng.choice([0.001, 0.01, 1, 50]))) for i in range(150)] + [(i, copy) for i in range(200, 300)] + [(i, [-x for x in copy]) for i in range(300, 320)]
    rows += rows[:10] + [(None, draw(1)), (None, copy), (900, None), (901, []), (902, draw(1)[:3]), (903, [1.0, None, 0.0, 0.0]), (904, [math.nan, 1.0, 0.0, 0.0]), (905, [math.inf, 0.0, 0.0, 0.0])]
    for k, rounds in ((7, 5), (7, 0), (500, 2)):
        assert run(spark, rows, k=k, rounds=rounds, dim=4) == plain(rows, k, rounds, 4)


def test_large_numbers_stay_exact(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1, 1]) * rng.uniform(2.0**17, 2.0**19) for _ in range(4)]) for i in range(60)]
    assert run(spark, rows, k=5, dim=4) == plain(rows, 5, 5, 4)
    got, _ = run(spark, [(0, [1e300] * 4), (1, [-1e300] * 4)], k=1, rounds=1, dim=4)
    assert [r[2] for r in got] == [4 * clustering.BOUND**2] * 2


def test_floats_and_nothing(spark):
    assert run(spark, [], dim=4) == ([], []) and run(spark, [(1, None)], dim=4) == ([], [])
    got, centroids = run(spark, [(1, [0.1, 0.2])], kind="float", dim=2)
    assert got == [(1, 0, 0, 0, 0)] and centroids == [[25, 51]]
