import math
import random

import numpy as np
import pytest
from lexgrove.llm import nearest
from pyspark.sql import functions as F


def brute(rows, k=5):
    dims = [len(v) for _, v in rows if v]
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == max(set(dims), key=dims.count)]
    out = {}
    for q, a in good:
        if q % 50 == 0:
            scores = [(-float(nearest.cosines(a[None], b[None])[0]), i) for i, b in good if i != q]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def run(spark, rows, **options):
    frame = spark.createDataFrame([(v, i, "x", 1.0) for i, v in rows], "embedding array<float>, vec_id long, vec string, score double").repartition(3)
    got = {}
    for r in nearest.nearest(frame, F.col("vec_id") % 50 == 0, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r["rank"]))
    return got


def test_recall_over_many_blocks(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 16))
    rows = [(i, (centres[i % 20] + 0.4 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(3000)]
    got, want = run(spark, rows, block_rows=200, chunk=20), brute(rows)
    assert set(got) == set(want)
    same = sum(len({i for i, _ in want[q]} & {i for i, _, _ in got[q]}) for q in want)
    assert same >= 0.9 * 5 * len(want)
    for q in want:
        assert [r for _, _, r in got[q]] == [1, 2, 3, 4, 5]
        scores = {i: s for i, s in brute([(q, rows[q][1]), *((i, rows[i][1]) for i, _, _ in got[q])])[q]}
        assert all(abs(scores[i] - s) < 1e-14 for i, s, _ in got[q])
        assert [(i, s) for i, s, _ in got[q]] == sorted(((i, s) for i, s, _ in got[q]), key=lambda x: (-x[1], x[0]))


def test_copies_odd_vectors_and_few_candidates(spark):
    rng = random.Random(2)
    copy = [1.0, 2.0, 0.5, -1.0]
    rows = [(i, copy) for i in range(0, 400, 2)] + [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(1, 100, 2)]
    rows += [(500, None), (550, [0.0] * 4), (600, [1.0, None, 0.0, 0.0]), (650, [math.nan, 1.0, 0.0, 0.0]), (700, [math.inf, 0.0, 0.0, 0.0]), (750, [1.0]), (800, []), (850, [-0.0, 0.0, 0.0, 3.0]), (851, [0.0, -0.0, 0.0, 3.0]), (None, copy)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got, want = run(spark, rows, block_rows=16, confidence=0.9999), brute(rows)
    assert {q: [(i, round(s, 12)) for i, s, _ in v] for q, v in got.items()} == {q: [(i, round(s, 12)) for i, s in v] for q, v in want.items()}
    few = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (50, [0.0, 1.0])]
    assert {q: [i for i, _, _ in v] for q, v in run(spark, few).items()} == {0: [1, 50], 50: [1, 0]}


def test_repeated_rows_and_ids_with_several_vectors(spark):
    rng = np.random.default_rng(4)
    draw = lambda: rng.standard_normal(6).astype(np.float32).tolist()
    copy, twin = draw(), draw()
    rows = [(i, copy) for i in range(44, 58)] + [(i, draw()) for i in range(1, 200)] + [(7, copy)] * 6 + [(100, twin)] + [(i, twin) for i in range(300, 308)]
    rows += [(150, (np.array(copy) * 1.01 + 0.001 * k).astype(np.float32).tolist()) for k in range(12)]  # its own nearest ones
    rows += rows[:]
    frame = spark.createDataFrame([(v, i) for i, v in rows], "embedding array<float>, vec_id long").repartition(3)
    got = {}
    for r in nearest.nearest(frame, F.col("vec_id") % 50 == 0, block_rows=16, confidence=0.9999).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 10)))
    pairs = {(i, tuple(v)) for i, v in rows}
    want = {}
    for q, a in pairs:
        if q % 50 == 0:
            scores = sorted((-float(nearest.cosines(np.array([a]), np.array([b]))[0]), i) for i, b in pairs if i != q)[:5]
            want.setdefault(q, []).extend((n, i, round(-s, 10)) for n, (s, i) in enumerate(scores, 1))
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in want.items()}


def test_exact_ties_and_extreme_vectors(spark):
    rng = np.random.default_rng(6)
    one = rng.standard_normal(8)
    multiples = [(i, (one * 2.0 ** rng.integers(-30, 30)).tolist()) for i in range(60)]  # all cosines are exactly 1
    # multiples that are no powers of two: cosines that differ by rounding alone, in one block and in one bucket
    near = [(i, (one * (1 + i / 7)).tolist()) for i in range(100, 460)]
    extreme = [(1000 + i, (rng.standard_normal(8) * s).tolist()) for i, s in enumerate([1e200, 1e-170, 1e300, 5e-320, 1.0] * 30)]
    for rows, options in ((multiples, {}), (multiples + extreme, {"block_rows": 16}), (near, {"block_rows": 16}), (near + extreme, {"block_rows": 1024})):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
        scaled = [(i, (np.array(v) / 2.0 ** np.frexp(np.abs(v).max())[1]).tolist() if np.abs(v).max() > 1e-300 else np.ldexp(v, 1060).tolist()) for i, v in rows]
        want = {q: [(i, s) for i, s in v] for q, v in brute(scaled).items()}
        got = {}
        for r in nearest.nearest(frame, F.col("vec_id") % 50 == 0, confidence=0.9999, **options).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == want
        if rows is multiples:
            assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("rows", [[], [(0, None)], [(0, [1.0, 2.0])]])
def test_nothing_to_find(spark, rows):
    assert run(spark, rows) == {}


def test_quantiles():
    assert abs(nearest.chi_square_quantile(0.95, 8) - 15.507) < 1e-3
    assert abs(nearest.chi_square_quantile(0.5, 2) - 2 * math.log(2)) < 1e-9
