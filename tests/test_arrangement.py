"""Moved parts, routes and collated lines beside plain versions."""

import random

from lexgrove.functions import fuzzy, text
from lexgrove.operators import graph, joins, sorting
from pyspark.sql import functions as F


def plain_order(parts):
    """parts: (place, target, header) of one class. Dependencies are gathered and spread, then each part that is needed goes before the
    first that needs it."""
    parts = sorted(parts)
    needs = {p: {q for q, t, _ in parts if not t and q < p} for p, target, _ in parts if target}
    heads = {p: 10**6 if h is None else h for p, target, h in parts if target}
    for a in sorted(needs):  # until nothing more is spread
        for _ in needs:
            for b in needs:
                if heads[a] <= heads[b]:
                    needs[a] = needs[a] | needs[b]
    out = []
    methods = sorted(needs, key=lambda p: (heads[p], p))
    for m in methods:
        out += [p for p, _, _ in parts if p in needs[m] and p not in out]
        out.append(m)
    return out + [p for p, target, _ in parts if not target and p not in out]


def test_rearranged_parts(spark):
    rng = random.Random(6)
    rows = []
    for parent in range(40):
        headers = rng.sample(range(50), 12)
        rows += [(parent, parent * 100 + i, rng.random() < 0.5, headers[i] if parent % 5 else (None, 1, 2)[i % 3]) for i in range(rng.randrange(1, 12))]
    got = {}
    for r in graph.rearranged(spark.createDataFrame(rows, "parent long, place long, target boolean, header long").repartition(4)).collect():
        got.setdefault(r.parent, []).append((r.turn, r.place))
    for parent in range(40):
        assert [turn for turn, _ in sorted(got[parent])] == list(range(1, len(got[parent]) + 1))
        own = [p for _, p in sorted(got[parent])]
        assert own == plain_order([(p, t, h) for q, p, t, h in rows if q == parent]), parent


def test_routes(spark):
    listed = [(1, "header", False), (2, "source", False), (3, "header", True), (4, "other", False), (5, "source", False), (6, "header", False), (7, "source", False), (None, "header", False)]
    disk = [(1, 10, 1, "x"), (2, 10, 1, "x"), (3, 10, 1, "x"), (4, 10, 1, "x"), (5, 11, 1, "x"), (6, 11, 1, "y"), (9, 10, 1, "x")]
    indexed = [(1, 10, 1, "x", "project"), (2, 10, 1, "x", "project"), (5, 10, 1, "x", "project"), (6, 10, 1, "x", "solution"), (7, 10, 1, "x", "project"), (8, 10, 1, "x", "system")]
    table = lambda rows, s: spark.createDataFrame(rows, s)
    state = "file_id long, mtime long, size long, hash string"
    found = joins.routed_changes(table(listed, "file_id long, kind string, system boolean"), table(disk, state), table(indexed, state + ", db string"), table([(2,), (5,), (6,)], "file_id long"))
    # 1 as it was, but not loaded; 3 new; 5 touched, the same content; 6 changed; 7 listed but gone; 8 gone; 9 not listed
    assert sorted(map(tuple, found.collect())) == [(1, "load", "global"), (3, "update", "system"), (6, "update", "solution"), (8, "remove", "removed")]


def test_lines_and_comparisons_by_locale(spark):
    frame = spark.createDataFrame([("b\nÉ\ne\na\nZ\nz\nà\nA\nB\n\nzebra\nÄpfel\nApfel",)], "t string")
    lines = lambda **o: frame.select(sorting.sorted_lines(F.col("t"), collation="UNICODE", **o)).first()[0].split("\n")
    assert lines() == ["a", "A", "à", "Apfel", "Äpfel", "b", "B", "e", "É", "z", "Z", "zebra"]
    assert lines(case_sensitive=False) == ["A", "a", "à", "Apfel", "Äpfel", "B", "b", "e", "É", "Z", "z", "zebra"]
    assert lines(ascending=False) == lines()[::-1]
    compared = lambda a, b, **o: frame.select(text.compare(F.lit(a), F.lit(b), **o)).first()[0]
    assert compared("é", "f") == 1 and compared("é", "f", collation="UNICODE") == -1
    assert compared("É", "é", collation="UNICODE") != 0 and compared("É", "é", collation="UNICODE", case_sensitive=False) == 0
    # in Swedish ö stands after z
    assert compared("ö", "z", collation="sv") == 1 and compared("ö", "z", collation="de") == -1


def test_partial_ratio_equals_all_stretches():
    rng = random.Random(1)

    def plain(a, b):
        short, long_ = sorted((a, b), key=len)
        if not short:
            return 100.0 if not long_ else 0.0
        n = len(short)
        pieces = [long_[max(0, s) : s + n] for s in range(1 - n, len(long_))]
        return max(100.0 * (1 - fuzzy.indel_distance(short, p) / (n + len(p))) for p in pieces)

    for _ in range(3000):
        a, b = ("".join(rng.choices("abcdé", k=rng.randrange(0, 9))) for _ in range(2))
        assert abs(fuzzy.partial_ratio(a, b) - plain(a, b)) < 1e-9, (a, b)
    assert fuzzy.lcs_length("", "ab") == 0 and fuzzy.lcs_length("abc", "xaxcx") == 2


def test_steps_are_removed(spark, tmp_path):
    import os

    from lexgrove import tables

    tables.remove_steps(spark)
    step = tables.cut_lineage(spark.range(3))
    (path,) = tables._STEPS
    assert step.count() == 3 and os.path.exists(path.removeprefix("file://"))
    assert tables.remove_steps(spark) == 1 and not os.path.exists(path.removeprefix("file://")) and tables.remove_steps(spark) == 0


def test_running_totals_over_tasks(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.choice([None, rng.randrange(50)])) for i in range(600)]
    frame = spark.createDataFrame(rows, "g string, i long, v long").repartition(4)
    for before in (False, True):
        found = sorting.running(frame, ["g"], [F.desc("i")], {"s": ("sum", F.col("v")), "low": ("min", F.col("v")), "high": ("max", F.col("v"))}, before=before)
        for r in found.collect():
            own = [v for g, i, v in rows if g == r.g and (i > r.i or i == r.i and not before) and v is not None]
            assert (r.s, r.low, r.high) == (sum(own), min(own, default=None), max(own, default=None))
