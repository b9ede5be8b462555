"""What only larger tables or other orders of arrival show, in small."""

import random

import oracle
import pytest
from lexgrove.functions import fuzzy
from lexgrove.operators import graph, joins
from lexgrove.plans.shared import ORACLES, QUERIES
from lexgrove.sources import symbols
from lexgrove.streaming import maintenance
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def changed(spark, tmp_path):
    """A copy of the small tables where some are given by SQL over them."""

    def make(**tables: str) -> str:
        con = oracle.connect(SF_DIR)
        for name in oracle.TABLES:
            rows = tables.get(name, f"SELECT * FROM {name}")
            con.execute(f"COPY ({rows}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        return str(tmp_path)

    return make


def compare(spark, name: str, sf_dir: str) -> str:
    return oracle.differences(spark, oracle.connect(sf_dir), name, QUERIES[name], ORACLES[name], sf_dir)


def test_links_of_a_node_to_itself(spark, changed):
    """Keys of parts reach those that stand for suppliers."""
    refs = spark.createDataFrame([(1, 5, 5, 1, 2, 3), (2, 5, 6, 0, 1, 0), (3, 5, 5, 0, 1, 1)], "seq long, src long, dst long, kind int, attrs long, line int")
    assert sorted(tuple(r) for r in graph.nodes_and_links(refs)[1].collect()) == [(5, 5, 2, 1), (5, 6, 1, 0)]
    sf_dir = changed(lineitem="SELECT * REPLACE (CASE WHEN l_orderkey % 5 = 0 THEN 1000000 + l_suppkey ELSE l_partkey END AS l_partkey) FROM lineitem")
    assert not compare(spark, "graph_links", sf_dir) and not compare(spark, "graph_nodes", sf_dir)


def test_changes_between_a_settled_one_and_a_later_one(spark, changed):
    """A change that comes with the last batch, when the one before it has settled but one after it, which came earlier, has not."""
    times = [(0, 1, "03 04:00"), (17, 1, "09 09:00"), (18, 1, "09 17:00"), (34, 1, "09 13:30"), (51, 1, "19 12:30"), (1, 2, "09 13:00"), (2, 1, "10 12:00"), (3, 2, "19 15:00"), (4, 1, "20 18:00"), (5, 3, "30 23:00")]
    rows = ", ".join(f"({i}, {u}, TIMESTAMP '2024-01-{t}:00')" for i, u, t in [*times, (6, 4, "10 20:00"), (7, 4, "19 16:00"), (68, 4, "19 19:00"), (8, 4, "19 22:00"), (9, 3, "20 23:30")])
    sf_dir = changed(events=f"SELECT CAST(i AS BIGINT) AS event_id, ts, CAST(u AS BIGINT) AS user_id, event_type, value, props FROM (VALUES {rows}) AS v(i, u, ts), (SELECT event_type, value, props FROM events LIMIT 1)")
    assert not compare(spark, "pending_sources", sf_dir)
    assert len(QUERIES["pending_sources"](spark, sf_dir).where("user_id = 4").collect()) == 3


def test_pairs_of_related_files_are_not_shuffled(spark):
    """Also a file of several names is paired once with each other."""
    rows = [(1, "Cat.cpp"), (1, "ICat.h"), (2, "cat.h"), (2, "icat.inl"), (3, "CatImpl.cpp"), (4, "dog.h"), (None, "cat.c")]
    pairs = joins.related_files(spark.createDataFrame(rows, "i long, n string"), "n", "i")
    want = set()
    for i, a in rows:
        k = a.lower().rsplit(".", 1)[0].removesuffix("impl")
        want |= {(i, j) for j, b in rows if i and j and i != j and b.lower().rsplit(".", 1)[0] in {k, "i" + k, k[1:] if k[0] == "i" else k}}
    assert sorted(tuple(r) for r in pairs.collect()) == sorted(want)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")


def plain_closure(edges, roots, depth):
    out, found = {}, set()
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    for root in roots:
        seen, front = {root}, {root}
        for d in range(1, depth + 1):
            front = {b for a in front for b in out.get(a, ())} - seen
            seen |= front
            found |= {(root, n, d) for n in front}
    return found


@pytest.mark.parametrize("depth", [1, 2, 4, 30])
def test_closures_of_many_roots_by_few_nodes(spark, monkeypatch, depth):
    """Roots that go on to few nodes, some of them roots as well, are not carried through the rounds."""
    rng, rows, real = random.Random(depth), [0], graph.cut_lineage

    def counted(df):
        step = real(df)
        rows[0] += step.count()
        return step

    monkeypatch.setattr(graph, "cut_lineage", counted)
    edges = [(i, 1000 + rng.randrange(12)) for i in range(600) for _ in range(1 + i % 2)] + [(1000 + i, 1000 + rng.randrange(30)) for i in range(30) for _ in range(2)] + [(1003, 5), (1004, 7), (5, 5)]
    roots = [*range(600), 1003]
    got = [tuple(r) for r in graph.closure(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(r,) for r in roots], "root long"), depth).collect()]
    assert sorted(got) == sorted(plain_closure(edges, roots, depth))
    assert depth < 30 or rows[0] < len(got) / 3


def test_closure_of_nothing(spark):
    edges = spark.createDataFrame([(1, 2)], "a long, b long")
    assert graph.closure(edges, spark.createDataFrame([(7,)], "root long"), 30).count() == 0


def test_identifiers_are_counted_in_place(spark):
    """Lines aren't shuffled, but for those of texts that share a key."""
    rows = [(1, "a b a\nb\n\na"), (2, "b b"), (3, None), (4, "c a\nc"), (4, "c c\nd"), (None, "a"), (None, "a a\na")]
    frame = lambda part: spark.createDataFrame(part, "i long, t string")
    counts = lambda part: sorted(tuple(r) for r in symbols.identifier_lines(frame(part), F.col("t"), "i").collect())
    assert counts(rows) == [("a", 8, 5), ("b", 4, 3), ("c", 4, 2), ("d", 1, 1)]
    assert counts(rows[:3]) == [("a", 3, 2), ("b", 4, 3)]
    plan = symbols.identifier_lines(frame(rows[:3]), F.col("t"), "i")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(identifier") == 1 and plan.count("Exchange") == 1


def test_code_is_stripped_without_batches_of_whole_texts(spark):
    code = spark.createDataFrame([("a // b",), (None,)], "t string").select(fuzzy.strip_code_of(F.col("t")).alias("s"))
    assert [r.s for r in code.collect()] == ["a ", None]
    assert "ArrowEvalPython" not in code._jdf.queryExecution().executedPlan().toString()


def test_most_recent_of_parts(spark):
    rng = random.Random(4)
    frame = lambda part: spark.createDataFrame(part, "u long, w string, t long")
    rows = [(rng.randrange(3), f"w{rng.randrange(9)}", i // 2) for i in range(60)]
    rng.shuffle(rows)
    top = lambda df: maintenance.most_recent(df, "u", "w", "t", 4).drop("place")
    whole = sorted(tuple(r) for r in maintenance.most_recent(frame(rows), "u", "w", "t", 4).collect())
    merged = maintenance.most_recent(top(top(frame(rows[:20])).unionByName(top(frame(rows[20:])))), "u", "w", "t", 4)
    assert sorted(tuple(r) for r in merged.collect()) == whole and len(whole) == 12


def test_recently_used_items_take_no_call_of_python_for_each_user(spark, monkeypatch):
    monkeypatch.setattr(maintenance, "recently_used", None)
    assert not compare(spark, "streamed_recently_used", SF_DIR)
