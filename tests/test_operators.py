"""Operators on small tables whose results are plain to see; their queries are compared with SQL in test_oracles.py."""

import json
import random

import pytest
from lexgrove.functions import fuzzy, text
from lexgrove.operators import dedup, graph, joins, lookup, refine, sorting
from lexgrove.sources import symbols
from lexgrove.streaming import maintenance
from pyspark.sql import functions as F


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    lit = F.lit
    assert value(text.split_keeping(lit("a\nb\n"))) == ["a\n", "b\n"] and value(text.split_keeping(lit(""))) == []
    assert value(text.ancestors(lit(":a:b:c"))) == ["a", "a:b", "a:b:c"] and value(text.ancestors(lit(""))) == []
    assert value(text.scope_of(lit(":a:b"))) == ":a" and value(text.symbol_of(lit(":a:b"))) == "b" and value(text.scope_of(lit("a"))) == ""
    assert value(text.initials(lit("fooBar_baz"))) == "FBB"
    assert value(text.common_prefix(lit("/a/b/c"), lit("/a/b/d"))) == "/a/b/" and value(text.common_prefix(lit("x"), lit("y"))) == ""
    assert value(text.without_lines(lit("a\nbx\nc"), "x")) == "a\nc"
    assert value(text.line_sorted_hash(lit("b\na\n"))) == value(text.line_sorted_hash(lit("a\nb\n")))
    assert value(text.has_word(lit("a foo_bar foo."), "foo")) and not value(text.has_word(lit("foo_bar éfoo $foo"), "foo"))
    assert value(text.base_name(lit("c:\\x\\y.h"))) == "y.h" and value(text.from_hex(lit("ff"))) == 255
    names = ["a10", "a9", "a09b", "a 1", "A1", "a", "b", "a_1", "a007", "a7"]
    frame = spark.createDataFrame([(n,) for n in names], "n string").orderBy(text.natural_key(F.col("n")), "n")
    assert [r.n for r in frame.collect()] == ["A1", "a", "a 1", "a007", "a7", "a9", "a09b", "a10", "a_1", "b"]


def test_distances():
    rng = random.Random(1)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        assert fuzzy.lcs_length(a, b) == lcs(a, b)
        short, long_ = sorted((a, b), key=len)
        n = len(short)
        pieces = [long_[i : i + n] for i in range(len(long_))] + [long_[:i] for i in range(n)]
        best = max((200 * lcs(short, p) / (len(short) + len(p)) for p in pieces if p and short), default=100.0 if not a and not b else 0.0)
        assert fuzzy.partial_ratio(a, b) == pytest.approx(best)
    assert fuzzy.strip_code('a = "x // y"; // z\n/* b */c') == 'a = ""; \nc'
    assert fuzzy.ngram_score(3, "abc", "abc") == 6 and fuzzy.ngram_score(3, "abc", "") == -1


def test_guards_apply_only_where_they_should(spark):
    frame = lambda rows: spark.createDataFrame(rows, "i int, flag boolean")
    ids = lambda df: sorted(r.i for r in df.collect())
    flag = F.col("flag")
    some, all_, none = frame([(1, True), (2, False)]), frame([(1, True), (2, True)]), frame([(1, False), (2, False)])
    assert (ids(refine.unless_empty(some, flag)), ids(refine.unless_empty(all_, flag))) == ([2], [1, 2])
    assert (ids(refine.preferred_only(some, flag)), ids(refine.preferred_only(none, flag))) == ([1], [1, 2])
    assert ids(refine.implementations(some, flag)) == [1] and ids(refine.implementations(none, flag)) == [1, 2]
    assert ids(refine.implementations(frame([(1, True), (2, False), (3, False)]), flag)) == [1, 2, 3]
    assert ids(refine.namespace_bodies(some, F.lit(True), flag)) == [1] and ids(refine.namespace_bodies(some, flag, flag)) == [1, 2]
    assert ids(refine.without_external(some, F.lit(True), flag)) == [2] and ids(refine.without_external(all_, F.lit(True), flag)) == [1, 2]
    for f in (lambda d: refine.unless_empty(d, flag), lambda d: refine.preferred_only(d, flag), lambda d: refine.implementations(d, flag)):
        assert f(frame([])).count() == 0
    projects = spark.createDataFrame([(1, ["a"]), (2, ["b", "a"]), (3, ["c"])], "i int, p array<string>")
    assert ids(refine.active_projects(projects, F.col("p"), ["a"])) == [1, 2]
    assert ids(refine.active_projects(projects.unionByName(spark.createDataFrame([(4, [])], projects.schema)), F.col("p"), ["a"])) == [1, 2, 3, 4]


def test_dedup_and_lookup(spark):
    rows = spark.createDataFrame([(1, "k", True), (2, "k", False), (3, "m", True)], "seq int, k string, goto boolean")
    assert sorted(r.seq for r in dedup.prefer_flagged(rows, ["k"], F.col("goto"), "seq").collect()) == [2, 3]
    assert sorted(r.seq for r in dedup.drop_unwanted_unless_alone(rows, ["k"], F.col("goto"), "seq").collect()) == [2]
    assert sorted(r.seq for r in dedup.drop_unwanted_unless_alone(rows.where("goto"), ["k"], F.col("goto"), "seq").collect()) == [1, 3]
    assert spark.range(1).select(dedup.first_seen(F.array(*map(F.lit, [3, 1, 3, 2])), 2).alias("v")).first().v == [3, 1]
    path = {r.scope: r["rank"] for r in lookup.lookup_path(spark, ["a", "b", "a"], ["c"], ["d"]).collect()}
    assert path == {"a": 1, "b": 2, "c": -1, "d": -1001, "": -1000}
    assert lookup.lookup_path(spark, []).first()["rank"] == -2000


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (9, 9)], "a long, b long")
    roots = spark.createDataFrame([(1,)], "root long")
    assert sorted((r.node, r.depth) for r in graph.closure(edges, roots, 3).collect()) == [(2, 1), (3, 2), (4, 3)]
    assert sorted(r.node for r in graph.cycles(edges).collect()) == [1, 2, 3, 9]
    aliases = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "name string, target string")
    assert sorted((r.name, r.target, r.hops) for r in graph.resolve_aliases(aliases).collect()) == [("a", "c", 2), ("b", "c", 1), ("x", "y", 1)]
    levels = graph.levels(spark.createDataFrame([(1, 2), (2, 3), (1, 3), (7, 8), (8, 7)], "a long, b long"), spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 7, 8)], "node long"))
    assert sorted((r.node, r.level) for r in levels.collect()) == [(1, 0), (2, 1), (3, 2), (4, 0)]


def test_related_names_and_orders(spark):
    keys = spark.createDataFrame([(n,) for n in ("Widget.cpp", "IWidget.h", "WidgetTests.cpp", "widget2.inl")], "n string").select(joins.related_key(F.col("n")).alias("k"))
    assert [r.k for r in keys.collect()] == ["widget", "iwidget", "widgettests", "widget"]
    names = spark.createDataFrame([(n,) for n in ("_a", "~b", "*c", "b", "B", "#d")], "n string")
    assert [r.n for r in names.orderBy(*sorting.completion_order(F.col("n"))).collect()] == ["*c", "#d", "B", "b", "_a", "~b"]
    assert spark.range(1).select(sorting.sorted_lines(F.lit("b\nA\na"), case_sensitive=False).alias("v")).first().v == "A\na\nb"


def test_sources(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps([{"filename": "a.h", "namespace": "n", "symbols": {"class": ["A", "B"], "enum": ["E"]}}]))
    assert sorted(tuple(r) for r in symbols.read_headers(spark, str(tmp_path / "h.json")).collect()) == [("a.h", "n", "class", "A"), ("a.h", "n", "class", "B"), ("a.h", "n", "enum", "E")]
    assert [r.size for r in symbols.list_files(spark, str(tmp_path), "*.json").collect()] == [(tmp_path / "h.json").stat().st_size]


def test_recently_used_state_over_batches(spark, tmp_path):
    from datetime import datetime

    day = lambda d: datetime(2024, 1, d)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "user long, item string, ts timestamp"
    for rows in ([(1, "a", day(1)), (1, "b", day(2)), (2, "z", day(1))], [(1, "a", day(3)), (1, "c", day(4))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        used = maintenance.recently_used(spark.readStream.schema(schema).parquet(source), "user", "item", "ts", most=2)
        used.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(1, 1, "c"), (1, 2, "a")]
