"""Functions and operators without SQL beside plain versions, and small cases whose results are plain to see."""

import random
from datetime import datetime, timedelta

import pytest
from lexgrove.functions import fuzzy, text
from lexgrove.operators import graph, joins, lookup, match, sorting, spelling
from lexgrove.streaming import maintenance
from pyspark.sql import functions as F


def test_stripped_code_equals_a_state_machine():
    def plain(code):
        out, i = [], 0
        while i < len(code):
            if code.startswith("//", i):
                while i < len(code) and code[i] != "\n":
                    i += 1
            elif code.startswith("/*", i):
                end = code.find("*/", i + 2)
                i = len(code) if end < 0 else end + 2
            elif code[i] in "\"'":
                quote = code[i]
                i += 1
                while i < len(code) and code[i] not in (quote, "\n"):
                    if code[i] == "\\":
                        if i + 1 == len(code):
                            break
                        i += 1
                    i += 1
                if i < len(code) and code[i] == quote:
                    i += 1
                out.append(quote * 2)
            else:
                out.append(code[i])
                i += 1
        return "".join(out)

    rng = random.Random(2)
    for _ in range(3000):
        code = "".join(rng.choice(["/", "/", "*", '"', "'", "a", "\n", " ", "\\a"]) for _ in range(rng.randrange(14)))
        assert fuzzy.strip_code(code) == plain(code), code


def test_graphemes_and_subsequences():
    assert fuzzy.graphemes("éa") == ["é", "a"] == fuzzy.graphemes("éa") and fuzzy.graphemes("Éa", marks=False, case=False) == ["e", "a"]
    assert fuzzy.grapheme_distance("résumé", "résumé") == 0 and fuzzy.grapheme_distance("résumé", "resume") == 2 and fuzzy.grapheme_distance("résumé", "RESUME", marks=False, case=False) == 0
    assert fuzzy.grapheme_distance("", "ab") == 2 and fuzzy.grapheme_distance("kitten", "sitting") == 3
    assert fuzzy.subsequence_class("redGear", "rdg") == 30 + 1 - 1 and fuzzy.subsequence_class("redGear", "rr") == 30 + 1 + 2
    assert fuzzy.subsequence_class("red", "x") is None and fuzzy.subsequence_class("red-gear", "rg") is None and fuzzy.subsequence_class("", "r") is None


def test_udfs_keep_nulls_and_repeats(spark):
    frame = spark.createDataFrame([("ab", "ab"), (None, "ab"), ("ab", None), ("ab", "ab"), ("x", "")], "a string, b string").coalesce(1)
    assert [r.d for r in frame.select(fuzzy.grapheme_distance_of(F.col("a"), F.col("b")).alias("d")).collect()] == [0, None, None, 0, 1]
    assert [r.d for r in frame.select(fuzzy.partial_ratio_of(F.col("a"), F.col("b")).alias("d")).collect()] == [100.0, None, None, 100.0, 0.0]


def test_text_functions(spark):
    value = lambda c: spark.range(1).select(c.alias("v")).first().v
    lit = F.lit
    assert value(text.reverse_find(lit("abcabc"), "bc")) == 4 and value(text.reverse_find(lit("abc"), "x")) == -1
    assert value(text.find_one_of(lit("a-b]c"), "]-")) == 1 and value(text.find_one_of(lit("abc"), "]^")) == -1
    assert value(text.trim_word(lit(" (foo_1) "))) == "foo_1" and value(text.trim_word(lit("()"))) == ""
    assert value(text.token_field(lit("a,b;c"), ",;", 2)) == "c" and value(text.token_field(lit("a"), ",", 5)) == "" and value(text.token_count(lit("a,b;c"), ",;")) == 2
    assert value(text.replace_word(lit("foo foobar $foo foo"), "foo", "$1\\")) == "$1\\ foobar $foo $1\\"
    assert value(text.minimum_name(lit(":a:b:c"), lit(":a:b:c:d"))) == ":c" and value(text.minimum_name(lit(":a:b"), lit(":x:b"))) == ":a:b" and value(text.minimum_name(lit("a:b"), lit(":a"))) == "a:b"
    assert value(text.shortest_name(lit(":a:b:c"), F.split(lit(":\f:x\f:a\f:a:b"), "\f"))) == ":c"
    assert value(text.decode_scope(text.encode_scope(lit("a<b> c,*d!")))) == "a<b> c,*d!"
    assert [value(f(lit(t))) for f in (text.is_lower, text.is_upper, text.has_upper) for t in ("a_1", "A_1", "é", "", "aB")] == [True, False, False, False, False, False, True, False, False, False, False, True, False, False, True]
    assert value(text.byte_offset(lit("aéb"), 2)) == 3 and value(text.url_query(lit("a b~*é"))) == "a%20b~%2A%C3%A9"
    assert value(text.date_passed(lit("x"), F.current_timestamp())) and not value(text.date_passed(lit("9999.01.01"), F.current_timestamp()))
    assert value(text.relative_path(lit("/a/b/c"), "/a")) == "b/c" and value(text.relative_path(lit("/ab/c"), "/a")) == "/ab/c"


def test_spelling(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(60)}
    asked = {"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 6))) for _ in range(60)}

    def edits(w):
        cut = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        return {a + b[1] + b[0] + b[2:] for a, b in cut if len(b) > 1} | {a + b[1:] for a, b in cut if b} | {a + c + b for a, b in cut for c in "abcd"} | {a + c + b[1:] for a, b in cut if b for c in "abcd"}

    frame = lambda x: spark.createDataFrame([(w,) for w in sorted(x)], "word string")
    got = {(r.word, r.candidate) for r in spelling.candidates(frame(asked), frame(words)).collect()}
    assert got == {(w, c) for w in asked - words for c in edits(w) & words}
    two = {(r.word, r.candidate) for r in spelling.two_words(frame(asked), frame(words)).collect()}
    assert two == {(w, f"{w[:i]} {w[i:]}") for w in asked for i in range(1, len(w)) if w[:i] in words and w[i:] in words}


def test_places_over_ranges(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab") if rng.random() < 0.9 else None, rng.randrange(5)) for i in range(500)]
    frame = spark.createDataFrame(rows, "i int, g string, k int").repartition(7)
    everyone = sorted(rows, key=lambda r: (r[2], r[0]))
    assert {r.i: r.place for r in sorting.place(frame, [F.col("k")], "i", []).collect()} == {r[0]: n for n, r in enumerate(everyone, 1)}
    groups = {r[0]: n for g in ("a", "b", None) for n, r in enumerate((x for x in everyone if x[1] == g), 1)}
    assert {r.i: r.place for r in sorting.place(frame, [F.col("k")], "i", ["g"]).collect()} == groups
    assert sorting.place(frame.limit(0), [F.col("k")], "i", ["g"]).count() == 0


def test_as_of_over_buckets(spark):
    rng = random.Random(5)
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    left = [(i, rng.randrange(3), at(rng.randrange(300))) for i in range(200)]
    right = [(i, rng.randrange(3), at(rng.randrange(300)), rng.choice([None, 1.5, float(i)])) for i in range(120)]
    got = joins.as_of(spark.createDataFrame(left, "id int, k int, t timestamp"), spark.createDataFrame(right, "n int, k int, t timestamp, v double"), "k", "t", "t", "v", "n", bucket_seconds=7200 * 5)
    want = {}
    for i, k, t in left:
        before = [r for r in right if r[1] == k and r[2] < t]
        want[i] = max(before, key=lambda r: (r[2], r[0]))[3] if before else None
    assert {r.id: r.asof_v for r in got.collect()} == want


def test_cycles_and_levels_have_no_limit(spark):
    ring = [(i, (i + 1) % 20) for i in range(20)] + [(3, 100), (100, 101), (200, 201), (201, 200), (101, 200)]
    found = {r.node for r in graph.cycles(spark.createDataFrame(ring, "a long, b long")).collect()}
    assert found == {*range(20), 200, 201}
    chain = [(i, i + 1) for i in range(51)]
    levels = graph.levels(spark.createDataFrame(chain, "a long, b long"), spark.createDataFrame([(i,) for i in range(52)], "node long"))
    assert {r.node: r.level for r in levels.collect()} == {i: i for i in range(52)}


def test_updates_and_removal(spark):
    rows = spark.createDataFrame([(1, "a", 0), (2, "b", 2), (3, None, 1)], "i int, k string, flags int")
    changes = spark.createDataFrame([("a", 5), ("a", 7)], "k string, flags int")
    assert sorted((r.i, r.flags) for r in joins.update_where(rows, changes, ["k"], "flags").collect()) == [(1, 7), (2, 2), (3, 1)]
    kept, gone = joins.purge_missing(rows, spark.createDataFrame([("b",)], "k string"), "k")
    assert sorted(r.i for r in kept.collect()) == [2, 3] and [r.k for r in gone.collect()] == ["a"]
    assert [r.flags for r in joins.mark_removed(rows, gone, "k", "flags", 8).orderBy("i").collect()] == [8, 2, 1]
    assert lookup.find_match(rows, {"k": None, "flags": 1}).first().i == 3


def test_narrowing_filters():
    assert match.narrows("re", "red") and not match.narrows("", "r") and not match.narrows("re", "ro")
    assert not match.narrows("a", "a,b") and not match.narrows("a -b", "a -bc") and match.narrows("a -b", "a -b c")


def test_work_that_waits(spark, tmp_path):
    source, queue, done = (str(tmp_path / x) for x in ("in", "queue", "done"))
    for rows in ([(1, "low"), (2, "low"), (3, "high")], [(4, "wait"), (5, "low")], [(6, "high")]):
        spark.createDataFrame(rows, "i long, k string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("i long, k string").option("maxFilesPerTrigger", 1).parquet(source)
    work = maintenance.drain(queue, done, ready=F.col("k") != "wait", urgent=F.col("k") == "high", most=1, order="i")
    maintenance.run_batches(stream, work, str(tmp_path / "c"))
    rows = sorted((r.i, r.batch) for r in spark.read.schema("i long, k string, batch int, step int").parquet(done).collect())
    assert {i: b for i, b in rows}.keys() == {1, 2, 3, 5, 6} and len(rows) == 5
    assert [r.i for r in spark.read.parquet(f"{queue}/after=2").collect()] == [4]


@pytest.mark.parametrize("language", ["c", "cs"])
def test_graph_nodes(spark, language):
    columns = "file_id int, scope string, sym string, def string, sym_scope string, sym_type string, is_system boolean, is_local boolean"
    rows = [(1, ":a", "x", "d", ":a:x", "VAR", False, False), (0, ":a", "x", "d", "s", "VAR", False, False), (1, "", "x", "d", "s", "VAR", False, False), (1, "", "MACRO", "d", "s", "FUNC", False, False), (1, "", "N", "d", "s", "NAMESPACE", False, False), (1, ":a", "base", "d", "s", "VAR", False, False)]
    got = [r.ok for r in spark.createDataFrame(rows, columns).select(lookup.is_graph_node(language=language).alias("ok")).collect()]
    assert got == [True, False, False, False, False, language == "c"]
