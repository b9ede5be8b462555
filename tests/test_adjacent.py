"""De-duplication against the last kept row, beside a plain loop."""

import random

import pytest
from lexgrove.operators import adjacent, overloads
from pyspark.sql import functions as F

COLUMNS = "sym_scope string, path string, file_id long, line long, sym_type string, in_solution boolean, has_body boolean, seq long"


def plain(rows):
    """The list as a loop would fold it: (name, path, file, line, kind, solution, body, seq)."""
    out = []
    key = lambda r: ((r[0] is not None, r[0] or ""), r[1].lower(), r[2], r[3], r[4], r[5], r[6], r[7])
    for r in sorted(rows, key=key):
        p = out[-1] if out else None
        if p is None or p[0] != r[0]:
            out.append(r)
            continue
        apart = (p[2], p[3]) != (r[2], r[3])
        if p[4] == "LINQ_VAR" or r[4] == "LINQ_VAR" or not (p[5] or r[5]):
            continue
        if "GOTODEF" in (p[4], r[4]):
            if p[4] == r[4]:
                if apart:
                    out.append(r)
            elif r[4] == "GOTODEF":
                out[-1] = r
        elif p[4] == r[4]:
            if p[4] in ("CLASS", "STRUCT", "C_INTERFACE"):
                if apart:
                    out.append(r)
            elif p[4] == "FUNC" and apart:
                if p[6] == r[6]:
                    out.append(r)
                elif r[6]:
                    out[-1] = r
        elif apart:
            out.append(r)
    return sorted(r[7] for r in out)


def draw(rng, n, names):
    kinds = ["FUNC", "FUNC", "GOTODEF", "CLASS", "VAR", "STRUCT", "TYPE", "LINQ_VAR", "DEFINE"]
    return [(rng.choice(names), ("a/X.h", "a/x.h", "b.cpp")[f := rng.randrange(3)], f, rng.randrange(6), rng.choices(kinds, [6, 6, 2, 3, 3, 2, 2, 0.3, 1])[0], rng.random() < 0.5, rng.random() < 0.4, i) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_all_branches_equal_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    # one hot name that goes over many segments and tasks, and many that lie within one
    rows = draw(rng, 400, [":hot"] * 6 + [f":n{i}" for i in range(30)] + [None])
    rows += [(":long", "z.h", 9, i, "GOTODEF" if i == 250 else "FUNC" if i % 3 else "VAR", i % 2 == 0, i % 5 == 0, 10_000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    for most in (1, 7, 10_000):
        got = sorted(r.seq for r in adjacent.without_neighbours(df, segment_rows=most).collect())
        assert got == plain(rows)


def test_segments_lead_where_the_fold_goes():
    rng = random.Random(3)
    kinds = ["FUNC", "GOTODEF", "CLASS", "VAR", "LINQ_VAR", "TYPE"]
    for _ in range(300):
        rows = [((rng.choice(kinds), rng.random() < 0.4, rng.random() < 0.5), (0, rng.randrange(4)), i) for i in range(rng.randrange(1, 8))]
        found = {c: (what, end) for c, what, end in adjacent.leads(rows)}
        for c in [None, *((k, s, b) for k in kinds for s in (False, True) for b in (False, True))]:
            kept = adjacent.fold(rows, c)
            if c is None or c[0] != "LINQ_VAR":
                what, end = found[c] if c in found else found[(None, *c[1:])]
                assert (what == adjacent.DROP) == (not kept) and (not kept or end == rows[kept[-1]][0])


def test_odd_tables(spark):
    assert adjacent.without_neighbours(spark.createDataFrame([], COLUMNS)).count() == 0
    rows = [("a", "p", 1, 1, "FUNC", None, None, 1), ("a", "p", 1, 1, "FUNC", None, None, 2), (None, None, None, None, None, None, None, 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], COLUMNS + ", name string")
    assert sorted((r.seq, r.name) for r in adjacent.without_neighbours(df).collect()) == [(1, "x"), (3, "x")]


def overload_rows(spark, rows):
    c = lambda i, p, d=0, v=False, k=False: (i, "f", p, d, v, k)
    return spark.createDataFrame([c(i, *r) for i, r in enumerate(rows)], "seq long, name string, params array<string>, n_default int, variadic boolean, is_const boolean")


def chosen(spark, rows, call, conversions=None):
    judged = overloads.judged(overload_rows(spark, rows), call, conversions).withColumn("n_params", F.size("params")).collect()
    groups = [r.asDict() | {"low": r.signature, "high": r.signature} for r in judged]
    return sorted(g["seq"] for g in overloads.decide(groups))


def test_overloads(spark):
    call = overloads.Call
    # one signature by count: types don't matter; a declaration's defaults hold for its implementation, too
    assert chosen(spark, [(["int", "int"], 1), (["int", "int"],), (["int", "int", "int"],)], call(("Foo",))) == [0, 1]
    # by types: the same type, strings, references, const
    assert chosen(spark, [(["int"],), (["std::string"],), (["char *"],), (["LPCSTR"],), (["const std::string &"],)], call(("const char*",))) == [1, 3]
    assert chosen(spark, [(["const Foo &"],), (["Foo *"],)], call(("const Foo",))) == [0]
    # weaker conversions go if there are better ones, the weakest if there are weak ones
    assert chosen(spark, [(["double"],), (["int"],)], call(("int",))) == [1]
    assert chosen(spark, [(["double"],), (["Foo*"],)], call(("int",))) == [0]
    assert chosen(spark, [(["void*"],), (["Foo*"],)], call(("0",))) == [0]
    assert chosen(spark, [(["unsigned short"],), (["Foo"],)], call(("long",))) == [0]
    assert chosen(spark, [(["Foo *"],), (["int"],)], call(("nullptr",))) == [0]
    assert chosen(spark, [(["void *"],), (["Bar*"],)], call(("Foo*",))) == [0]
    # from a const method no other method can be called; from another one, const ones are second
    assert chosen(spark, [(["int"], 0, False, True), (["int"],)], call(("int",), True)) == [0]
    assert chosen(spark, [(["int"], 0, False, True), (["int"],)], call(("int",))) == [1]
    # base classes, casts and constructors
    known = spark.createDataFrame([("Derived", "Base"), ("Other", "Base")], "from string, to string")
    assert chosen(spark, [(["Base &"],), (["Third"],)], call(("Derived",)), known) == [0]
    assert chosen(spark, [(["Base &"],), (["Third"],)], call(("Base",)), known) == [0]
    assert chosen(spark, [(["Base", "int"],), (["Third", "int"],)], call(("Third", "0")), known) == [1]
    # variadic ones go if there are others, else those with most parameters stay
    assert chosen(spark, [(["int", "..."], 1, True), (["int"],), (["Foo"],)], call(("int",))) == [1]
    assert chosen(spark, [(["int", "..."], 1, True), (["int", "int", "..."], 1, True)], call(("int", "int", "Foo"))) == [1]
    assert chosen(spark, [(["int"],), ([],)], call(())) == [1] and chosen(spark, [], call(("int",))) == []
    assert chosen(spark, [(["Foo"],), (["Bar"],)], call(("int",))) == []
