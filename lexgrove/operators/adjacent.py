"""De-duplication of a sorted list of symbols in which each row is held against the last row that was *kept*.

Rows are sorted by name, path, file and line. A name's first row is kept; then each row is appended, dropped, or put in the
place of the row kept last (``verdict``). That is a fold, so it can't be a window over neighbours; but what it carries from
row to row is small: the kept row's kind, whether it is of the solution, whether it has a body, and its place. So

1. rows that agree in all of these are one (the first of them), and the list is dealt by ranges and cut to *segments*, never
   within a place, so the row kept before a segment always stands elsewhere. Names that lie within one task are settled there;
2. of a name that goes on, each segment says where it leads from each class of the row kept before it;
3. the segments of a name are chained, one small row each; 4. each is folded again from the class that it begins with.

No name is one task's, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower
from ..tables import cut_lineage

#: Kinds with rules of their own (fixed names).
GOTO, FUNCTION, QUERY_VARIABLE = "GOTODEF", "FUNC", "LINQ_VAR"
CLASSES = ("CLASS", "STRUCT", "C_INTERFACE")

APPEND, REPLACE, DROP = "append", "replace", "drop"
#: kind, in the solution, has a body
Class = tuple[str | None, bool, bool]


@lru_cache(1 << 16)
def verdict(kept: Class, row: Class, apart: bool) -> str:
    """What becomes of a row of the same name as the one kept last. apart: they stand at different places."""
    (kind, ours, body), (new, own, new_body) = kept, row
    if QUERY_VARIABLE in (kind, new) or not (ours or own):
        return DROP  # repeats are of use in the solution alone
    if new == GOTO and kind != GOTO:
        return REPLACE
    if kind == GOTO and new != GOTO or not apart:
        return DROP
    if kind == new == FUNCTION and body != new_body:
        return DROP if body else REPLACE
    return APPEND if kind != new or kind in (GOTO, FUNCTION, *CLASSES) else DROP


#: A row in a segment: its class, its place and its number.
Row = tuple[Class, tuple, int]


def fold(rows: list[Row], before: Class | None) -> list[int]:
    """The numbers of the rows that are kept, after a row of class ``before`` that stands elsewhere (None: after none)."""
    kept: list[int] = []
    last, place = before, None
    for own, at, seq in rows:
        what = APPEND if last is None else verdict(last, own, at != place)
        if what == REPLACE and kept:
            kept.pop()
        if what != DROP:
            kept.append(seq)
            last, place = own, at
    return kept


def leads(rows: list[Row]) -> list[tuple[Class | None, str, Class]]:
    """From each class of a row before (None: no row; a kind of null: any that isn't named): what the first row that isn't dropped
    does (drop: all are dropped), and the class of the last row kept. Folds that have kept the same row last are one."""
    kinds = {c[0] for c, _, _ in rows} | {GOTO, FUNCTION, *CLASSES, None}
    open_: list[Class | None] = [None, *((k, ours, body) for k in kinds if k != QUERY_VARIABLE for ours in (False, True) for body in (False, True))]
    first: dict[Class | None, str] = {}
    tracks: dict[int, list[Class | None]] = {}  # the number of the row kept last, and what leads there
    for n, (own, at, _) in enumerate(rows):
        moved: list[Class | None] = []
        for m in list(tracks):
            last, place, _ = rows[m]
            if verdict(last, own, at != place) != DROP:
                moved += tracks.pop(m)
        for c in list(open_):
            what = APPEND if c is None else verdict(c, own, True)
            if what != DROP:
                first[c] = what
                open_.remove(c)
                moved.append(c)
        if moved:
            tracks[n] = moved
    return [(c, first[c], rows[m][0]) for m, own in tracks.items() for c in own] + [(c, DROP, c) for c in open_]


_CLASS = "kind string, solution boolean, body boolean"
_FIELDS = [("seq", pa.int64()), ("segment", pa.int64()), ("name", pa.string()), ("kind", pa.string()), ("solution", pa.bool_()), ("body", pa.bool_()), ("file_id", pa.int64()), ("line", pa.int64())]
ROWS, ROWS_SCHEMA = "seq long, segment long, name string, kind string, solution boolean, body boolean, file_id long, line long", pa.schema(_FIELDS)


def _segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of a task's sorted rows: those kept of names that it has whole, without a segment, and all others with theirs. A task's
    first and last names may go on elsewhere."""
    base, n, first, cut = TaskContext.get().partitionId() << 32, 0, True, False
    name, rows = None, []
    out: list[dict] = []

    def close(whole: bool) -> None:
        if whole:
            out.extend({"seq": seq} for seq in fold(rows, None))
        else:
            out.extend({"seq": seq, "segment": base | n, "name": name, "kind": c[0], "solution": c[1], "body": c[2], "file_id": at[0], "line": at[1]} for c, at, seq in rows)

    for batch in batches:
        for own, kind, solution, body, file_id, line, seq in zip(*(batch.column(c).to_pylist() for c in ("name", "kind", "solution", "body", "file_id", "line", "seq")), strict=True):
            ended = bool(rows) and own != name
            if ended or len(rows) >= most and rows[-1][1] != (file_id, line):
                close(ended and not first and not cut)
                n, cut, first, rows = n + 1, not ended, first and not ended, []
            name = own
            rows.append(((kind, solution, body), (file_id, line), seq))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=ROWS_SCHEMA)
            out.clear()
    if rows:
        close(False)
        yield pa.RecordBatch.from_pylist(out, schema=ROWS_SCHEMA)


def _rows(table: pa.Table) -> list[Row]:
    columns = [table[c].to_pylist() for c in ("kind", "solution", "body", "file_id", "line", "seq")]
    rows = [((k, s, b), (f, x), seq) for k, s, b, f, x, seq in zip(*columns, strict=True)]
    turn = table["turn"].to_pylist()
    return [rows[i] for i in sorted(range(len(rows)), key=turn.__getitem__)]


_LEAD = pa.struct([("none", pa.bool_()), ("kind", pa.string()), ("solution", pa.bool_()), ("body", pa.bool_()), ("first", pa.string()), ("end_kind", pa.string()), ("end_solution", pa.bool_()), ("end_body", pa.bool_())])
_LEADS = f"name string, segment long, leads array<struct<none: boolean, kind: string, solution: boolean, body: boolean, first: string, end_kind: string, end_solution: boolean, end_body: boolean>>"


def _summary(table: pa.Table) -> pa.Table:
    found = [{"none": c is None, **dict(zip(("kind", "solution", "body"), c or (None, None, None), strict=True)), "first": what, **dict(zip(("end_kind", "end_solution", "end_body"), end, strict=True))} for c, what, end in leads(_rows(table))]
    return pa.table({"name": pa.array([table["name"][0].as_py()], pa.string()), "segment": pa.array([table["segment"][0].as_py()], pa.int64()), "leads": pa.array([found], pa.list_(_LEAD))})


_CHAINED = f"segment long, started boolean, {_CLASS}, replaced boolean"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order: the class of the row kept before each, and whether a later segment replaces the last row that it keeps."""
    schema = pa.schema([("segment", pa.int64()), ("started", pa.bool_()), ("kind", pa.string()), ("solution", pa.bool_()), ("body", pa.bool_()), ("replaced", pa.bool_())])
    name, last, held, any_ = None, None, None, False
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if not any_ or row["name"] != name:
                if held:
                    out.append(held | {"replaced": False})
                any_, name, last, held = True, row["name"], None, None
            known = {None if x["none"] else (x["kind"], x["solution"], x["body"]): x for x in row["leads"]}
            found = known.get(last) or known[(None, *last[1:])]
            if found["first"] != DROP and (last is None or last[0] != QUERY_VARIABLE):
                if held:
                    out.append(held | {"replaced": found["first"] == REPLACE})
                held = {"segment": row["segment"], "started": last is not None, "kind": last and last[0], "solution": last and last[1], "body": last and last[2]}
                last = (found["end_kind"], found["end_solution"], found["end_body"])
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if held:
        yield pa.RecordBatch.from_pylist([held | {"replaced": False}], schema=schema)


def _kept(table: pa.Table) -> pa.Table:
    head = {c: table[c][0].as_py() for c in ("started", "b_kind", "b_solution", "b_body", "replaced")}
    kept = fold(_rows(table), (head["b_kind"], head["b_solution"], head["b_body"]) if head["started"] else None)
    return pa.table({"seq": pa.array(kept[: len(kept) - head["replaced"]], pa.int64())})


def without_neighbours(df: DataFrame, *, segment_rows: int = 10_000) -> DataFrame:
    """Symbols (sym_scope, path, file_id, line, sym_type, in_solution, has_body, seq; seq is unique, and a file_id has one path) without the repeats of a
    name: outside the solution one row stays; in it, classes and what differs in kind or place stay, a go-to marker
    takes the place of what it marks, and a function with a body that of one without. Rows of one place stand by kind,
    solution, body, seq. Null names are one name; null flags are false."""
    c = F.col
    flag = lambda x: F.coalesce(c(x).cast("boolean"), F.lit(False))
    rows = df.select(c("sym_scope").alias("name"), ascii_lower(c("path")).alias("path"), c("file_id").cast("long").alias("file_id"), c("line").cast("long").alias("line"), F.coalesce("sym_type", F.lit("")).alias("kind"), flag("in_solution").alias("solution"), flag("has_body").alias("body"), c("seq").cast("long").alias("seq"))
    place = ["name", "path", "file_id", "line"]
    once = rows.groupBy(*place, "kind", "solution", "body").agg(F.min("seq").alias("seq"))
    cut = once.repartitionByRange(*place).sortWithinPartitions(*place, "kind", "solution", "body", "seq").mapInArrow(lambda b: _segments(b, segment_rows), ROWS)
    found = cut_lineage(cut.withColumn("turn", F.monotonically_increasing_id()))
    settled, open_ = found.where("segment is null").select("seq"), found.where("segment is not null")
    leading = open_.groupBy("segment").applyInArrow(_summary, _LEADS)
    chain = leading.repartition("name").sortWithinPartitions("name", "segment").mapInArrow(_chain, _CHAINED)
    begun = chain.select("segment", "started", c("kind").alias("b_kind"), c("solution").alias("b_solution"), c("body").alias("b_body"), "replaced")
    kept = open_.join(begun, "segment").groupBy("segment").applyInArrow(_kept, "seq long")
    return df.join(settled.unionByName(kept).select(F.col("seq").alias("_seq")), F.col("seq") == F.col("_seq"), "left_semi")
