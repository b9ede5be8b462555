"""Orders as sort-key columns; top-k by window group limit or by take-ordered, never by a sort of everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, base_name, natural_key, scope_of, symbol_of
from ..tables import cut_lineage


def name_order(name: Column, file: Column, line: Column) -> list[Column]:
    """Without case, then file (as text), then line (a hex number: the shorter is the smaller)."""
    return [ascii_lower(name), file, F.length(line), line]


def scope_order(sym_scope: Column, path: Column, line: Column) -> list[Column]:
    return [sym_scope, ascii_lower(path), line]


def file_list_order(column: str, path: Column, project: Column, time: Column, *, reverse: bool = False) -> list[Column]:
    """A list of files by one of its columns: name, project, path, or time (a number; the latest first); ties by others."""
    low, by_project = F.lower(path), F.lower(project)
    keys = {"name": [base_name(low), low, by_project], "project": [by_project, base_name(low), low], "path": [low, by_project], "time": [-time, low]}[column]
    return [F.desc(k) if reverse else F.asc(k) for k in keys]


def hashtag_order(tag: Column, path: Column, line: Column, *, by_file: bool = False) -> list[Column]:
    return [ascii_lower(path), line, ascii_lower(tag)] if by_file else [ascii_lower(tag), ascii_lower(path), line]


def definition_order(path: Column, line: Column) -> list[Column]:
    return [ascii_lower(base_name(path)), line]


def includes_order(path: Column, text: Column) -> list[Column]:
    """By the file's name; an include that was not resolved stands by its text."""
    return [ascii_lower(F.coalesce(base_name(path), text))]


def inheritance_order(definition: Column) -> list[Column]:
    return [symbol_of(definition), scope_of(definition)]


def position_order(path: Column, line: Column) -> list[Column]:
    return [F.lower(path), line]


def project_order(shared: Column, active: Column) -> list[Column]:
    """Shared projects and those with the active file first, all else as before."""
    return [(~(shared | active)).cast("int")]


def completion_order(name: Column) -> list[Column]:
    """By the first character's class: star, other signs, letters and digits, underscore, ~ and !; then without case, then with."""
    first = F.substring(name, 1, 1)
    kind = F.when(first == "*", -2).when(first.rlike("[A-Za-z0-9]"), 0).when(first == "_", 1).when(first.isin("~", "!"), 2).otherwise(-1)
    return [kind, ascii_lower(name), name]


def own_scope_first(scope: Column, own: str, name: Column) -> list[Column]:
    return [(scope != own).cast("int"), *completion_order(name)]


def type_order(kind: Column, name: Column, scope: Column, path: Column, line: Column) -> list[Column]:
    """Kinds (a go-to marker is a function), names without and with case, scopes, paths, lines."""
    return [F.when(kind == "GOTODEF", "FUNC").otherwise(kind), ascii_lower(name), name, ascii_lower(scope), ascii_lower(path), line]


def natural_order(text: Column) -> Column:
    return natural_key(text)


def place(df: DataFrame, order: list[Column], tie: str, within: list[str], name: str = "place") -> DataFrame:
    """Each row's place in an order, within its group if there are groups. All rows are sorted by ranges and numbered where they
    are; what the tasks before hold is added, so no group is one task's, however large. A group's place begins at its first row."""
    numbered = df.orderBy(*within, *order, F.col(tie)).withColumns({"_task": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    numbered = cut_lineage(numbered.withColumn("_group", F.struct(*within) if within else F.lit(0)))
    rows = numbered.groupBy("_task").agg(F.count("*").alias("_n"))
    # a row for each task of the sort
    before = rows.select("_task", F.coalesce(F.sum("_n").over(W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = numbered.join(F.broadcast(before), "_task").withColumn(name, F.col("_before") + F.col("_at") + 1)
    if within:
        first = placed.groupBy("_group").agg(F.min(name).alias("_first"))
        placed = placed.join(first, "_group").withColumn(name, F.col(name) - F.col("_first") + 1)
    return placed.select(*df.columns, name)


def running(df: DataFrame, within: list[str], order: list[Column], totals: dict[str, tuple[str, Column]], *, before: bool = False) -> DataFrame:
    """Running totals (name: sum, min or max, and of what) of each group in an order, up to each row, or only of the rows before it.
    Rows are sorted by ranges; each task adds up its part of a group, and what a group had in the tasks before is added, so no
    group is one task's."""
    names = {f"_t{i}": x for i, x in enumerate(totals.values())}
    held = cut_lineage(df.withColumns({n: v for n, (_, v) in names.items()}).orderBy(*within, *order).withColumns({"_task": F.spark_partition_id(), "_group": F.struct(*within)}))
    fn = {"sum": F.sum, "min": F.min, "max": F.max}
    own = W.partitionBy("_task", "_group").orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else W.currentRow)
    parts = held.groupBy("_task", "_group").agg(*(fn[k](n).alias(n) for n, (k, _) in names.items()))
    # a row for each task that has rows of a group
    earlier = W.partitionBy("_group").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    carried = parts.select("_task", "_group", *(fn[k](n).over(earlier).alias(f"_c{n}") for n, (k, _) in names.items()))
    both = held.withColumns({f"_r{n}": fn[k](n).over(own) for n, (k, _) in names.items()}).join(carried, ["_task", "_group"])
    add = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}
    return both.select(*df.columns, *(add[k](F.col(f"_r{n}"), F.col(f"_c{n}")).alias(out) for out, (n, (k, _)) in zip(totals, names.items(), strict=True)))


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """Rows with a running count and the number of the batch that it falls into."""
    return place(df, [], order, [], "count").withColumn("batch", F.expr(f"(count - 1) div {size}"))


def first_then_sorted(df: DataFrame, arrival: str, n: int, order: list[Column]) -> DataFrame:
    """The first n rows by arrival, in an order."""
    return df.orderBy(arrival).limit(n).orderBy(*order, arrival)


def top(df: DataFrame, order: list[Column], tie: str, k: int) -> DataFrame:
    """The first k rows (kept per task, then merged)."""
    return df.orderBy(*order, F.col(tie)).limit(k)


def top_in_groups(df: DataFrame, within: list[str], order: list[Column], tie: str, k: int) -> DataFrame:
    row = F.row_number().over(W.partitionBy(*within).orderBy(*order, F.col(tie)))  # each task passes on k rows of a group
    return df.withColumn("place", row).where(F.col("place") <= k)


def kept_then_rest(kept: DataFrame, every: DataFrame, key: list[str], name: str = "part") -> DataFrame:
    """The kept rows (part 0), then all others (part 1)."""
    rest = every.join(kept.select(*key).distinct(), key, "left_anti")
    return kept.withColumn(name, F.lit(0).cast("long")).unionByName(rest.withColumn(name, F.lit(1).cast("long")))


def same_members(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def missing_in_order(expected: DataFrame, present: DataFrame, key: list[str]) -> DataFrame:
    """The expected rows that are not present, with their places."""
    return expected.join(present.select(*key).distinct(), key, "left_anti")


def sorted_lines(text: Column, *, ascending: bool = True, case_sensitive: bool = True, collation: str | None = None) -> Column:
    """The text with its lines in order: by code point, or by a collation (UNICODE, or a language's as ``de``). Lines that are equal
    in that order, as without case, stand by code point."""
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    name = collation if case_sensitive or collation is None else f"{collation}_CI"
    key = (lambda x: F.collate(x, name)) if collation else ascii_lower
    keyed = F.array_sort(lines) if case_sensitive and not collation else F.transform(F.array_sort(F.transform(lines, lambda x: F.struct(key(x).alias("k"), x.alias("v")))), lambda x: x["v"])
    return F.array_join(keyed if ascending else F.reverse(keyed), "\n")
