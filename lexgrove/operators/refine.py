"""Filters that look at the whole set before they apply. What they need to know of it is one row of flags, aggregated with
partial sums and broadcast; no window without partition gathers the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import cut_lineage
from . import overloads


def _guarded(df: DataFrame, keep: Column, **flags: Column) -> DataFrame:
    known = df.agg(*(F.coalesce(v, F.lit(False)).alias(f"_{k}") for k, v in flags.items()))
    return df.join(F.broadcast(known), keep).select(*df.columns)


def unless_empty(df: DataFrame, drop: Column) -> DataFrame:
    """Drops rows, but not if that would drop all."""
    return _guarded(df, ~drop | F.col("_all"), all=F.bool_and(drop))


def generated(path: Column) -> Column:
    """Whether a file's name is that of generated code."""
    name = F.lower(F.substring_index(F.translate(path, "\\", "/"), "/", -1))
    return F.contains(name, F.lit(".generated.")) | name.startswith("moc_") | F.contains(name, F.lit(".gen."))


def preferred_only(df: DataFrame, preferred: Column) -> DataFrame:
    """If any row is preferred, only those."""
    return _guarded(df, preferred | ~F.col("_any"), any=F.bool_or(preferred))


def without_external(df: DataFrame, system: Column, external: Column) -> DataFrame:
    """Rows of external system files go if a row of a proper system file is there."""
    return _guarded(df, ~external | ~F.col("_proper"), proper=F.bool_or(system & ~external))


def active_projects(df: DataFrame, projects: Column, active: list[str]) -> DataFrame:
    """Rows of the active projects, if every row has a project and any has an active one."""
    has = F.arrays_overlap(projects, F.array(*map(F.lit, active)))
    return _guarded(df, has | ~F.col("_known") | ~F.col("_any"), known=F.bool_and(F.size(projects) > 0), any=F.bool_or(has))


def namespace_bodies(df: DataFrame, is_namespace: Column, has_body: Column) -> DataFrame:
    """If all rows are namespaces and any has a body, only those with one."""
    return _guarded(df, has_body | ~(F.col("_all") & F.col("_any")), all=F.bool_and(is_namespace), any=F.bool_or(has_body))


def implementations(df: DataFrame, is_implementation: Column, exactly: int | None = 2) -> DataFrame:
    """If any row is an implementation, only those; by default when there are just two rows."""
    count = F.lit(True) if exactly is None else F.count("*") == exactly
    return _guarded(df, is_implementation | ~(F.col("_any") & F.col("_fits")), any=F.bool_or(is_implementation), fits=count)


def visible(df: DataFrame, hidden: Column, hashtag: Column, reference: Column) -> DataFrame:
    """Without hidden rows, except hashtags' definitions; hashtags' references go."""
    return df.where((~hidden | hashtag) & ~(hashtag & reference))


def project_paths(df: DataFrame, name: str, path: str, in_project: Column) -> DataFrame:
    """Of names with several paths, if any is in a project, only those that are."""
    names = df.groupBy(name).agg((F.min(path) != F.max(path)).alias("_many"), F.bool_or(in_project).alias("_any"))
    return df.join(names, name).where(in_project | ~F.col("_many") | ~F.col("_any")).select(*df.columns)


def without_rules(df: DataFrame, rules: DataFrame, *, tag: str, file: str, directory: str, project: str) -> DataFrame:
    """Drops rows that a rule (kind, value) names: t a tag, f a file, p a project, d a directory or one above it; case
    doesn't count. Directories are matched by equality with a row's ancestors, so no pair of row and rule is formed."""
    out = df
    for kind, column in (("t", tag), ("f", file), ("p", project)):
        values = rules.where(F.col("kind") == kind).select(F.lower("value").alias("_value")).distinct()
        out = out.join(values, F.lower(column) == F.col("_value"), "left_anti")
    above = F.filter(F.split(F.lower(directory), "/"), lambda x: x != "")
    steps = F.transform(F.sequence(F.lit(0), F.size(above)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(above, F.lit(1), i), "/")))
    values = rules.where(F.col("kind") == "d").select(F.concat(F.lit("/"), F.trim(F.lower("value"), F.lit("/"))).alias("_value")).distinct()
    named = out.select(F.lower(directory).alias("_directory"), F.explode(steps).alias("_value")).distinct().join(values, "_value").select("_directory").distinct()
    return out.join(named, F.lower(directory) == F.col("_directory"), "left_anti")


def by_type_mask(df: DataFrame, kind: Column, mask: int) -> DataFrame:
    """Rows whose kind's bit is set in the mask."""
    return df.where(F.call_function("shiftright", F.lit(mask), kind.cast("int")).bitwiseAND(1) != 0)


def implementations_and_declarations(df: DataFrame, is_implementation: Column) -> tuple[DataFrame, DataFrame]:
    return df.where(is_implementation), df.where(~is_implementation)


#: What the pipeline asks of a row.
FLAGS = ("preferred", "is_system", "is_external", "is_namespace", "has_body", "generated", "is_implementation", "in_active", "has_project", "by_count", "variadic")


def _steps(groups: list[dict], language: str, active: bool, call: bool, separate: bool, current: bool, exactly: int | None) -> tuple[list[dict], int | None]:
    """The pipeline over groups of rows that agree in all flags (n of them, the nearest above the caret): those that stay, each
    with its part, and the row that is left out as it is the caret's own."""

    def keep(flag: str, when: bool = True, value: bool = True) -> None:
        if when:
            groups[:] = [g for g in groups if g[flag] == value]

    if active:
        keep("in_active", all(g["has_project"] for g in groups) and any(g["in_active"] for g in groups))
    if language == "js":
        keep("preferred", any(g["preferred"] for g in groups))
    elif language == "c":
        keep("is_external", any(g["is_system"] and not g["is_external"] for g in groups), False)
    elif language == "cs":
        keep("has_body", all(g["is_namespace"] for g in groups) and any(g["has_body"] for g in groups))
    keep("generated", not all(g["generated"] for g in groups), False)
    if call and (fit := overloads.decide(groups)):
        chosen = {g["key"] for g in fit}
        groups[:] = [g | {"part": int(g["key"] not in chosen)} for g in groups if separate or g["key"] in chosen]
    gone = None
    if current and (near := [g for g in groups if g["nearest"]]):
        own = max(near, key=lambda g: g["nearest"])
        gone = own["nearest"][1]
        own["n"] -= 1
        groups[:] = [g for g in groups if g["n"]]
    keep("is_implementation", (exactly is None or sum(g["n"] for g in groups) == exactly) and any(g["is_implementation"] for g in groups))
    return groups, gone


def definition_pipeline(df: DataFrame, *, language: str = "c", active: list[str] | None = None, arguments: int | None = None, call: overloads.Call | None = None, conversions: DataFrame | None = None, separate: bool = False, current: tuple[int, int] | None = None, exactly: int | None = 2) -> DataFrame:
    """Where a definition is: hidden rows go, then paths outside projects, projects that are not active, then by language
    external system rows (c), namespaces without a body (cs) or rows that are not preferred (js), generated files (none of them if
    nothing would be left), overloads that don't fit a call (by its number of ``arguments``, or by ``call``'s types and the
    ``conversions`` between them; if none fits, all stay), the row nearest above the caret (``current``: file_id and line), and
    declarations beside an implementation. separate: overloads that don't fit stay, in ``part`` 1 (the others: 0).

    Each step asks of the rows that are left only whether any or all have a flag, so all steps run over the numbers of rows that
    agree in all flags: rows are read once to count them and once to take those that stay, however many steps there are. Needs the columns
    hidden, is_hashtag, is_reference, name, path, in_project, projects, preferred, is_system, is_external, is_namespace, has_body,
    n_params (for a call: params, n_default, variadic, is_const), file_id, line, seq, is_implementation."""
    c = F.col
    out = project_paths(visible(df, c("hidden"), c("is_hashtag"), c("is_reference")), "name", "path", c("in_project"))
    columns = out.columns
    if call is not None:
        out = overloads.judged(out, call, conversions)
    elif arguments is not None:
        fits = c("n_params") == arguments
        out = out.withColumns({"by_count": fits, "by_type": F.when(fits, 0).otherwise(overloads.NO), "signature": F.when(fits, ""), "variadic": F.lit(False)})
    else:
        out = out.withColumns({"by_count": F.lit(False), "by_type": F.lit(0), "signature": F.lit(None).cast("string"), "variadic": F.lit(False)})
    has = F.arrays_overlap("projects", F.array(*map(F.lit, active))) if active else F.lit(False)
    out = out.withColumns({"in_active": has, "has_project": F.size("projects") > 0, "generated": generated(c("path"))})
    size = F.size("params") if call is not None else F.lit(0)
    bits = [F.when(F.coalesce(c(x), F.lit(False)), "1").otherwise("0") for x in FLAGS]
    flagged = cut_lineage(out.withColumn("_key", F.concat_ws(":", F.concat(*bits), "by_type", size)))
    above = F.when((c("file_id") == current[0]) & (c("line") < current[1]), F.struct("line", "seq")) if current else F.lit(None).cast("struct<line: long, seq: long>")
    counted = flagged.groupBy("_key").agg(F.count("*").alias("n"), F.min("signature").alias("low"), F.max("signature").alias("high"), F.max(above).alias("nearest")).collect()
    groups = []
    for r in counted:  # a row for each combination of flags
        flags, welcome, n_params = r["_key"].split(":")
        groups.append({x: bit == "1" for x, bit in zip(FLAGS, flags, strict=True)} | {"key": r["_key"], "by_type": int(welcome), "n_params": int(n_params), "n": r["n"], "low": r["low"], "high": r["high"], "nearest": r["nearest"] and tuple(r["nearest"]), "part": 0})
    left, gone = _steps(groups, language, active is not None, call is not None or arguments is not None, separate, current is not None, exactly)
    kept = flagged.where(c("_key").isin([g["key"] for g in left]))
    if gone is not None:
        kept = kept.where(c("seq") != gone)
    part = c("_key").isin([g["key"] for g in left if g["part"]]).cast("int").alias("part")
    return kept.select(*columns, *([part] if separate else []))
