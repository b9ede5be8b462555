"""Lookups of symbols by name and scope, exact or along a ranked path of scopes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, is_upper

#: Kinds of symbols that are objects (fixed names).
OBJECT_TYPES = ("CLASS", "STRUCT", "TYPE", "ENUM", "INTERFACE", "NAMESPACE", "TEMPLATETYPE", "MODULE", "TAG")

#: Ranks of a lookup path's entries (fixed values).
GLOBAL, NO_PATH_GLOBAL, USING = -1000, -2000, 1000


def select_dbs(tables: dict[int, DataFrame], mask: int) -> DataFrame:
    """The union of the tables whose bit is set."""
    chosen = [t for bit, t in tables.items() if mask & bit]
    if not chosen:
        return next(iter(tables.values())).limit(0)
    out = chosen[0]
    for t in chosen[1:]:
        out = out.unionByName(t)
    return out


def in_scopes(symbols: DataFrame, scopes: list[str], *, kind: str | None = None, file_id: int | None = None) -> DataFrame:
    """Symbols of some scopes; of one kind or one file if asked. Globals are left out, except when a file is given."""
    out = symbols.where(F.col("scope").isin(scopes))
    if file_id is not None:
        return out.where(F.col("file_id") == file_id)
    out = out.where(F.col("scope") != "")
    return out.where(F.col("sym_type") == kind) if kind else out


def exact(symbols: DataFrame, sym: str, scope: str | None = None, max_items: int | None = None, order: str = "seq") -> DataFrame:
    """Symbols of a name, in a scope or in any; the first ``max_items`` if given."""
    out = symbols.where(F.col("sym") == sym)
    out = out if scope is None else out.where(F.col("scope") == scope)
    return out if max_items is None else out.orderBy(order).limit(max_items)


def first_source(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """For each key, the rows of the first source that has any."""
    every = None
    for i, s in enumerate(sources):
        s = s.withColumn("source_no", F.lit(i))
        every = s if every is None else every.unionByName(s)
    best = every.groupBy(*key).agg(F.min("source_no").alias("source_no"))
    return every.join(best, [*key, "source_no"])


def fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first table, or the second if the first is empty; both are read once, and the test is one row."""
    empty = first.limit(1).agg((F.count("*") == 0).alias("_empty"))
    return first.unionByName(second.join(F.broadcast(empty), F.col("_empty")).drop("_empty"))


def lookup_path(spark: SparkSession, scopes: list[str], inherited: list[str] = (), using: list[str] = ()) -> DataFrame:
    """(scope, rank): deeper scopes of the path are higher, then the inherited ones, then those in use, then the global
    scope. Of a repeated scope the first entry counts. The list is the caller's, so its size is bounded by the call."""
    ranks: dict[str, int] = {}
    for i, s in enumerate(scopes):
        ranks.setdefault(s, i + 1)
    for i, s in enumerate(inherited):
        ranks.setdefault(s, -(i + 1))
    for i, s in enumerate(using):
        ranks.setdefault(s, -(i + 1 + USING))
    ranks.setdefault("", GLOBAL if ranks else NO_PATH_GLOBAL)
    return spark.createDataFrame(list(ranks.items()), "scope string, rank int")


def ranked(symbols: DataFrame, path: DataFrame, *, texts: int = 10, length: int = 2250) -> DataFrame:
    """For each symbol name, its best rank along the path, the first row of that rank, and the different definitions of
    that rank joined with form feeds (the first ``texts`` of them, cut to ``length``). Names are counted in parts, and of a name
    only so many definitions meet in a task."""
    hits = symbols.join(path, "scope")
    once = hits.groupBy("sym", "rank", "def").agg(F.min("seq").alias("seq"))
    best = once.groupBy("sym").agg(F.max("rank").alias("rank"))
    top = once.join(best, ["sym", "rank"]).withColumn("_k", F.row_number().over(W.partitionBy("sym").orderBy("seq"))).where(F.col("_k") <= texts)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "def"))), lambda x: x["def"]), "\f")
    return top.groupBy("sym", "rank").agg(F.min("seq").alias("seq"), F.substring(joined, 1, length).alias("defs"))


def members(symbols: DataFrame, path: DataFrame) -> DataFrame:
    """Members along the path, those that a nearer scope overrides left out: of inherited ones (ranks between -1000 and 0)
    the highest for each symbol stays."""
    hits = symbols.join(path, "scope")
    inherited = (F.col("rank") < 0) & (F.col("rank") > GLOBAL)
    best = hits.where(inherited).groupBy("sym").agg(F.max("rank").alias("_best"))
    return hits.join(best, "sym", "left").where(~inherited | (F.col("rank") == F.col("_best"))).drop("_best")


def with_prefix(symbols: DataFrame, prefix: str, path: DataFrame | None = None) -> DataFrame:
    """Distinct (sym, scope) whose name begins with the prefix but for case, in the path's scopes if one is given."""
    hits = symbols.where(ascii_lower(F.col("sym")).startswith(prefix.lower()))
    hits = hits if path is None else hits.join(path.select("scope"), "scope", "left_semi")
    return hits.select("sym", "scope").distinct()


def _shortened(definition: Column, width: int) -> Column:
    """The first of several definitions, cut to a width."""
    first = F.substring_index(definition, "\f", 1)
    return F.when(F.length(first) > width, F.concat(F.substring(first, 1, width - 3), F.lit("..."))).otherwise(first)


def definitions(symbols: DataFrame, sym: str, scope: str | None = None, *, closures: DataFrame | None = None, width: int = 150, most: tuple[int, int] = (50, 10)) -> DataFrame:
    """Definitions of a symbol, shortened: in a scope, in scopes whose ``closures`` (scope, base) have it, or in any. At most 50
    in a scope and of hashtags, 10 in any. A name that begins with `#` finds hashtags alone, and no other name finds one."""
    is_tag = sym.startswith("#")
    hits = symbols.where((F.col("sym") == sym) & F.col("file_id").isNotNull() & ((F.col("sym_type") == "HASHTAG") == is_tag))
    if closures is not None:
        hits = hits.join(closures.where(F.col("base") == scope).select("scope").distinct(), "scope", "left_semi")
    elif scope is not None:
        hits = hits.where(F.col("scope") == scope)
    limit = most[0] if scope is not None or is_tag else most[1]
    return hits.orderBy("seq").limit(limit).withColumn("def", _shortened(F.col("def"), width))


def find_match(symbols: DataFrame, record: dict) -> DataFrame:
    """Rows that agree with a record in all its fields; null agrees with null."""
    out = symbols
    for field, value in record.items():
        out = out.where(F.col(field).eqNullSafe(F.lit(value)))
    return out


def is_graph_node(*, language: str = "c", system: bool = False) -> Column:
    """Whether a symbol (file_id, scope, sym, def, sym_scope, sym_type, is_system, is_local) is a node of a code graph: it has a
    file and a definition that is neither hidden nor its own name, is no local, no template argument, and a global only as
    a type or function (or, in managed code, a type or namespace); no upper-case global that may be a macro."""
    c, kind, is_global = F.col, F.col("sym_type"), F.col("scope") == ""
    managed, types = language in ("cs", "vb"), ("CLASS", "STRUCT", "TYPE", "ENUM", "INTERFACE")
    rules = [c("file_id") != 0, c("def") != c("sym_scope"), ~is_global | kind.isin(*types, "FUNC"), ~c("is_local"), c("def") != " ", kind != "TEMPLATETYPE"]
    if managed:
        rules += [~is_global | kind.isin(*types, "NAMESPACE")]
    if not system:
        rules += [~c("is_system")]
    if language == "c":
        rules += [~is_global | ~is_upper(c("sym")) | kind.isin("CLASS", "STRUCT", "NAMESPACE")]
    if language == "cs":
        rules += [c("sym") != "base"]
    return reduce(lambda x, y: x & y, (F.coalesce(r, F.lit(False)) for r in rules))


def is_object(kind: Column) -> Column:
    return kind.isin(*OBJECT_TYPES)


def flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def header_of(headers: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(symbol, file, kind): each symbol's header (file, kind, symbol) by the first of some kinds of lists that names it."""
    order = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")) - 1
    ranked_ = headers.withColumn("kind", F.when(order >= 0, order).otherwise(len(kinds)))
    return ranked_.groupBy("symbol").agg(F.min(F.struct("kind", "file")).alias("m")).select("symbol", F.col("m.file").alias("file"), F.col("m.kind").alias("kind"))
