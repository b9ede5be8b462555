"""Joins that are more than an equality of columns, composed so that each is an equi-join with a window or an aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import quote, without_one


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str, tie: str, bucket_seconds: int = 86_400) -> DataFrame:
    """Each left row with the value of the last right row of its key before it (the last by ``tie`` among equals). No pair of rows
    is formed: both sides are sorted by key and time within buckets of time, so that no key is one task's, and what
    a bucket ends with is carried on to the ones after it."""
    bucket = lambda t: F.expr(f"cast(unix_micros(cast({t} as timestamp)) div {bucket_seconds * 1_000_000} as long)").alias("_bucket")
    found = F.struct(F.col(value))
    none = F.lit(None).cast(f"struct<{value}: {right.schema[value].dataType.simpleString()}>")
    a = left.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.col(left_time).alias("_t"), bucket(left_time), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), none.alias("_w"))
    b = right.select(F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"), F.col(key).alias("_key"), F.col(right_time).alias("_t"), bucket(right_time), F.lit(2).alias("_side"), F.col(tie).alias("_tie"), found.alias("_w"))
    before = W.partitionBy("_key", "_bucket").orderBy("_t", "_side", "_tie").rowsBetween(W.unboundedPreceding, -1)
    own = a.unionByName(b).withColumn("_own", F.last("_w", ignorenulls=True).over(before)).where(F.col("_side") == 1)
    # a row for each bucket of a key that has a right or left row
    last = b.groupBy("_key", "_bucket").agg(F.max_by("_w", F.struct("_t", "_tie")).alias("_last"))
    earlier = W.partitionBy("_key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = a.select("_key", "_bucket").distinct().join(last, ["_key", "_bucket"], "full_outer").withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier)).select("_key", "_bucket", "_carried")
    return own.join(carried, ["_key", "_bucket"], "left").select("_row.*", F.coalesce(f"_own.{value}", F.when(F.col("_own").isNull(), F.col(f"_carried.{value}"))).alias(f"asof_{value}"))


def closest_before(df: DataFrame, line: Column, order: str, limit: int) -> DataFrame:
    """The rows but for the one nearest above a line."""
    nearest = df.where(line < limit).agg(F.max_by(F.col(order), F.struct(line.alias("l"), F.col(order).alias("o"))).alias("_gone"))
    return df.join(F.broadcast(nearest), F.coalesce(F.col(order) != F.col("_gone"), F.lit(True))).drop("_gone")


def nearest_by_edits(left: DataFrame, right: DataFrame, key: str, left_text: str, right_text: str, left_id: str, right_id: str) -> DataFrame:
    """For each left row, the right row of its key with the least edit distance: exact, without case, or without spaces,
    whichever is least; ties to the smaller id. That is the distance of the texts without case and spaces, as no edit is saved by
    keeping either. Texts that are equal so meet first. Others meet by what is left of them without one character, which finds all that
    are one edit away; only texts that find none are compared with those of their key, each different pair once."""
    plain = lambda c: F.regexp_replace(F.lower(F.col(c)), r"\s+", "")
    texts = right.groupBy(key, plain(right_text).alias("_b")).agg(F.min(right_id).alias(right_id))
    wanted = left.select(key, plain(left_text).alias("_a")).distinct()
    equal = wanted.join(texts.withColumnRenamed("_b", "_a"), [key, "_a"]).select(key, "_a", right_id, F.lit(0).alias("distance"))
    rest = wanted.join(equal, [key, "_a"], "left_anti")
    cut = lambda df, c: df.withColumn("_cut", F.explode(without_one(F.col(c))))
    distance = F.levenshtein("_a", "_b")
    best = lambda df: df.groupBy(key, "_a").agg(F.min(F.struct(distance.alias("distance"), right_id)).alias("m")).select(key, "_a", F.col(f"m.{right_id}").alias(right_id), F.col("m.distance").alias("distance"))
    near = best(cut(rest, "_a").join(cut(texts, "_b"), [key, "_cut"]).where(distance == 1))
    far = best(rest.join(near, [key, "_a"], "left_anti").join(texts, key))
    found = equal.unionByName(near).unionByName(far)
    return left.withColumn("_a", plain(left_text)).join(found, [key, "_a"]).select(left_id, right_id, "distance")


def resolve_names(wanted: DataFrame, files: DataFrame, search_path: DataFrame, name: str = "name") -> DataFrame:
    """Each wanted name in the first directory of an ordered search path (directory, priority) that has it."""
    found = wanted.select(name).distinct().join(files, name).join(search_path, "directory")
    return found.groupBy(name).agg(F.min_by("directory", F.struct("priority", "directory")).alias("directory"), F.min("priority").alias("priority"))


def resolve_includes(includes: DataFrame, files: DataFrame, search_path: DataFrame) -> DataFrame:
    """Includes (directory, text, and more) with ``found``, the directory that has the file: their own, else the first of the
    search path (path, priority); null if none. Each different (directory, text) is looked up once."""
    once = includes.select("directory", "text").distinct()
    there = files.select(F.col("directory").alias("found"), F.col("name").alias("text")).distinct()
    own = once.join(there, "text").where(F.col("found") == F.col("directory")).withColumn("priority", F.lit(-1))
    along = once.join(there, "text").join(search_path.select(F.col("path").alias("found"), "priority"), "found")
    first = own.select("directory", "text", "found", "priority").unionByName(along.select("directory", "text", "found", "priority")).groupBy("directory", "text").agg(F.min_by("found", F.struct("priority", "found")).alias("found"))
    return includes.join(first, ["directory", "text"], "left")


def list_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows added and removed between two lists, with how often."""
    columns = old.columns
    counted = old.select(*columns, F.lit(-1).alias("_n")).unionByName(new.select(*columns, F.lit(1).alias("_n"))).groupBy(*columns).agg(F.sum("_n").alias("_n"))
    return counted.where(F.col("_n") != 0).select(*columns, F.when(F.col("_n") > 0, "added").otherwise("removed").alias("change"), F.abs("_n").alias("times"))


def snapshot_status(disk: DataFrame, indexed: DataFrame, key: str = "file_id") -> DataFrame:
    """How each file on disk or in the index stands: deleted, new, changed (time, then size or content), touched, same."""
    a = disk.select(key, F.col("mtime").alias("_dt"), F.col("size").alias("_ds"), F.col("hash").alias("_dh"))
    b = indexed.select(key, F.col("mtime").alias("_it"), F.col("size").alias("_is"), F.col("hash").alias("_ih"))
    c = F.col
    status = F.when(c("_dt").isNull(), "deleted").when(c("_it").isNull(), "new").when(c("_dt") == c("_it"), "same").when((c("_ds") != c("_is")) | (c("_dh") != c("_ih")), "changed").otherwise("touched")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def routed_changes(listed: DataFrame, disk: DataFrame, indexed: DataFrame, loaded: DataFrame) -> DataFrame:
    """(file_id, action, route): what is to be done with files when an index is opened. listed: the project's files (file_id, kind:
    header or source; others are left alone; system: in a system directory). disk: files that are there, indexed: files with their
    state (file_id, mtime, size, hash; indexed also ``db``: project, system or solution). loaded: files (file_id) whose symbols are
    in memory.

    A file that is indexed, neither on disk nor listed, is to be removed. Of listed files on disk, one that is indexed as it is but not
    loaded is to be loaded; one that isn't indexed (or without a time) or was changed is to be updated, but not if it is loaded
    and only its time has changed (size and hash agree). The route is that of the solution's or the system's index, or by kind. Each
    file_id is once in each table; null ids take no part."""
    c = F.col
    i = indexed.where("file_id is not null").select("file_id", c("mtime").alias("_it"), c("size").alias("_is"), c("hash").alias("_ih"), "db")
    d = disk.where("file_id is not null").select("file_id", c("mtime").alias("_dt"), c("size").alias("_ds"), c("hash").alias("_dh"), F.lit(True).alias("_there"))
    there, known = c("_there").isNotNull(), c("_it").isNotNull()
    wanted = listed.where("file_id is not null").select("file_id", "kind", "system", F.lit(True).alias("_listed")).join(d, "file_id", "full_outer").join(i, "file_id", "full_outer").join(loaded.select("file_id", F.lit(True).alias("_loaded")), "file_id", "left")
    in_memory, same = c("_loaded").isNotNull(), known & (c("_it") == c("_dt"))
    content = (c("_is") == c("_ds")) & (c("_ih") == c("_dh"))
    parsed = c("_listed") & there & c("kind").isin("header", "source")
    action = F.when(c("_listed").isNull() & ~there & c("db").isNotNull(), "remove").when(~F.coalesce(parsed, F.lit(False)), None).when(~in_memory & F.coalesce(same, F.lit(False)), "load").when(in_memory & F.coalesce(same, F.lit(False)), None).when(in_memory & known & F.coalesce(content, F.lit(False)), None).otherwise("update")
    route = F.when(action == "remove", "removed").when(c("db") == "solution", "solution").when((c("db") == "system") | (c("db").isNull() & F.coalesce("system", F.lit(False))), "system").when(c("kind") == "header", "global").otherwise("source")
    return wanted.select("file_id", action.alias("action"), route.alias("route")).where("action is not null")


#: Ends of base names that related files differ in, in the order in which they are taken off (fixed values).
SUFFIXES = ("iterator", "base", "impl", "priv", "fwd", "_exp", "ex", "-internal", "-inl", "_part", "model", "_p", "_")


def related_key(name: Column) -> Column:
    """A base name without its extension, digits at the end (unless it has nothing else) and usual ends, in lower case. An end that
    the name has elsewhere, too, stays."""
    base = F.regexp_replace(F.lower(F.regexp_replace(name, r"\.[^.]*$", "")), "(?<=[^0-9])[0-9]+$", "")
    for end in SUFFIXES:
        base = F.regexp_replace(base, rf"(?s)^((?:(?!{quote(end)}).)*){quote(end)}$", "$1")
    return base


def related_files(files: DataFrame, name: str, key: str) -> DataFrame:
    """(key, other): files whose reduced names are equal, or but for an i before one of them. A key of several names has the pairs of
    all of them, each once: it is taken at the least of the names that meet. So pairs are not compared with each other, and what
    a task holds follows the files, not their pairs."""
    base = F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))
    own = files.where(F.col(key).isNotNull()).select(F.col(key), related_key(F.col(name)).alias("_k")).where(F.col("_k") != "")
    same = F.array_distinct(F.array("_k", F.concat(F.lit("i"), "_k"), F.when(F.col("_k").startswith("i") & (F.length("_k") > 1), F.substring("_k", 2, 1 << 30)).otherwise(F.col("_k"))))
    own = own.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_set(same))).alias("_ks")).select(key, "_ks", F.explode("_ks").alias("_k"))
    others = files.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("other")).agg(F.collect_set(base).alias("_names"))
    others = others.select("other", F.when(F.size("_names") > 1, F.col("_names")).alias("_several"), F.explode("_names").alias("_k"))
    once = F.col("_several").isNull() | (F.array_min(F.array_intersect("_ks", "_several")) == F.col("_k"))
    return own.join(others, "_k").where((F.col(key) != F.col("other")) & once).select(key, "other")


def project_files(known: DataFrame, listed: DataFrame, generations: DataFrame) -> DataFrame:
    """Files (project, path) of all projects: those of the last listing where a project's generation (project, before, now) is
    the same, of the new one elsewhere."""
    changed = generations.where(~F.col("before").eqNullSafe(F.col("now"))).select("project")
    return known.join(changed, "project", "left_anti").select("project", "path").unionByName(listed.join(changed, "project", "left_semi").select("project", "path")).distinct()


def still_pending(pending: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """What is pending and not known yet, each key once."""
    return pending.select(key).distinct().join(known.select(key), key, "left_anti")


def purge_missing(df: DataFrame, live: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose source is there (or that have none), and the sources that are gone, for a job that removes them elsewhere."""
    there = live.select(key).distinct()
    gone = df.select(key).where(F.col(key).isNotNull()).distinct().join(there, key, "left_anti")
    return df.join(gone, key, "left_anti"), gone


def mark_removed(df: DataFrame, sources: DataFrame, key: str, flags: str, bit: int) -> DataFrame:
    """First pass of a removal: rows of the sources have a bit in their flags. ``sweep`` takes them away."""
    gone = sources.select(key).distinct().withColumn("_gone", F.lit(bit))
    return df.join(gone, key, "left").withColumn(flags, F.col(flags).bitwiseOR(F.coalesce("_gone", F.lit(0)))).drop("_gone")


def sweep(df: DataFrame, flags: str, bit: int) -> DataFrame:
    return df.where(F.col(flags).bitwiseAND(F.lit(bit)) == 0)


def purge(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not in the list of removed ones."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def update_where(df: DataFrame, changes: DataFrame, key: list[str], column: str) -> DataFrame:
    """Rows with a changed value where all key columns agree; of several changes of a key the greatest value."""
    new = changes.groupBy(*key).agg(F.max(column).alias("_new"))
    return df.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")
