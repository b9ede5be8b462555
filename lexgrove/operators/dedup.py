"""De-duplication by priority. Every operator names the row that stays by columns, so the result doesn't depend on the order
of a scan. ``row_number`` over a key keeps one row of each key before the shuffle (window group limit)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ascii_lower

def keep_best(df: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in an order."""
    row = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("_row", row).where(F.col("_row") == 1).drop("_row")


def prefer_flagged(df: DataFrame, key: list[str], unwanted: Column, seq: str) -> DataFrame:
    """One row of each key: one that is not unwanted if there is any, else the first."""
    return keep_best(df, key, unwanted.cast("int"), seq)


def drop_unwanted_unless_alone(df: DataFrame, key: list[str], unwanted: Column, seq: str) -> DataFrame:
    """As prefer_flagged, and if any row of the whole set is wanted, all unwanted ones go."""
    any_wanted = df.agg(F.coalesce(F.bool_or(~unwanted), F.lit(False)).alias("_wanted"))
    kept = df.join(F.broadcast(any_wanted), ~unwanted | ~F.col("_wanted")).drop("_wanted")
    return prefer_flagged(kept, key, unwanted, seq)


def equivalent(df: DataFrame, definition: Column, seq: str) -> DataFrame:
    """The first row of each definition, where definitions that differ in (ASCII) white space and case are one."""
    return keep_best(df.withColumn("_def", ascii_lower(F.regexp_replace(definition, r"[ \t-\r]+", ""))), ["_def"], seq).drop("_def")


def without_repeats(df: DataFrame, text: str, order: list[str], partition: list[str]) -> DataFrame:
    """Rows whose text differs from the row before in the partition."""
    before = F.lag(text).over(W.partitionBy(*partition).orderBy(*order))
    return df.withColumn("_before", before).where(~F.col(text).eqNullSafe(F.col("_before")) | F.col("_before").isNull()).drop("_before")


def unique_by_name(df: DataFrame, name: str, offset: str) -> DataFrame:
    """Each name once, at its smallest offset, in order of offset."""
    return df.groupBy(name).agg(F.min(offset).alias(offset)).orderBy(offset)


def added_once(df: DataFrame, name: Column, seq: str) -> DataFrame:
    """A list to which a row is added unless one of that name, but for case, is there."""
    return keep_best(df.withColumn("_name", ascii_lower(name)), ["_name"], seq).drop("_name")


def first_seen(items: Column, most: int = 60) -> Column:
    """Distinct items in order of first appearance, the first ``most``."""
    return F.slice(F.array_distinct(items), 1, most)


def most_recent(df: DataFrame, who: str, what: str, when: str, tie: str, most: int = 60) -> DataFrame:
    """Each user's most recently used items: the last use of each counts, and the last ``most`` stay, with ``place``."""
    last = keep_best(df, [who, what], F.desc(when), F.desc(tie))
    place = F.row_number().over(W.partitionBy(who).orderBy(F.desc(when), F.desc(tie)))
    return last.withColumn("place", place).where(F.col("place") <= most)


def merge_definitions(df: DataFrame) -> DataFrame:
    """Symbols sorted by name, of which neighbours repeat: for each (sym_scope, sym_type), a row of the solution goes
    before others, a go-to marker before its definition, and a definition with a body before one without."""
    return keep_best(df, ["sym_scope", "sym_type"], F.desc("in_solution"), F.desc("is_goto"), F.desc("has_body"), "file_id", "line", "seq")
