"""Grouped listings and their summaries; every aggregate has a partial step before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def results_by_kind(df: DataFrame, kind: str, state: str, states: tuple[str, ...]) -> DataFrame:
    """Rows of each kind, and how many are in each state."""
    return df.groupBy(kind).agg(F.count("*").alias("total"), *(F.count_if(F.col(state) == s).alias(f"n_{s.lower()}") for s in states))


def by_tag(df: DataFrame, tag: str, hidden: Column) -> DataFrame:
    """Tags without regard to case, the smallest spelling standing for all: rows, hidden rows, whether it is single."""
    return df.groupBy(F.lower(tag).alias("tag_key")).agg(F.min(tag).alias("tag"), F.count("*").alias("n"), F.count_if(hidden).alias("n_hidden"), (F.count("*") - F.count_if(hidden) == 1).alias("single"))


def by_file(df: DataFrame, file: str, hidden: Column) -> DataFrame:
    """Files with their rows; whether all of them are hidden."""
    return df.groupBy(file).agg(F.count("*").alias("n"), F.bool_and(hidden).alias("all_hidden"))


def joined_projects(df: DataFrame, file: str, project: str) -> DataFrame:
    """Each file once, with its projects joined by "; ", shared ones first."""
    once = df.select(file, project).distinct()
    listed = F.array_sort(F.collect_list(F.struct((~F.col(project).endswith(".shared")).alias("own"), F.col(project).alias("name"))))
    return once.groupBy(file).agg(F.array_join(F.transform(listed, lambda x: x["name"]), "; ").alias("projects"))


def summary(df: DataFrame, file: str, hidden: Column) -> DataFrame:
    """One row: shown, hidden, files, and a sentence."""
    counts = df.agg(F.count_if(~hidden).alias("shown"), F.count_if(hidden).alias("hidden"), F.count_distinct(F.when(~hidden, F.col(file))).alias("files"))
    word = lambda n, one, many: F.when(F.col(n) == 1, one).otherwise(many)
    return counts.withColumn("text", F.concat_ws(" ", F.col("shown").cast("string"), word("shown", "reference", "references"), F.lit("in"), F.col("files").cast("string"), word("files", "file", "files")))


def usage(df: DataFrame, what: str, who: str, units: str) -> DataFrame:
    """Counters of use: times, different users, and the sum of units."""
    return df.groupBy(what).agg(F.count("*").alias("uses"), F.count_distinct(who).alias("users"), F.sum(units).alias("units"))


def concat_first(df: DataFrame, key: str, text: str, order: str, most: int, mark: str) -> DataFrame:
    """The first ``most`` texts of each key, joined."""
    first = df.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(order))).where(F.col("_k") <= most)
    listed = F.array_sort(F.collect_list(F.struct(order, text)))
    return first.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x[text]), mark).alias("texts"))
