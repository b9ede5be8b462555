"""Queries of orders and of operations that keep an order, over ``part`` as symbols and files, with SQL for DuckDB. An order is
shown by each row's place in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dedup, grouping, sorting
from .shared import query, table
from .text_queries import LOW

#: A path for each part: brand and kind as directories, two words and the size as the name.
PATH = "('/' || p_brand || '/' || p_type || '/' || replace(p_name, ' ', '_') || CAST(p_size % 4 AS VARCHAR) || '.CPP')"
BASE = "(replace(p_name, ' ', '_') || CAST(p_size % 4 AS VARCHAR) || '.CPP')"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    path = F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_type", F.lit("/"), F.translate("p_name", " ", "_"), (c("p_size") % 4).cast("string"), F.lit(".CPP"))
    return table(spark, sf_dir, "part").withColumn("path", path)


def ordered(df: DataFrame, order: list, tie: str = "p_partkey") -> DataFrame:
    return sorting.place(df, order, tie, []).select(tie, "place")


def by(*keys: str, source: str = "part", tie: str = "p_partkey") -> str:
    return f"SELECT {tie}, row_number() OVER (ORDER BY {', '.join(keys)}, {tie}) AS place FROM {source}"


@query(by(LOW.format("p_name"), "printf('%x', p_partkey % 97)", "length(printf('%x', p_size))", "printf('%x', p_size)"))
def name_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    hexed = lambda c: F.lower(F.hex(c.cast("long")))
    return ordered(table(spark, sf_dir, "part"), sorting.name_order(F.col("p_name"), hexed(F.col("p_partkey") % 97), hexed(F.col("p_size"))))


@query(by("p_brand", f"{LOW.format(PATH)}", "p_size"))
def scope_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered(files(spark, sf_dir), sorting.scope_order(F.col("p_brand"), F.col("path"), F.col("p_size")))


@query(by("CASE p_type WHEN 'PROMO' THEN 'FUNC' ELSE p_type END", LOW.format("p_name"), "p_name", LOW.format("p_brand"), LOW.format(PATH), "p_size"))
def type_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A go-to marker stands among the functions."""
    kind = F.when(F.col("p_type") == "PROMO", "GOTODEF").otherwise(F.col("p_type"))
    return ordered(files(spark, sf_dir), sorting.type_order(kind, F.col("p_name"), F.col("p_brand"), F.col("path"), F.col("p_size")))


FILE_ORDERS = {
    "name": (f"lower({BASE})", f"lower({PATH})", "lower(p_type)"),
    "project": ("lower(p_type)", f"lower({BASE})", f"lower({PATH})"),
    "path": (f"lower({PATH})", "lower(p_type)"),
    "time": ("-p_size", f"lower({PATH})"),
}


def file_order(column: str, reverse: bool):
    def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ordered(files(spark, sf_dir), sorting.file_list_order(column, F.col("path"), F.col("p_type"), F.col("p_size"), reverse=reverse))

    listed.__name__ = f"files_by_{column}{'_reversed' * reverse}"
    query(by(*(k + " DESC" * reverse for k in FILE_ORDERS[column])))(listed)


for _column in FILE_ORDERS:
    file_order(_column, False)
    file_order(_column, True)


@query(by(LOW.format("p_name"), LOW.format(PATH), "p_size"))
def hashtags_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered(files(spark, sf_dir), sorting.hashtag_order(F.col("p_name"), F.col("path"), F.col("p_size")))


@query(by(LOW.format(PATH), "p_size", LOW.format("p_name")))
def hashtags_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered(files(spark, sf_dir), sorting.hashtag_order(F.col("p_name"), F.col("path"), F.col("p_size"), by_file=True))


@query(by(LOW.format(BASE), "p_size"))
def definition_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered(files(spark, sf_dir), sorting.definition_order(F.col("path"), F.col("p_size")))


@query(by("k", source=f"(SELECT min(p_partkey) AS p_partkey, {LOW.format(f'CASE WHEN p_size % 5 = 0 THEN d ELSE {BASE} END')} AS k FROM (SELECT *, CASE WHEN p_size % 5 = 0 THEN p_name || ' (unresolved)' ELSE {PATH} END AS d FROM part) GROUP BY d, k)"))
def includes_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each include once, by its file's name; unresolved ones by their text."""
    resolved = F.when(F.col("p_size") % 5 != 0, F.col("path"))
    rows = files(spark, sf_dir).withColumn("def", F.coalesce(resolved, F.concat("p_name", F.lit(" (unresolved)")))).withColumn("path", resolved)
    return ordered(dedup.keep_best(rows, ["def"], "p_partkey"), sorting.includes_order(F.col("path"), F.col("def")))


@query(by("p_name", "':' || p_brand", source="(SELECT min(p_partkey) AS p_partkey, p_name, p_brand FROM part GROUP BY ALL)"))
def inheritance_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each definition once, by symbol, then scope."""
    rows = table(spark, sf_dir, "part").withColumn("def", F.concat_ws(":", F.lit(""), "p_brand", "p_name"))
    return ordered(dedup.keep_best(rows, ["def"], "p_partkey"), sorting.inheritance_order(F.col("def")))


@query(by(f"lower({PATH})", "p_size"))
def position_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered(files(spark, sf_dir), sorting.position_order(F.col("path"), F.col("p_size")))


@query("SELECT n_nationkey, row_number() OVER (ORDER BY NOT (n_regionkey = 2 OR n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)), n_nationkey) AS place FROM nation")
def project_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared projects and those that have an active file before the others."""
    active = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"), F.lit(True).alias("active")).distinct()
    nations = table(spark, sf_dir, "nation").join(active, "n_nationkey", "left")
    return ordered(nations, sorting.project_order(F.col("n_regionkey") == 2, F.coalesce("active", F.lit(False))), "n_nationkey")


@query(f"SELECT p_partkey, row_number() OVER (ORDER BY {LOW.format('p_name')}, p_name, p_partkey) AS place FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 200)")
def suggestion_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 suggestions as they came, then sorted."""
    return ordered(sorting.first_then_sorted(table(spark, sf_dir, "part"), "p_partkey", 200, sorting.completion_order(F.col("p_name"))), sorting.completion_order(F.col("p_name")))


@query("SELECT o_orderkey, count, (count - 1) // 50 AS batch FROM (SELECT o_orderkey, count(*) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS count FROM orders)")
def running_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with a running count, in batches of 50."""
    return sorting.batches(table(spark, sf_dir, "orders"), "o_orderkey", 50).select("o_orderkey", "count", "batch")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice <= 1000, p_partkey) AS place, CAST(CASE WHEN p_retailprice > 1000 THEN 0 ELSE 1 END AS BIGINT) AS part FROM part")
def kept_then_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered rows, then the ones that the filter dropped."""
    parts = table(spark, sf_dir, "part")
    both = sorting.kept_then_rest(parts.where("p_retailprice > 1000"), parts, ["p_partkey"])
    return sorting.place(both, [F.col("part")], "p_partkey", []).select("p_partkey", "place", "part")


@query("""WITH s AS (SELECT p_name, coalesce(list_sort(list_distinct(list(p_type) FILTER (p_size % 2 = 0))), []) AS a, coalesce(list_sort(list_distinct(list(p_type) FILTER (p_size % 2 = 1))), []) AS b FROM part GROUP BY p_name) SELECT p_name, a = b AS same FROM s""")
def same_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two lists have the same members."""
    lists = table(spark, sf_dir, "part").groupBy("p_name").agg(*(F.collect_set(F.when(F.col("p_size") % 2 == k, F.col("p_type"))).alias(n) for k, n in ((0, "a"), (1, "b"))))
    return lists.select("p_name", sorting.same_members(F.col("a"), F.col("b")).alias("same"))


@query("""WITH e AS (SELECT p_name AS s, min(p_partkey) AS seq FROM part WHERE p_brand = 'Brand#2' GROUP BY 1), m AS (SELECT * FROM e WHERE s NOT IN (SELECT p_name FROM part WHERE p_brand = 'Brand#3'))
SELECT s, seq, row_number() OVER (ORDER BY seq) AS place FROM m""")
def missing_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of an enumeration, each at its first place, without those that are there; in their order."""
    parts = table(spark, sf_dir, "part")
    members = dedup.unique_by_name(parts.where("p_brand = 'Brand#2'").select(F.col("p_name").alias("s"), F.col("p_partkey").alias("seq")), "s", "seq")
    missing = sorting.missing_in_order(members, parts.where("p_brand = 'Brand#3'").select(F.col("p_name").alias("s")), ["s"])
    return sorting.place(missing, [], "seq", [])


@query("SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name, p_type")
def unique_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.keep_best(table(spark, sf_dir, "part"), ["p_name", "p_type"], "p_partkey").select("p_name", "p_partkey")


@query(f"SELECT min(p_partkey) AS p_partkey FROM part GROUP BY {LOW.format(PATH)}")
def added_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list to which a file is added only if it is not there but for case."""
    return dedup.added_once(files(spark, sf_dir), F.col("path"), "p_partkey").select("p_partkey")


@query("SELECT DISTINCT p_name FROM part WHERE p_type = 'SMALL'")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_type = 'SMALL'").select("p_name").distinct()


@query("SELECT event_type, count(*) AS uses, count(DISTINCT user_id) AS users, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS units FROM events GROUP BY 1")
def usage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return grouping.usage(events, "event_type", "user_id", "k")


def line_order(name: str, ascending: bool, case_sensitive: bool, sql: str):
    def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
        turns = table(spark, sf_dir, "conversations").where("text is not null")
        return turns.select("conv_id", "turn", sorting.sorted_lines(F.col("text"), ascending=ascending, case_sensitive=case_sensitive).alias("text"))

    lines.__name__ = name
    query(f"SELECT conv_id, turn, array_to_string({sql}, chr(10)) AS text FROM conversations WHERE text IS NOT NULL")(lines)


LINES = "list_filter(string_split(text, chr(10)), lambda x: x <> '')"


def without_case(tail: str = "") -> str:
    keyed = f"list_transform({LINES}, lambda x: struct_pack(k := {LOW.format('x')}, v := x))"
    return f"list_transform(list_sort({keyed}{tail}), lambda s: s.v)"


line_order("lines_ascending", True, True, f"list_sort({LINES})")
line_order("lines_descending", False, True, f"list_sort({LINES}, 'DESC')")
line_order("lines_ascending_without_case", True, False, without_case())
line_order("lines_descending_without_case", False, False, without_case(", 'DESC'"))


LETTERS = f"list_transform(list_sort(list_transform({LINES}, lambda x: struct_pack(k := icu_sort_key(x, 'root'), v := x))), lambda s: s.v)"


@query(f"SELECT conv_id, turn, array_to_string({LETTERS}, chr(10)) AS text FROM conversations WHERE text IS NOT NULL")
def lines_by_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the order of the letters of all languages."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    return turns.select("conv_id", "turn", sorting.sorted_lines(F.col("text"), collation="UNICODE").alias("text"))


@query("""WITH k AS (SELECT doc_id, icu_sort_key(coalesce(text, ''), 'root') AS k FROM documents) SELECT doc_id, CAST(CASE WHEN k < icu_sort_key('étude', 'root') THEN -1 WHEN k > icu_sort_key('étude', 'root') THEN 1 ELSE 0 END AS BIGINT) AS order_ FROM k""")
def compared_by_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether texts stand before or after a word with an accent."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.compare(F.coalesce("text", F.lit("")), F.lit("étude"), collation="UNICODE").cast("long").alias("order_"))
