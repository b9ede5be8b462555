"""Queries of lookups, de-duplication, refinement and grouping over ``part`` as symbols (name, brand as scope, type as kind)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, grouping, lookup, refine
from .shared import query, table

SYMBOLS = "(SELECT p_partkey AS seq, regexp_extract(p_name, '[^ ]*$') AS sym, p_brand AS scope, p_name AS def, p_type AS sym_type, CAST(p_partkey % 97 AS BIGINT) AS file_id, p_size AS line FROM part)"


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.substring_index("p_name", " ", -1).alias("sym"), F.col("p_brand").alias("scope"), F.col("p_name").alias("def"), F.col("p_type").alias("sym_type"), (F.col("p_partkey") % 97).alias("file_id"), F.col("p_size").alias("line"))


@query(f"SELECT seq, sym, scope FROM {SYMBOLS} WHERE scope IN ('Brand#2', 'Brand#17') AND scope <> ''")
def symbols_in_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.in_scopes(symbols(spark, sf_dir), ["Brand#2", "Brand#17"]).select("seq", "sym", "scope")


@query(f"SELECT seq, sym FROM {SYMBOLS} WHERE scope IN ('Brand#2', 'Brand#3') AND sym_type = 'SMALL'")
def variables_in_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.in_scopes(symbols(spark, sf_dir), ["Brand#2", "Brand#3"], kind="SMALL").select("seq", "sym")


@query(f"SELECT seq, sym FROM {SYMBOLS} WHERE scope IN ('Brand#2', 'Brand#3') AND file_id = 5")
def symbols_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.in_scopes(symbols(spark, sf_dir), ["Brand#2", "Brand#3"], file_id=5).select("seq", "sym")


@query(f"SELECT seq, def FROM {SYMBOLS} WHERE sym = 'ring' AND scope = 'Brand#4' ORDER BY seq LIMIT 5")
def exact_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.exact(symbols(spark, sf_dir), "ring", "Brand#4", 5).select("seq", "def")


@query(f"SELECT seq, def FROM {SYMBOLS} WHERE sym = 'bolt'")
def exact_in_any_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.exact(symbols(spark, sf_dir), "bolt").select("seq", "def")


@query(f"""WITH s AS (SELECT *, CASE WHEN file_id < 20 THEN 0 WHEN file_id < 60 THEN 1 ELSE 2 END AS source_no FROM {SYMBOLS}), b AS (SELECT scope, sym, min(source_no) AS m FROM s GROUP BY ALL)
SELECT s.seq, s.scope, s.sym, CAST(s.source_no AS BIGINT) AS source_no FROM s JOIN b ON s.scope = b.scope AND s.sym = b.sym AND s.source_no = b.m""")
def first_source_with_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = symbols(spark, sf_dir)
    sources = [s.where("file_id < 20"), s.where("file_id >= 20 and file_id < 60"), s.where("file_id >= 60")]
    return lookup.first_source(sources, ["scope", "sym"]).select("seq", "scope", "sym", F.col("source_no").cast("long").alias("source_no"))


@query(f"SELECT seq FROM {SYMBOLS} WHERE sym_type = 'PROMO' UNION ALL SELECT seq FROM {SYMBOLS} WHERE sym_type = 'ECONOMY' AND line > 40")
def union_of_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = symbols(spark, sf_dir)
    return lookup.select_dbs({1: s.where("sym_type = 'PROMO'"), 2: s.where("sym_type = 'SMALL'"), 4: s.where("sym_type = 'ECONOMY' and line > 40")}, 5).select("seq")


@query(f"SELECT seq FROM {SYMBOLS} WHERE scope = 'Brand#5'")
def fallback_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = symbols(spark, sf_dir).select("seq", "scope")
    return lookup.fallback(s.where("scope = 'none'"), s.where("scope = 'Brand#5'")).select("seq")


@query(f"SELECT seq FROM {SYMBOLS} WHERE scope = 'Brand#4'")
def first_source_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second source isn't asked if the first has anything."""
    s = symbols(spark, sf_dir).select("seq", "scope")
    return lookup.fallback(s.where("scope = 'Brand#4'"), s.where("scope = 'Brand#5'")).select("seq")


@query(f"""WITH p(scope, rank) AS (VALUES ('Brand#2', 1), ('Brand#3', 2), ('Brand#4', -1), ('Brand#5', -1001), ('', -1000)),
h AS (SELECT s.*, p.rank FROM {SYMBOLS} s JOIN p USING (scope)), b AS (SELECT *, max(rank) OVER (PARTITION BY sym) AS best FROM h),
o AS (SELECT sym, rank, def, min(seq) AS seq FROM b WHERE rank = best GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY seq) AS k FROM o)
SELECT sym, rank, min(seq) AS seq, string_agg(def, chr(12) ORDER BY seq) FILTER (k <= 10) AS defs FROM n GROUP BY sym, rank""")
def ranked_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lookup.lookup_path(spark, ["Brand#2", "Brand#3"], ["Brand#4"], ["Brand#5", "Brand#2"])
    return lookup.ranked(symbols(spark, sf_dir), path)


@query(f"""WITH p(scope, rank) AS (VALUES ('Brand#2', 1), ('Brand#4', -1), ('Brand#5', -2), ('', -1000)), h AS (SELECT s.seq, s.sym, s.scope, p.rank FROM {SYMBOLS} s JOIN p USING (scope)),
b AS (SELECT *, max(CASE WHEN rank < 0 AND rank > -1000 THEN rank END) OVER (PARTITION BY sym) AS best FROM h) SELECT seq, sym, scope, rank FROM b WHERE NOT (rank < 0 AND rank > -1000) OR rank = best""")
def members_with_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lookup.lookup_path(spark, ["Brand#2"], ["Brand#4", "Brand#5"])
    return lookup.members(symbols(spark, sf_dir), path).select("seq", "sym", "scope", "rank")


@query(f"SELECT DISTINCT sym, scope FROM {SYMBOLS} WHERE starts_with(lower(sym), 'ri') AND scope IN ('Brand#2', 'Brand#3', '')")
def prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.with_prefix(symbols(spark, sf_dir), "RI", lookup.lookup_path(spark, ["Brand#2", "Brand#3"]))


@query(f"SELECT sym FROM (SELECT DISTINCT sym FROM {SYMBOLS} WHERE starts_with(sym, 'b')) ORDER BY sym LIMIT 1")
def prefix_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.with_prefix(symbols(spark, sf_dir), "b").select("sym").distinct().orderBy("sym").limit(1)


@query(f"SELECT seq, CASE WHEN length(def) > 6 THEN left(def, 3) || '...' ELSE def END AS def FROM {SYMBOLS} WHERE sym = 'gear' AND scope = 'Brand#3' ORDER BY seq LIMIT 50")
def definition_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.definitions(symbols(spark, sf_dir), "gear", "Brand#3", width=6).select("seq", "def")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def existence_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").join(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def dedup_prefer(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("seq", F.struct("l_orderkey", "l_linenumber"))
    return dedup.prefer_flagged(lines, ["l_partkey", "l_suppkey"], F.col("l_returnflag") == "R", "seq").select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem WHERE l_returnflag <> 'R') WHERE k = 1")
def dedup_drop_unwanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("seq", F.struct("l_orderkey", "l_linenumber"))
    return dedup.drop_unwanted_unless_alone(lines, ["l_partkey"], F.col("l_returnflag") == "R", "seq").select("l_orderkey", "l_linenumber")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+', '', 'g')")
def dedup_equivalent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.equivalent(table(spark, sf_dir, "documents"), F.col("text"), "doc_id").select("doc_id")


@query("SELECT event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def consecutive_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.without_repeats(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], ["user_id"]).select("event_id")


@query("SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.unique_by_name(table(spark, sf_dir, "part"), "p_name", "p_partkey")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events), m AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM l WHERE k = 1)
SELECT * FROM m WHERE place <= 3""")
def most_recently_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.most_recent(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id", 3).select("user_id", "event_type", "event_id", F.col("place").cast("long").alias("place"))


@query("SELECT p_name, p_type, min(p_partkey) AS p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_type ORDER BY (p_size > 25) DESC, (p_retailprice > 950) DESC, (p_size % 2 = 0) DESC, p_partkey % 97, p_size, p_partkey) AS k FROM part) WHERE k = 1 GROUP BY ALL")
def merged_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("sym_scope"), F.col("p_type").alias("sym_type"), (F.col("p_size") > 25).alias("in_solution"), (F.col("p_retailprice") > 950).alias("is_goto"), (F.col("p_size") % 2 == 0).alias("has_body"), (F.col("p_partkey") % 97).alias("file_id"), F.col("p_size").alias("line"), F.col("p_partkey").alias("seq"))
    return dedup.merge_definitions(rows).select(F.col("sym_scope").alias("p_name"), F.col("sym_type").alias("p_type"), F.col("seq").alias("p_partkey"))


@query("SELECT page_id FROM pages WHERE NOT (contains(lower(regexp_extract(url, '[^/]*$')), 'page'))")
def drop_unless_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower(F.substring_index("url", "/", -1))
    return refine.unless_empty(table(spark, sf_dir, "pages"), F.contains(name, F.lit("page"))).select("page_id")


@query("SELECT p_partkey FROM part")
def drop_would_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter that all rows fail is not applied."""
    return refine.unless_empty(table(spark, sf_dir, "part"), F.col("p_size") > 0).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def preferred_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine.preferred_only(table(spark, sf_dir, "orders"), F.col("o_orderpriority") == "1-URGENT").select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_type <> 'PROMO'")
def without_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine.without_external(table(spark, sf_dir, "part"), F.col("p_type").isin("PROMO", "SMALL"), F.col("p_type") == "PROMO").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#2', 'Brand#3')")
def active_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine.active_projects(table(spark, sf_dir, "part"), F.array("p_brand"), ["Brand#2", "Brand#3"]).select("p_partkey")


@query("WITH g AS (SELECT p_name, min(p_brand) <> max(p_brand) AS many, bool_or(p_size > 40) AS anyp FROM part GROUP BY p_name) SELECT p_partkey FROM part JOIN g USING (p_name) WHERE p_size > 40 OR NOT many OR NOT anyp")
def project_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine.project_paths(table(spark, sf_dir, "part"), "p_name", "p_brand", F.col("p_size") > 40).select("p_partkey")


RULES = [("t", "RED ring"), ("f", "brand#2"), ("d", "/economy"), ("d", "/small/brand#3"), ("p", "none")]


@query("""SELECT p_partkey FROM part WHERE lower(p_name) <> 'red ring' AND lower(p_brand) <> 'brand#2' AND NOT starts_with('/' || lower(p_type) || '/' || lower(p_brand) || '/', '/economy/') AND NOT starts_with('/' || lower(p_type) || '/' || lower(p_brand) || '/', '/small/brand#3/')""")
def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("dir", F.concat_ws("/", F.lit(""), "p_type", "p_brand"))
    rules = spark.createDataFrame(RULES, "kind string, value string")
    return refine.without_rules(rows, rules, tag="p_name", file="p_brand", directory="dir", project="p_type").select("p_partkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (22 >> l_linenumber) & 1 = 1")
def reference_type_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine.by_type_mask(table(spark, sf_dir, "lineitem"), F.col("l_linenumber"), 22).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1")
def counts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.results_by_kind(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ("F", "O", "P"))


@query("SELECT lower(p_name) AS tag_key, min(p_name) AS tag, count(*) AS n, count(*) FILTER (p_size < 10) AS n_hidden, count(*) - count(*) FILTER (p_size < 10) = 1 AS single FROM part GROUP BY 1")
def group_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.by_tag(table(spark, sf_dir, "part"), "p_name", F.col("p_size") < 10)


@query("SELECT l_suppkey, count(*) AS n, bool_and(l_quantity > 5) AS all_hidden FROM lineitem GROUP BY 1")
def group_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.by_file(table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_quantity") > 5)


@query("SELECT p_name, string_agg(p_type, '; ' ORDER BY p_type) AS projects FROM (SELECT DISTINCT p_name, p_type FROM part) GROUP BY 1")
def projects_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.joined_projects(table(spark, sf_dir, "part"), "p_name", "p_type")


@query("WITH c AS (SELECT count(*) FILTER (l_returnflag <> 'R') AS shown, count(*) FILTER (l_returnflag = 'R') AS hidden, count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_suppkey END) AS files FROM lineitem) SELECT *, shown || CASE WHEN shown = 1 THEN ' reference in ' ELSE ' references in ' END || files || CASE WHEN files = 1 THEN ' file' ELSE ' files' END AS text FROM c")
def reference_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.summary(table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_returnflag") == "R")


@query("SELECT p_brand, string_agg(p_name, '|' ORDER BY p_partkey) AS texts FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part) WHERE k <= 10 GROUP BY 1")
def first_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.concat_first(table(spark, sf_dir, "part"), "p_brand", "p_name", "p_partkey", 10, "|")
