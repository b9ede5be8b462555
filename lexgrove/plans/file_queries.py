"""Queries of sources and sinks, files, include resolution and whole listings, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import adjacent, dedup, graph, grouping, joins, lookup, match, refine, sorting
from ..sources import symbols as sources
from ..streaming import maintenance
from .definition_queries import neighbours_sql
from .order_queries import PATH, files, ordered
from .shared import query, shared_folder, table
from .symbol_queries import SYMBOLS, symbols
from .text_queries import LOW, plain_rank


@query("SELECT p_brand AS sym_scope, p_name AS def, CAST(p_size AS BIGINT) AS line FROM part WHERE p_size % 10 <> 0")
def written_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol records by database; those without a name are not written."""
    c = F.col
    name = F.when(c("p_size") % 10 != 0, F.concat(F.lit(":"), "p_brand")).otherwise(":a:")
    rows = table(spark, sf_dir, "part").select(name.alias("sym_scope"), c("p_name").alias("def"), F.lit(5).alias("sym_type"), F.lit(0).alias("attrs"), c("p_partkey").alias("file_id"), c("p_size").alias("line"), (c("p_size") % 3).alias("db_id"))
    path = shared_folder(spark, "records")
    sources.write_symbols(rows, path)
    return sources.read_symbols(spark, path).select(F.col("sym").alias("sym_scope"), "def", F.col("line").cast("long").alias("line"))


@query("SELECT p_partkey, p_name FROM part WHERE p_size % 4 NOT IN (1, 2) AND p_type <> 'PROMO'")
def loaded_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index written by database and language, without some of either."""
    path = shared_folder(spark, "index")
    sources.write_index(table(spark, sf_dir, "part").select("p_partkey", "p_name", (F.col("p_size") % 4).alias("db_id"), F.col("p_type").alias("language")), path)
    return sources.load_index(spark, path, without_dbs=(1, 2), without_languages=("PROMO",)).select("p_partkey", "p_name")


@query("SELECT p_brand AS folder, 1 AS files FROM part GROUP BY 1")
def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files below a folder; the hidden ones and those with other names are not listed."""
    path = shared_folder(spark, "listed")
    table(spark, sf_dir, "part").select("p_name", F.translate("p_brand", "#", "_").alias("brand")).repartition("brand").write.partitionBy("brand").text(path)
    found = sources.list_files(spark, path, "*.txt").select(F.translate(F.regexp_extract("path", "brand=([^/]*)", 1), "_", "#").alias("folder"))
    return found.groupBy("folder").agg(F.count("*").cast("int").alias("files"))


@query("SELECT DISTINCT p_type AS project, " + PATH + " AS path FROM part WHERE CASE WHEN p_type IN ('PROMO', 'SMALL') THEN p_size > 10 ELSE p_size > 20 END")
def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two projects have changed since the last listing."""
    rows = files(spark, sf_dir).select(F.col("p_type").alias("project"), "path", "p_size")
    generations = rows.select("project").distinct().withColumns({"before": F.lit(1), "now": F.when(F.col("project").isin("PROMO", "SMALL"), 2).otherwise(1)})
    return joins.project_files(rows.where("p_size > 20"), rows.where("p_size > 10"), generations)


@query("SELECT p_name AS text FROM (SELECT DISTINCT p_name FROM part)")
def line_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of lines in UTF-16."""
    path = shared_folder(spark, "lines")
    table(spark, sf_dir, "part").select("p_name").distinct().write.option("encoding", "UTF-16LE").csv(path)
    return sources.read_line_lists(spark, path).select("text")


@query("SELECT DISTINCT p_name AS title, p_brand AS shortcut, p_type || ' $YEAR$' AS code FROM part")
def snippet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of XML files in a list of folders."""
    once = table(spark, sf_dir, "part").select(F.col("p_name").alias("Title"), F.col("p_brand").alias("Shortcut"), F.concat("p_type", F.lit(" $YEAR$")).alias("Code")).distinct()
    folders = [shared_folder(spark, "snippets") for _ in range(2)]
    for i, folder in enumerate(folders):
        once.where(F.pmod(F.hash("Title"), F.lit(2)) == i).write.format("xml").option("rowTag", "CodeSnippet").option("rootTag", "CodeSnippets").save(folder)
    return sources.read_snippets(spark, ";".join(folders) + ";").select(*(F.col(c).alias(c.lower()) for c in ("Title", "Shortcut", "Code")))


@query("""WITH r AS (SELECT DISTINCT p_name || chr(2) || p_type AS value FROM (SELECT p_name, p_type FROM part UNION ALL SELECT upper(p_name), p_type FROM part))
SELECT value, row_number() OVER (ORDER BY lower(split_part(value, chr(2), 1)), lower(value), value) AS place FROM r""")
def sorted_unique_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    record = lambda c: F.concat_ws("\x02", c, "p_type").alias("value")
    unique = sources.sorted_unique(parts.select(record(F.col("p_name"))).unionAll(parts.select(record(F.upper("p_name")))))
    value = F.col("value")
    return sorting.place(unique, [text.ascii_lower(F.substring_index(value, "\x02", 1)), text.ascii_lower(value)], "value", [])


@query("SELECT url AS name, page_id AS file_id, row_number() OVER (ORDER BY url, page_id) AS place FROM pages")
def file_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "dictionary")
    sources.write_file_dictionary(table(spark, sf_dir, "pages").select(F.col("url").alias("name"), F.col("page_id").alias("file_id")), path)
    return sorting.place(sources.read_file_dictionary(spark, path), [F.col("name")], "file_id", [])


GRAPH_PARTS = "(SELECT p_partkey, ':' || p_type || ':' || replace(p_brand, '#', '') || ':' || replace(p_name, ' ', '_') AS sym_scope, 'C:/' || p_type || '/' || p_brand || '/f' || CAST(p_partkey % 7 AS VARCHAR) || '.cpp' AS path, 'C:/' || p_type || '/' || p_brand AS dir, p_size % 4 AS kind, 1 << (p_size % 5) AS attrs, p_size % 9 AS line, p_size AS n FROM part WHERE p_size % 6 <> 0)"
NUMBER = "CASE WHEN {0} = '' THEN 0 ELSE CAST('0x' || md5({0})[1:8] AS BIGINT) END"


def common_sql(a: str, b: str, mark: str) -> str:
    """SQL of the path that two paths have in common."""
    x, y = f"string_split({a}, '{mark}')", f"string_split({b}, '{mark}')"
    same = f"list_position(list_concat(list_transform(range(1, least(len({x}), len({y}))), lambda i: {x}[i] = {y}[i]), [false]), false) - 1"
    return f"array_to_string({x}[1:{same}], '{mark}')"


GRAPH = f"""WITH g AS (SELECT * FROM {GRAPH_PARTS}), u AS (SELECT sym_scope, CAST(sum(n) AS BIGINT) AS n FROM (SELECT sym_scope, n FROM g UNION ALL SELECT array_to_string(string_split(sym_scope, ':')[1:3], ':'), n FROM g UNION ALL SELECT array_to_string(string_split(sym_scope, ':')[1:2], ':'), n FROM g) GROUP BY sym_scope),
v AS (SELECT sym_scope, bit_or(attrs) AS attrs, coalesce(arg_min(kind, p_partkey) FILTER (kind <> 0), 0) AS kind, coalesce(arg_min(line, p_partkey) FILTER (line <> 0), 0) AS line, arg_min(dir, p_partkey) AS dir FROM g GROUP BY sym_scope),
r AS (SELECT a.sym_scope AS src, b.sym_scope AS dst, a.dir AS own, l_linenumber % 3 AS kind, min(CAST(l_quantity AS INT)) AS line FROM lineitem JOIN g a ON a.p_partkey = l_partkey JOIN g b ON b.p_partkey = l_suppkey WHERE a.sym_scope <> b.sym_scope GROUP BY ALL)"""


def code_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as symbols of a scope and a file, and references between them; symbols that are no nodes go, and their links with them."""
    c = F.col
    scope = F.concat(F.lit(":"), c("p_type"), F.lit(":"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(":"), F.translate("p_name", " ", "_"))
    path = F.concat(F.lit("C:/"), c("p_type"), F.lit("/"), c("p_brand"), F.lit("/f"), (c("p_partkey") % 7).cast("string"), F.lit(".cpp"))
    symbols_ = table(spark, sf_dir, "part").select(
        c("p_partkey").alias("seq"), scope.alias("sym_scope"), path.alias("path"), (c("p_size") % 4).alias("kind"), F.expr("shiftleft(1L, p_size % 5)").alias("attrs"), (c("p_size") % 9).alias("line"), c("p_size").alias("n_lines"),
        F.lit(1).alias("file_id"), text.scope_of(scope).alias("scope"), text.symbol_of(scope).alias("sym"), F.lit("d").alias("def"), F.lit("FUNC").alias("sym_type"), (c("p_size") % 6 == 0).alias("is_system"), F.lit(False).alias("is_local"),
    ).where(lookup.is_graph_node())
    refs = table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("src"), c("l_suppkey").alias("dst"), (c("l_linenumber") % 3).alias("kind"), c("l_quantity").cast("int").alias("line"))
    return graph.code_graph(symbols_, refs)


def graph_file(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = shared_folder(spark, "graph")
    sources.write_graph(*code_graph(spark, sf_dir), path)
    return sources.read_graph(spark, path, name)


@query(GRAPH + f" SELECT {NUMBER.format('sym_scope')} AS node, {NUMBER.format("array_to_string(string_split(sym_scope, ':')[1:3], ':')")} AS scope, string_split(sym_scope, ':')[4] AS sym, CAST(kind AS BIGINT) AS kind, CAST(attrs AS BIGINT) AS attrs, n AS lines, CAST(line AS BIGINT) AS line, {NUMBER.format('dir')} AS dir FROM v JOIN u USING (sym_scope)")
def graph_node_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_file(spark, sf_dir, "Nodes")


@query(GRAPH + f" SELECT {NUMBER.format('src')} AS src, {NUMBER.format(common_sql('src', 'dst', ':'))} AS scope, {NUMBER.format('dst')} AS dst, {NUMBER.format(common_sql("a.dir || '/'", "b.dir || '/'", '/'))} AS dir, CAST(r.kind AS BIGINT) AS kind, CAST(r.line AS BIGINT) AS line, {NUMBER.format('own')} AS own_dir FROM r JOIN v a ON a.sym_scope = src JOIN v b ON b.sym_scope = dst")
def graph_link_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_file(spark, sf_dir, "Links")


NODE_SYMBOLS = "(SELECT *, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS scope, CASE WHEN p_size % 7 = 0 THEN upper(replace(p_name, ' ', '_')) ELSE replace(p_name, ' ', '_') END AS sym, CASE p_type WHEN 'PROMO' THEN 'CLASS' WHEN 'SMALL' THEN 'VAR' WHEN 'ECONOMY' THEN 'TEMPLATETYPE' WHEN 'LARGE' THEN 'NAMESPACE' ELSE 'FUNC' END AS kind, CASE WHEN p_size = 11 THEN ' ' WHEN p_size = 13 THEN p_name ELSE 'd' END AS def FROM part)"


@query(f"""SELECT p_partkey FROM {NODE_SYMBOLS} WHERE p_size <> 5 AND p_size % 11 <> 4 AND def <> p_name AND def <> ' ' AND p_size <> 17 AND kind <> 'TEMPLATETYPE' AND (scope <> '' OR kind IN ('CLASS', 'FUNC')) AND (scope <> '' OR p_size % 7 <> 0 OR kind IN ('CLASS', 'NAMESPACE'))""")
def graph_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that are nodes of a code graph."""
    c = F.col
    kinds = F.create_map(*(F.lit(x) for x in ("PROMO", "CLASS", "SMALL", "VAR", "ECONOMY", "TEMPLATETYPE", "LARGE", "NAMESPACE")))
    name = F.translate("p_name", " ", "_")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(c("p_size") % 3 == 0, "").otherwise(c("p_brand")).alias("scope"), F.when(c("p_size") % 7 == 0, F.upper(name)).otherwise(name).alias("sym"), F.coalesce(kinds[c("p_type")], F.lit("FUNC")).alias("sym_type"),
        F.when(c("p_size") == 11, " ").when(c("p_size") == 13, c("p_name")).otherwise("d").alias("def"), c("p_name").alias("sym_scope"), (c("p_size") - 5).alias("file_id"), (c("p_size") % 11 == 4).alias("is_system"), (c("p_size") == 17).alias("is_local"),
    )
    return rows.where(lookup.is_graph_node()).select("p_partkey")


MISSING = "(SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)"


@query(f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN {MISSING}")
def rows_of_live_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return joins.purge_missing(table(spark, sf_dir, "lineitem"), live, "l_suppkey")[0].select("l_orderkey", "l_linenumber")


@query(f"SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey NOT IN {MISSING}")
def missing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources that are gone, for the job that removes them elsewhere."""
    live = table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return joins.purge_missing(table(spark, sf_dir, "lineitem"), live, "l_suppkey")[1]


@query("SELECT l_orderkey, l_linenumber, l_linenumber | CASE WHEN l_suppkey % 5 = 0 THEN 64 ELSE 0 END AS flags FROM lineitem")
def marked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("flags"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey % 5 <> 0")
def swept_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after both passes of a removal."""
    return joins.sweep(_marked(spark, sf_dir), "flags", 64).select("l_orderkey", "l_linenumber")


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("flags", F.col("l_linenumber"))
    gone = table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return joins.mark_removed(rows, gone, "l_suppkey", "flags", 64)


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def pending_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.still_pending(table(spark, sf_dir, "orders"), known, "o_custkey")


@query("""WITH f AS (SELECT DISTINCT p_brand AS directory, p_name AS name FROM part WHERE p_size > 25), p(path, priority) AS (VALUES ('Brand#2', 1), ('Brand#3', 2), ('Brand#17', 3)), w AS (SELECT p_partkey, p_brand AS directory, p_name AS text FROM part)
SELECT p_partkey, CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.directory = w.directory AND f.name = w.text) THEN w.directory ELSE (SELECT arg_min(f.directory, priority) FROM f JOIN p ON f.directory = p.path WHERE f.name = w.text) END AS found FROM w""")
def resolved_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Includes by their own directory, else along a search path."""
    parts = table(spark, sf_dir, "part")
    there = parts.where("p_size > 25").select(F.col("p_brand").alias("directory"), F.col("p_name").alias("name")).distinct()
    path = spark.createDataFrame([("Brand#2", 1), ("Brand#3", 2), ("Brand#17", 3)], "path string, priority int")
    return joins.resolve_includes(parts.select("p_partkey", F.col("p_brand").alias("directory"), F.col("p_name").alias("text")), there, path).select("p_partkey", "found")


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#2' AND p_type = 'SMALL' AND p_size = 7")
def exact_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.find_match(table(spark, sf_dir, "part"), {"p_brand": "Brand#2", "p_type": "SMALL", "p_size": 7}).select("p_partkey")


@query("SELECT page_id FROM pages WHERE NOT contains(lower(url), '/en/') AND NOT contains(lower(url), 'ads') AND NOT regexp_full_match(lower(url), 'https://[^/]*example\\.net/.*') AND NOT regexp_full_match(lower(url), '.*/[0-9]*7')")
def files_not_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.without_excluded(table(spark, sf_dir, "pages"), F.col("url"), ["/EN/", "ads"], [r"https://[^/]*example\.net/.*", ".*/[0-9]*7"]).select("page_id")


FILES = f"(SELECT p_partkey, p_type, p_size, {PATH} AS path FROM part WHERE NOT contains(lower({PATH}), 'brand#1/') AND NOT regexp_full_match(lower({PATH}), '.*3\\.cpp'))"


@query(f"""WITH f AS (SELECT DISTINCT path, p_type, max(p_size) AS time FROM {FILES} GROUP BY ALL), h AS (SELECT path, max(time) AS time, string_agg(p_type, '; ' ORDER BY p_type) AS projects, {plain_rank("regexp_extract(path, '[^/]*$')", 'red')} AS rank FROM f GROUP BY path)
SELECT path, projects, rank, row_number() OVER (ORDER BY time DESC, lower(path), path) AS place FROM h WHERE rank > 0""")
def open_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of files: all projects' files but excluded ones, each once with its projects, filtered by name, by time."""
    c = F.col
    rows = match.without_excluded(files(spark, sf_dir), c("path"), ["Brand#1/"], [r".*3\.cpp"])
    once = grouping.joined_projects(rows, "path", "p_type").join(rows.groupBy("path").agg(F.max("p_size").alias("time")), "path")
    found = match.filter_files(once, c("path"), "red")
    return sorting.place(found, sorting.file_list_order("time", c("path"), c("projects"), c("time")), "path", []).select("path", "projects", "rank", "place")


HASHTAGS = f"""WITH t AS (SELECT *, {PATH} AS path FROM part WHERE p_type IN ('PROMO', 'SMALL') AND p_partkey % 97 NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)),
k AS (SELECT * FROM t WHERE lower(p_name) <> 'red ring' AND lower(p_brand) <> 'brand#2')"""


def hashtags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashtags of files that are there, without what the user ignores."""
    rows = files(spark, sf_dir).where("p_type in ('PROMO', 'SMALL')").withColumn("file_id", F.col("p_partkey") % 97)
    rows = refine.without_external(rows, F.lit(True), F.lit(False))
    gone = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("file_id"))
    live = rows.select("file_id").distinct().join(gone, "file_id", "left_anti")
    kept, _ = joins.purge_missing(rows, live, "file_id")
    rules = spark.createDataFrame([("t", "RED ring"), ("f", "brand#2")], "kind string, value string")
    return refine.without_rules(kept, rules, tag="p_name", file="p_brand", directory="path", project="p_type")


@query(HASHTAGS + f" SELECT p_partkey, row_number() OVER (ORDER BY {LOW.format('p_name')}, {LOW.format('path')}, p_size, p_partkey) AS place FROM k")
def hashtag_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered(hashtags(spark, sf_dir), sorting.hashtag_order(F.col("p_name"), F.col("path"), F.col("p_size")))


@query(HASHTAGS + " SELECT lower(p_name) AS tag_key, min(p_name) AS tag, count(*) AS n, count(*) FILTER (p_size < 10) AS n_hidden, count(*) - count(*) FILTER (p_size < 10) = 1 AS single FROM k GROUP BY 1")
def hashtag_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.by_tag(hashtags(spark, sf_dir), "p_name", F.col("p_size") < 10)


@query(HASHTAGS + ", old AS (SELECT p_name, path FROM k WHERE p_size > 10), new AS (SELECT p_name, path FROM k WHERE p_size <= 40), c AS (SELECT p_name, path, sum(n) AS n FROM (SELECT *, -1 AS n FROM old UNION ALL SELECT *, 1 FROM new) GROUP BY ALL) SELECT p_name, path, CASE WHEN n > 0 THEN 'added' ELSE 'removed' END AS change, CAST(abs(n) AS BIGINT) AS times FROM c WHERE n <> 0")
def hashtag_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed since the list was last shown."""
    now = hashtags(spark, sf_dir)
    return joins.list_changes(now.where("p_size > 10").select("p_name", "path"), now.where("p_size <= 40").select("p_name", "path"))


NAMES = "(SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN w || '.cpp' WHEN 1 THEN w || 'Impl.cpp' WHEN 2 THEN 'I' || w || '.h' WHEN 3 THEN w || 'Model2.cs' WHEN 4 THEN w || '_p.h' ELSE w || 'BaseEx.inl' END AS name FROM (SELECT *, replace(p_name, ' ', '') || CAST(p_partkey % 50 AS VARCHAR) || 'q' AS w FROM part))"


@query(f"""WITH n AS (SELECT p_partkey, lower(regexp_replace(name, '\\.[^.]*$', '')) AS base FROM {NAMES}), k AS (SELECT p_partkey, base, regexp_replace(regexp_replace(base, '[0-9]+$', ''), '(impl|ex|model|_p)$', '') AS k FROM n)
SELECT DISTINCT a.p_partkey, b.p_partkey AS other FROM k a JOIN k b ON a.p_partkey <> b.p_partkey AND (b.base = a.k OR b.base = 'i' || a.k OR starts_with(a.k, 'i') AND b.base = substr(a.k, 2))""")
def related_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    w = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), (c("p_partkey") % 50).cast("string"), F.lit("q"))
    kind = c("p_size") % 6
    name = F.when(kind == 0, F.concat(w, F.lit(".cpp"))).when(kind == 1, F.concat(w, F.lit("Impl.cpp"))).when(kind == 2, F.concat(F.lit("I"), w, F.lit(".h"))).when(kind == 3, F.concat(w, F.lit("Model2.cs"))).when(kind == 4, F.concat(w, F.lit("_p.h"))).otherwise(F.concat(w, F.lit("BaseEx.inl")))
    return joins.related_files(table(spark, sf_dir, "part").withColumn("name", name), "name", "p_partkey")


@query(f"SELECT p_partkey, {plain_rank('p_name', 're')} > 0 AND {plain_rank('p_name', 'o')} > 0 AND {plain_rank('p_name', 'gear')} = 0 AS shown FROM part")
def filtered_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.filter_nodes(table(spark, sf_dir, "part"), F.col("p_name"), "re o -gear").select("p_partkey", "shown")


@query(f"WITH k AS (SELECT * FROM part WHERE {plain_rank('p_name', 'bo')} > 0) SELECT p_partkey, p_brand, count(*) OVER (PARTITION BY p_brand) AS shown FROM k")
def filtered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.filter_groups(table(spark, sf_dir, "part"), "p_brand", F.col("p_name"), "bo").select("p_partkey", "p_brand", "shown")


@query(f"SELECT p_partkey, {plain_rank('p_name', 'red')} AS rank FROM part WHERE {plain_rank('p_name', 'red')} > 0")
def narrowed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A longer filter over what the shorter one has found."""
    every, name = table(spark, sf_dir, "part"), F.col("p_name")
    return match.refilter(every, match.filter_set(every, name, "re"), "re", "red", name).select("p_partkey", "rank")


@query(f"SELECT p_partkey, least({plain_rank('p_name', 'e')}, 9) AS rank FROM part WHERE {plain_rank('p_name', 'e')} > 0 AND {plain_rank('p_name', 're')} = 0")
def refiltered_from_scratch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A longer excluding term may find more, so all rows are searched again."""
    every, name = table(spark, sf_dir, "part"), F.col("p_name")
    return match.refilter(every, match.filter_set(every, name, "e -r"), "e -r", "e -re", name).select("p_partkey", "rank")


@query("SELECT p_partkey, p_size % 2 = 0 AS implementation FROM part WHERE p_type = 'SMALL'")
def implementations_and_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    yes, no = refine.implementations_and_declarations(table(spark, sf_dir, "part").where("p_type = 'SMALL'"), F.col("p_size") % 2 == 0)
    return yes.select("p_partkey", F.lit(True).alias("implementation")).unionByName(no.select("p_partkey", F.lit(False).alias("implementation")))


@query(f"WITH c(scope, base) AS (SELECT DISTINCT p_brand, 'Brand#' || CAST(p_size % 9 AS VARCHAR) FROM part) SELECT seq, def FROM {SYMBOLS} WHERE sym = 'ring' AND scope IN (SELECT scope FROM c WHERE base = 'Brand#2') ORDER BY seq LIMIT 50")
def definitions_in_derived_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    closures = table(spark, sf_dir, "part").select(F.col("p_brand").alias("scope"), F.concat(F.lit("Brand#"), (F.col("p_size") % 9).cast("string")).alias("base")).distinct()
    return lookup.definitions(symbols(spark, sf_dir), "ring", "Brand#2", closures=closures).select("seq", "def")


@query("SELECT p_partkey AS seq FROM part WHERE p_type = 'PROMO' AND regexp_extract(p_name, '[^ ]*$') = 'ring' ORDER BY seq LIMIT 50")
def hashtag_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name with a hash finds hashtags alone, as far as a list of 50 goes."""
    rows = symbols(spark, sf_dir).withColumn("sym_type", F.when(F.col("sym_type") == "PROMO", "HASHTAG").otherwise("FUNC")).withColumn("sym", F.when(F.col("sym_type") == "HASHTAG", F.concat(F.lit("#"), "sym")).otherwise(F.col("sym")))
    return lookup.definitions(rows, "#ring").select("seq")


@query("SELECT user_id, array_to_string(list_transform(list_sort(list({'k': k, 'e': event_type})), lambda x: x.e), ',') AS types FROM (SELECT user_id, event_type, min(event_id) AS k FROM events GROUP BY ALL) GROUP BY 1")
def first_seen_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's types of events in the order in which they came first."""
    events = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("at"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "event_type"))), lambda x: x["event_type"])
    return events.groupBy("user_id").agg(F.array_join(dedup.first_seen(listed), ",").alias("types"))


@query(f"SELECT p_partkey FROM (SELECT p_partkey, 'C:/' || CASE p_size % 4 WHEN 0 THEN 'moc_a.cpp' WHEN 1 THEN 'a.Generated.h' WHEN 2 THEN 'a.gen.cpp' ELSE 'a.cpp' END AS path FROM part) WHERE path = 'C:/a.cpp'")
def without_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_size") % 4
    path = F.concat(F.lit("C:/"), F.when(kind == 0, "moc_a.cpp").when(kind == 1, "a.Generated.h").when(kind == 2, "a.gen.cpp").otherwise("a.cpp"))
    return refine.unless_empty(table(spark, sf_dir, "part"), refine.generated(path)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_type = 'PROMO'")
def external_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every row is of an external file, all stay."""
    return refine.without_external(table(spark, sf_dir, "part").where("p_type = 'PROMO'"), F.lit(True), F.col("p_type") == "PROMO").select("p_partkey")


@query("SELECT p_partkey FROM part")
def active_projects_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without a project switches the filter off."""
    projects = F.when(F.col("p_size") == 3, F.array().cast("array<string>")).otherwise(F.array("p_brand"))
    return refine.active_projects(table(spark, sf_dir, "part"), projects, ["Brand#2"]).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size % 3 = 0")
def namespace_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine.namespace_bodies(table(spark, sf_dir, "part"), F.lit(True), F.col("p_size") % 3 == 0).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_type = 'SMALL'")
def implementations_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine.implementations(table(spark, sf_dir, "part"), F.col("p_type") == "SMALL", None).select("p_partkey")


@query("SELECT p_partkey FROM (SELECT * FROM part ORDER BY p_size % 2, p_partkey LIMIT 1)")
def implementation_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a declaration and its implementation, the latter."""
    parts = table(spark, sf_dir, "part").withColumn("even", F.col("p_size") % 2 == 0)
    two = parts.groupBy("even").agg(F.min("p_partkey").alias("p_partkey"))
    return refine.implementations(two, F.col("even")).select("p_partkey")


CANDIDATES = f"""WITH r AS (SELECT *, {PATH.replace("'.CPP'", "CASE WHEN p_size % 13 = 0 THEN '.gen.cpp' ELSE '.CPP' END")} AS path FROM part), v AS (SELECT * FROM r WHERE (p_size % 10 <> 0 OR p_type = 'PROMO') AND NOT (p_type = 'PROMO' AND p_size % 3 = 0)),
g AS (SELECT p_name, min(path) <> max(path) AS many, bool_or(p_size > 40) AS anyp FROM v GROUP BY p_name), p AS (SELECT v.* FROM v JOIN g USING (p_name) WHERE p_size > 40 OR NOT many OR NOT anyp),
a AS (SELECT * FROM p WHERE p_brand IN ('Brand#2', 'Brand#3', 'Brand#12') OR NOT EXISTS (SELECT 1 FROM p WHERE p_brand IN ('Brand#2', 'Brand#3', 'Brand#12'))),
l AS ({{language}}), u AS (SELECT * FROM l WHERE NOT contains(lower(path), '.gen.') OR NOT EXISTS (SELECT 1 FROM l WHERE NOT contains(lower(path), '.gen.'))),
o AS (SELECT * FROM u WHERE p_partkey % 2 = 0 OR NOT EXISTS (SELECT 1 FROM u WHERE p_partkey % 2 = 0)),
c AS (SELECT * FROM o WHERE p_partkey IS DISTINCT FROM (SELECT p_partkey FROM o WHERE p_partkey % 7 = 2 AND p_size < 48 ORDER BY p_size DESC, p_partkey DESC LIMIT 1))
SELECT p_partkey FROM c WHERE p_retailprice > 1000 OR NOT EXISTS (SELECT 1 FROM c WHERE p_retailprice > 1000)"""


def definition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    end = F.when(c("p_size") % 13 == 0, F.regexp_replace("path", r"\.CPP$", ".gen.cpp")).otherwise(c("path"))
    return files(spark, sf_dir).withColumns({
        "path": end, "hidden": c("p_size") % 10 == 0, "is_hashtag": c("p_type") == "PROMO", "is_reference": c("p_size") % 3 == 0, "name": c("p_name"), "in_project": c("p_size") > 40, "projects": F.array("p_brand"),
        "preferred": c("p_size") % 4 == 1, "is_system": c("p_type").isin("SMALL", "ECONOMY"), "is_external": c("p_type") == "SMALL", "is_namespace": F.lit(True), "has_body": c("p_size") % 2 == 1, "n_params": c("p_partkey") % 2,
        "file_id": c("p_partkey") % 7, "line": c("p_size"), "seq": c("p_partkey"), "is_implementation": c("p_retailprice") > 1000,
    })


def definition_query(language: str, step: str):
    def found(spark: SparkSession, sf_dir: str) -> DataFrame:
        return refine.definition_pipeline(definition_rows(spark, sf_dir), language=language, active=["Brand#2", "Brand#3", "Brand#12"], arguments=0, current=(2, 48), exactly=None).select("p_partkey")

    found.__name__ = f"definitions_in_{language}"
    query(CANDIDATES.replace("{language}", step))(found)


@query(CANDIDATES.replace("{language}", "SELECT * FROM p WHERE p_type <> 'SMALL' OR NOT EXISTS (SELECT 1 FROM p WHERE p_type = 'ECONOMY')").split("o AS (")[0].rstrip().rstrip(",") + " SELECT p_partkey FROM u WHERE p_retailprice > 1000 OR NOT EXISTS (SELECT 1 FROM u WHERE p_retailprice > 1000)")
def go_to_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of all names, asked from no file."""
    return refine.definition_pipeline(definition_rows(spark, sf_dir), exactly=None).select("p_partkey")


@query("SELECT p_partkey FROM part")
def implementations_need_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of more than two rows all stay, whatever they are."""
    return refine.implementations(table(spark, sf_dir, "part"), F.col("p_type") == "SMALL").select("p_partkey")


definition_query("c", "SELECT * FROM a WHERE p_type <> 'SMALL' OR NOT EXISTS (SELECT 1 FROM a WHERE p_type = 'ECONOMY')")
definition_query("cs", "SELECT * FROM a WHERE p_size % 2 = 1 OR NOT EXISTS (SELECT 1 FROM a WHERE p_size % 2 = 1)")
definition_query("js", "SELECT * FROM a WHERE p_size % 4 = 1 OR NOT EXISTS (SELECT 1 FROM a WHERE p_size % 4 = 1)")


FOUND = f"SELECT def AS name, 'C:/f' || CAST(file_id AS VARCHAR) AS path, file_id, line, CASE sym_type WHEN 'SMALL' THEN 'CLASS' WHEN 'PROMO' THEN 'VAR' ELSE 'FUNC' END AS kind, line > 25 AS solution, line % 2 = 0 AS body, seq FROM {SYMBOLS} WHERE line % 5 <> 0 AND {plain_rank('sym', 'bo')} > 0"


@query(f"""WITH RECURSIVE {neighbours_sql(FOUND)}, d AS (SELECT s.*, {plain_rank('sym', 'bo')} AS rank, {LOW.format('sym')} AS low, printf('%x', file_id) AS fx, printf('%x', line) AS lx FROM {SYMBOLS} s JOIN kept USING (seq)), p AS (SELECT *, row_number() OVER (ORDER BY low, fx, length(lx), lx, seq) AS place FROM d)
SELECT seq, sym, rank, place, place = (SELECT min(place) FROM p WHERE rank = (SELECT max(rank) FROM p)) AS suggested FROM p""")
def find_symbol_from_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find symbol from end to end: text records, hidden ones left out, filtered, each held against the one kept before it, in order,
    with the one that is suggested."""
    c = F.col
    hexed = lambda x: F.lower(F.hex(x.cast("long")))
    rows = symbols(spark, sf_dir)
    kinds = {"SMALL": "CLASS", "PROMO": "VAR"}
    numbers = {"CLASS": 1, "VAR": 2, "FUNC": 3}
    mapped = lambda key, pairs, other: F.coalesce(F.create_map(*(F.lit(x) for p in pairs.items() for x in p))[key], F.lit(other))
    number = mapped(mapped(c("sym_type"), kinds, "FUNC"), numbers, 3)
    text_ = sources.record(F.concat_ws(":", F.lit(""), "scope", "sym"), c("def"), number, c("seq"), c("file_id"), c("line"))
    path = shared_folder(spark, "records")
    rows.select(F.when(c("line") % 5 == 0, F.concat(F.lit("0"), F.substring(text_, 2, 1 << 30))).otherwise(text_).alias("value")).write.text(path)
    found = match.filter_set(sources.read_symbols(spark, path).withColumn("seq", c("attrs")), c("sym"), "bo")
    kind = mapped(c("sym_type").cast("int"), {v: k for k, v in numbers.items()}, "FUNC")
    once = adjacent.without_neighbours(found.withColumns({"sym_scope": c("def"), "path": F.concat(F.lit("C:/f"), c("file_id").cast("string")), "sym_type": kind, "in_solution": c("line") > 25, "has_body": c("line") % 2 == 0}))
    placed = sorting.place(once, sorting.name_order(c("sym"), hexed(c("file_id")), hexed(c("line"))), "seq", []).select("seq", "sym", "rank", "place")
    best = match.suggested(placed, "place").select(c("place").alias("_best"))
    return placed.join(F.broadcast(best)).withColumn("suggested", c("place") == c("_best")).drop("_best")


WORD = r"(^|[^A-Za-z0-9_@$\x{80}-\x{10FFFF}])the([^A-Za-z0-9_@$\x{80}-\x{10FFFF}]|$)"


@query(f"""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents), h AS (SELECT * FROM l WHERE regexp_matches(t, '{WORD}')), b AS (SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM h)
SELECT source AS file, count(*) AS n, count(DISTINCT doc_id) AS files FROM b WHERE (before IS NULL OR before <> t) AND (1 << (line % 8)::INT) & 126 <> 0 GROUP BY 1""")
def grouped_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find references from end to end: documents with the word, their lines, without repeats of the line before and without types
    that are masked, grouped by source."""
    docs = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("the")) & text.has_word(F.col("text"), "the"))
    lines = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line", "t")).withColumn("line", F.col("line") + 1).where(text.has_word(F.col("t"), "the"))
    kept = refine.by_type_mask(dedup.without_repeats(lines, "t", ["line"], ["doc_id"]), F.col("line") % 8, 126)
    return kept.groupBy(F.col("source").alias("file")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("files"))


#: Kinds of a header table's lists, the best first (fixed values).
KINDS = ("classes", "types", "typedefs", "objects", "enumerations", "declarations", "macros")


@query("""WITH h AS (SELECT DISTINCT p_name AS symbol, p_brand AS file, CASE p_type WHEN 'PROMO' THEN 0 WHEN 'SMALL' THEN 1 WHEN 'ECONOMY' THEN 2 WHEN 'LARGE' THEN 5 ELSE 6 END AS kind FROM part) SELECT symbol, arg_min(file, {'k': kind, 'f': file}) AS file, CAST(min(kind) AS BIGINT) AS kind FROM h GROUP BY symbol""")
def header_of_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol's header by the best kind of list that names it, from a JSON table."""
    names = {"PROMO": "classes", "SMALL": "types", "ECONOMY": "typedefs", "LARGE": "declarations"}
    kind = F.coalesce(F.create_map(*(F.lit(x) for p in names.items() for x in p))[F.col("p_type")], F.lit("macros"))
    lists = table(spark, sf_dir, "part").groupBy("p_brand", kind.alias("kind")).agg(F.collect_set("p_name").alias("names"))
    nested = lists.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("kind", "names"))).alias("symbols"))
    path = shared_folder(spark, "headers")
    nested.select(F.col("p_brand").alias("filename"), F.lit("std").alias("namespace"), "symbols").write.json(path)
    return lookup.header_of(sources.read_headers(spark, path, lines=True), KINDS).withColumn("kind", F.col("kind").cast("long"))


@query(f"""WITH p(scope, rank) AS (VALUES ('Brand#2', 1), ('Brand#3', 2), ('', -1000)), s AS (SELECT *, CASE WHEN file_id < 20 THEN 0 WHEN file_id < 60 THEN 1 ELSE 2 END AS source_no FROM {SYMBOLS}), h AS (SELECT s.*, p.rank FROM s JOIN p USING (scope)), f AS (SELECT sym, min(source_no) AS source_no FROM h GROUP BY sym)
SELECT sym, source_no, max(rank) AS rank, arg_max(seq, {{'r': rank, 's': -seq}}) AS seq FROM h JOIN f USING (sym, source_no) GROUP BY ALL""")
def ranked_lookup_across_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name in the first database that has it along the path, by its best rank there."""
    s = symbols(spark, sf_dir)
    path = lookup.lookup_path(spark, ["Brand#2", "Brand#3"])
    found = lookup.first_source([x.join(path, "scope") for x in (s.where("file_id < 20"), s.where("file_id >= 20 and file_id < 60"), s.where("file_id >= 60"))], ["sym"])
    best = F.max(F.struct("rank", (-F.col("seq")).alias("s"))).alias("m")
    return found.groupBy("sym", "source_no").agg(best).select("sym", "source_no", F.col("m.rank").alias("rank"), (-F.col("m.s")).alias("seq"))


METHODS = "(SELECT p_brand AS parent, p_partkey AS place, p_type = 'PROMO' AS target, p_size AS header FROM part)"


@query(f"""WITH m AS (SELECT * FROM {METHODS}), d AS (SELECT b.parent, b.place, b.header, t.place AS dep FROM m b JOIN m t ON b.parent = t.parent AND t.place < b.place WHERE b.target AND NOT t.target),
x AS (SELECT DISTINCT a.place, d.dep FROM m a JOIN d ON d.parent = a.parent AND d.place <> a.place AND a.header < d.header WHERE a.target UNION SELECT place, dep FROM d) SELECT place, count(*) AS n, min(dep) AS first, max(dep) AS last FROM x GROUP BY place""")
def method_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must stand before each method once the methods are in their header's order."""
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("parent"), F.col("p_partkey").alias("place"), (F.col("p_type") == "PROMO").alias("target"), F.col("p_size").alias("header"))
    return graph.method_dependencies(parts)


@query(f"""WITH m AS (SELECT * FROM {METHODS} WHERE target), t AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY header, place) AS turn FROM m), s AS (SELECT parent, place AS slot, row_number() OVER (PARTITION BY parent ORDER BY place) AS turn FROM m) SELECT parent, place, slot FROM t JOIN s USING (parent, turn)""")
def method_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods take the places of methods in the order of their header; all else stays."""
    methods = table(spark, sf_dir, "part").where("p_type = 'PROMO'").select(F.col("p_brand").alias("parent"), F.col("p_partkey").alias("place"), F.col("p_size").alias("header"))
    turn = sorting.place(methods, [F.col("header")], "place", ["parent"], "turn")
    slots = sorting.place(methods, [], "place", ["parent"], "turn").select("parent", F.col("place").alias("slot"), "turn")
    return turn.join(slots, ["parent", "turn"]).select("parent", "place", "slot")


@query(f"""WITH m AS (SELECT * FROM {METHODS}), l AS (SELECT parent, max(place) AS lowest FROM m WHERE target GROUP BY parent)
SELECT parent, place, row_number() OVER (PARTITION BY parent ORDER BY CASE WHEN target THEN 1 WHEN place < lowest THEN 0 ELSE 2 END, CASE WHEN target THEN header END, place) AS turn FROM m LEFT JOIN l USING (parent)""")
def rearranged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts of a class once its methods are in their header's order and what they need stands before them."""
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("parent"), F.col("p_partkey").alias("place"), (F.col("p_type") == "PROMO").alias("target"), F.col("p_size").alias("header"))
    return graph.rearranged(parts)


@query("SELECT p_partkey, CASE WHEN p_name LIKE 'red %' THEN 'RED' || substr(p_name, 4) ELSE p_name END AS text FROM part")
def replaced_by_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each match is replaced by what a function makes of it."""
    return table(spark, sf_dir, "part").select("p_partkey", text.replace_by(F.col("p_name"), "^red(?= )", str.upper).alias("text"))


@query("SELECT p_partkey, length(p_name) * p_size AS weight FROM part WHERE p_size % 2 = 0")
def row_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function sees batches of rows and gives rows of its own."""

    def visit(rows):
        even = rows[rows["p_size"] % 2 == 0]
        return even[["p_partkey"]].assign(weight=even["p_name"].str.len() * even["p_size"])

    return maintenance.for_each_batch(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), visit, "p_partkey long, weight long")


@query("SELECT 'orders' AS step, count(*) AS found, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders")
def observed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an observer hears of a search that runs once."""
    seen = maintenance.observed(table(spark, sf_dir, "orders"), {"found": F.count(F.lit(1)), "done": F.count_if(F.col("o_orderstatus") == "F")})
    return spark.createDataFrame([("orders", seen["found"], seen["done"])], "step string, found long, done long")
