"""Queries of joins, graphs, hierarchies, sources, sinks, maintenance and streams, with SQL for DuckDB where it can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, joins
from ..sources import symbols as sources
from .shared import query, shared_folder, table


@query("SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 45")
def dictionary_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_quantity > 45").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "s_name")


@query("""SELECT e.event_id, (SELECT f.value FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'purchase' AND f.ts < e.ts ORDER BY f.ts DESC, f.event_id DESC LIMIT 1) AS asof_value FROM events e WHERE e.event_type = 'error'""")
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error with the value of the user's last purchase before it."""
    events = table(spark, sf_dir, "events")
    return joins.as_of(events.where("event_type = 'error'"), events.where("event_type = 'purchase'"), "user_id", "ts", "ts", "value", "event_id").select("event_id", "asof_value")


@query("SELECT p_partkey FROM part WHERE p_partkey <> (SELECT p_partkey FROM part WHERE p_size < 20 ORDER BY p_size DESC, p_partkey DESC LIMIT 1)")
def closest_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.closest_before(table(spark, sf_dir, "part"), F.col("p_size"), "p_partkey", 20).select("p_partkey")


@query("""WITH a AS (SELECT p_partkey AS a_id, p_name AS a_name, p_size FROM part WHERE p_brand = 'Brand#2'), b AS (SELECT p_partkey AS b_id, p_name AS b_name, p_size FROM part WHERE p_brand = 'Brand#3'),
d AS (SELECT a_id, b_id, CASE WHEN a_name = b_name THEN 0 ELSE least(levenshtein(a_name, b_name), levenshtein(lower(a_name), lower(b_name)), levenshtein(regexp_replace(lower(a_name), '\\s+', '', 'g'), regexp_replace(lower(b_name), '\\s+', '', 'g'))) END AS distance FROM a JOIN b USING (p_size))
SELECT a_id, b_id, CAST(distance AS BIGINT) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY distance, b_id) AS k FROM d) WHERE k = 1""")
def nearest_by_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    a = parts.where("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("a_id"), F.col("p_name").alias("a_name"), "p_size")
    b = parts.where("p_brand = 'Brand#3'").select(F.col("p_partkey").alias("b_id"), F.col("p_name").alias("b_name"), "p_size")
    return joins.nearest_by_edits(a, b, "p_size", "a_name", "b_name", "a_id", "b_id").withColumn("distance", F.col("distance").cast("long"))


@query("""WITH p(directory, priority) AS (VALUES ('PROMO', 1), ('SMALL', 2), ('ECONOMY', 3)) SELECT name, directory, CAST(priority AS BIGINT) AS priority FROM (SELECT p_name AS name, directory, priority, row_number() OVER (PARTITION BY p_name ORDER BY priority) AS k FROM part JOIN p ON p_type = directory) WHERE k = 1""")
def search_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    path = spark.createDataFrame([("PROMO", 1), ("SMALL", 2), ("ECONOMY", 3)], "directory string, priority long")
    return joins.resolve_names(parts.select(F.col("p_name").alias("name")), parts.select(F.col("p_name").alias("name"), F.col("p_type").alias("directory")).distinct(), path)


@query("""WITH a AS (SELECT p_name, p_type FROM part WHERE p_size > 10), b AS (SELECT p_name, p_type FROM part WHERE p_size <= 40), c AS (SELECT p_name, p_type, sum(n) AS n FROM (SELECT *, -1 AS n FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY ALL)
SELECT p_name, p_type, CASE WHEN n > 0 THEN 'added' ELSE 'removed' END AS change, CAST(abs(n) AS BIGINT) AS times FROM c WHERE n <> 0""")
def list_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return joins.list_changes(parts.where("p_size > 10").select("p_name", "p_type"), parts.where("p_size <= 40").select("p_name", "p_type"))


@query("""WITH d AS (SELECT * FROM orders WHERE o_orderstatus <> 'P'), i AS (SELECT * FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT coalesce(d.o_orderkey, i.o_orderkey) AS file_id, CASE WHEN d.o_orderkey IS NULL THEN 'deleted' WHEN i.o_orderkey IS NULL THEN 'new' WHEN i.o_totalprice <= 250000 THEN 'same' WHEN i.o_orderstatus = 'F' THEN 'changed' ELSE 'touched' END AS status FROM d FULL JOIN i ON d.o_orderkey = i.o_orderkey""")
def snapshot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index lacks orders of low priority, the disk those that are pending; some dear ones have changed since."""
    c = F.col
    orders = table(spark, sf_dir, "orders")
    state = lambda mtime, hashed: (c("o_orderkey").alias("file_id"), mtime.alias("mtime"), F.lit(1).alias("size"), hashed.alias("hash"))
    later = F.when(c("o_totalprice") > 250_000, c("o_orderdate") + F.expr("interval 1 day")).otherwise(c("o_orderdate"))
    disk = orders.where("o_orderstatus <> 'P'").select(*state(later, F.when(c("o_orderstatus") == "F", "y").otherwise("x")))
    return joins.snapshot_status(disk, orders.where("o_orderpriority <> '5-LOW'").select(*state(c("o_orderdate"), F.lit("x"))))


LISTED = "SELECT o_orderkey AS file_id, CASE o_orderkey % 5 WHEN 0 THEN 'other' WHEN 1 THEN 'source' ELSE 'header' END AS kind, o_custkey % 4 = 0 AS system FROM orders WHERE o_orderkey % 7 <> 3"


@query(f"""WITH l AS ({LISTED}), d AS (SELECT o_orderkey AS file_id, o_totalprice > 200000 AS later, o_orderstatus = 'F' AS other FROM orders WHERE o_orderkey % 11 <> 5),
i AS (SELECT o_orderkey AS file_id, o_custkey % 13 <> 1 AS timed, CASE o_custkey % 3 WHEN 0 THEN 'system' WHEN 1 THEN 'solution' ELSE 'project' END AS db FROM orders WHERE o_orderpriority <> '5-LOW'), m AS (SELECT o_orderkey AS file_id FROM orders WHERE o_custkey % 2 = 0),
j AS (SELECT file_id, kind, system, l.file_id IS NOT NULL AS listed, d.file_id IS NOT NULL AS there, coalesce(timed, false) AS known, later, other, db, m.file_id IS NOT NULL AS loaded FROM l FULL JOIN d USING (file_id) FULL JOIN i USING (file_id) LEFT JOIN m USING (file_id)),
a AS (SELECT *, CASE WHEN NOT listed AND NOT there AND db IS NOT NULL THEN 'remove' WHEN NOT (listed AND there) OR kind = 'other' THEN NULL WHEN known AND NOT later THEN CASE WHEN loaded THEN NULL ELSE 'load' END WHEN loaded AND known AND NOT other THEN NULL ELSE 'update' END AS action FROM j)
SELECT file_id, action, CASE WHEN action = 'remove' THEN 'removed' WHEN db = 'solution' THEN 'solution' WHEN db = 'system' OR db IS NULL AND system THEN 'system' WHEN kind = 'header' THEN 'global' ELSE 'source' END AS route FROM a WHERE action IS NOT NULL""")
def routed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be loaded, updated and removed when an index is opened, and by which of its parts."""
    c = F.col
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey").alias("file_id")
    listed = orders.where("o_orderkey % 7 <> 3").select(key, F.when(c("o_orderkey") % 5 == 0, "other").when(c("o_orderkey") % 5 == 1, "source").otherwise("header").alias("kind"), (c("o_custkey") % 4 == 0).alias("system"))
    later = F.when(c("o_totalprice") > 200_000, c("o_orderdate") + F.expr("interval 1 day")).otherwise(c("o_orderdate"))
    disk = orders.where("o_orderkey % 11 <> 5").select(key, later.alias("mtime"), F.lit(1).alias("size"), F.when(c("o_orderstatus") == "F", "y").otherwise("x").alias("hash"))
    db = F.when(c("o_custkey") % 3 == 0, "system").when(c("o_custkey") % 3 == 1, "solution").otherwise("project")
    indexed = orders.where("o_orderpriority <> '5-LOW'").select(key, F.when(c("o_custkey") % 13 != 1, c("o_orderdate")).alias("mtime"), F.lit(1).alias("size"), F.lit("x").alias("hash"), db.alias("db"))
    return joins.routed_changes(listed, disk, indexed, orders.where("o_custkey % 2 = 0").select(key))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def purge_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return joins.purge(table(spark, sf_dir, "lineitem"), gone, "l_suppkey").select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, CASE WHEN p_brand = 'Brand#2' THEN 'new' ELSE p_type END AS p_type FROM part")
def update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = spark.createDataFrame([("Brand#2", "new")], "p_brand string, p_type string")
    return joins.update_where(table(spark, sf_dir, "part"), changes, ["p_brand"], "p_type").select("p_partkey", "p_type")


EDGES = "(SELECT p_partkey AS a, (p_partkey * 7 + 3) % 1000 AS b FROM part UNION SELECT p_partkey, (p_partkey * 13 + 5) % 1000 FROM part WHERE p_size > 25)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation derived from all parts: each has one or two targets."""
    parts, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    one = parts.select(key.alias("a"), ((key * 7 + 3) % 1000).alias("b"))
    return one.unionByName(parts.where("p_size > 25").select(key.alias("a"), ((key * 13 + 5) % 1000).alias("b"))).distinct()


def promoted_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_type = 'PROMO'").select(F.col("p_partkey").alias("root")).distinct()


CLOSURE = f"WITH RECURSIVE e AS (SELECT * FROM {EDGES} WHERE a <> b), c(root, node, depth) AS (SELECT a, a, 0 FROM (SELECT DISTINCT p_partkey AS a FROM part WHERE p_type = 'PROMO') UNION SELECT root, b, depth + 1 FROM c JOIN e ON node = a WHERE depth < 5)"


@query(CLOSURE + " SELECT root, node, CAST(min(depth) AS BIGINT) AS depth FROM c GROUP BY ALL HAVING min(depth) > 0")
def include_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within five edges of some roots."""
    return graph.closure(edges(spark, sf_dir), promoted_roots(spark, sf_dir), 5).withColumn("depth", F.col("depth").cast("long"))


@query(CLOSURE + ", m AS (SELECT root, node, min(depth) AS depth FROM c GROUP BY ALL HAVING min(depth) > 0) SELECT node, root, CAST(depth AS BIGINT) AS depth FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY depth, root) AS k FROM m WHERE node IN (SELECT p_partkey FROM part WHERE p_retailprice > 950)) WHERE k = 1")
def preferred_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each wanted node, the root that includes it most directly."""
    reached = graph.closure(edges(spark, sf_dir), promoted_roots(spark, sf_dir), 5)
    wanted = table(spark, sf_dir, "part").where("p_retailprice > 950").select(F.col("p_partkey").alias("node")).distinct()
    return graph.nearest_header(reached, wanted).withColumn("depth", F.col("depth").cast("long"))


@query(f"WITH RECURSIVE e AS (SELECT * FROM {EDGES}), c(root, node) AS (SELECT a, b FROM e UNION SELECT root, b FROM c JOIN e ON node = a WHERE root <> node) SELECT DISTINCT root AS node FROM c WHERE root = node")
def circular_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes on cycles of any length."""
    return graph.cycles(edges(spark, sf_dir))


@query(f"WITH RECURSIVE e AS (SELECT * FROM {EDGES} WHERE a <> b), c(root, node, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_type = 'PROMO' AND p_size > 40 UNION SELECT root, b, depth + 1 FROM c JOIN e ON node = a WHERE depth < 30) SELECT root, node, CAST(min(depth) AS BIGINT) AS depth FROM c GROUP BY ALL HAVING min(depth) > 0")
def base_class_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base classes of some roots, up to 30 deep."""
    roots = table(spark, sf_dir, "part").where("p_type = 'PROMO' and p_size > 40").select(F.col("p_partkey").alias("root")).distinct()
    return graph.closure(edges(spark, sf_dir), roots, 30).withColumn("depth", F.col("depth").cast("long"))


@query("""WITH RECURSIVE a AS (SELECT p_partkey AS name, p_partkey // 2 AS target FROM part WHERE p_partkey > 0), c(name, target, hops) AS (SELECT name, target, 1 FROM a UNION ALL SELECT c.name, a.target, hops + 1 FROM c JOIN a ON c.target = a.name WHERE hops < 10)
SELECT name, arg_max(target, hops) AS target, CAST(max(hops) AS BIGINT) AS hops FROM c GROUP BY name""")
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = table(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("name"), F.expr("p_partkey div 2").alias("target"))
    return graph.resolve_aliases(aliases).withColumn("hops", F.col("hops").cast("long"))


@query("""WITH RECURSIVE a AS (SELECT DISTINCT name, target FROM (SELECT p_partkey AS name, p_partkey // 2 AS target FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey % 5 = 1 AND p_partkey > 1)),
c(name, target, hops) AS (SELECT name, target, 1 FROM a UNION SELECT c.name, a.target, hops + 1 FROM c JOIN a ON c.target = a.name WHERE hops < 10) SELECT name, target, CAST(min(hops) AS BIGINT) AS hops FROM c WHERE hops = 10 OR target NOT IN (SELECT name FROM a) GROUP BY ALL""")
def aliases_of_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that stand for several others: all ends of their chains."""
    parts, key = table(spark, sf_dir, "part"), F.col("p_partkey").alias("name")
    two = parts.where("p_partkey > 0").select(key, F.expr("p_partkey div 2").alias("target")).unionAll(parts.where("p_partkey % 5 = 1 and p_partkey > 1").select(key, F.expr("p_partkey div 3")))
    return graph.resolve_aliases(two).withColumn("hops", F.col("hops").cast("long"))


@query(f"WITH RECURSIVE e AS (SELECT * FROM {EDGES} WHERE a <> b AND a % 5 = b % 5), c(root, node, depth) AS (SELECT a, a, 0 FROM (SELECT DISTINCT p_partkey AS a FROM part WHERE p_type = 'PROMO') UNION SELECT root, b, depth + 1 FROM c JOIN e ON node = a WHERE depth < 5) SELECT root, node, CAST(min(depth) AS BIGINT) AS depth FROM c GROUP BY ALL HAVING min(depth) > 0")
def include_closure_in_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As include_closure, along includes of the same directory alone."""
    within = edges(spark, sf_dir).where(F.col("a") % 5 == F.col("b") % 5)
    return graph.closure(within, promoted_roots(spark, sf_dir), 5).withColumn("depth", F.col("depth").cast("long"))


@query("SELECT p_partkey AS file_id FROM part WHERE p_size IN (3, 7)")
def records_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited records of some kinds alone."""
    c = F.col
    path = shared_folder(spark, "symbols")
    table(spark, sf_dir, "part").select(sources.record(F.concat_ws(":", F.lit(""), "p_brand", "p_name"), c("p_type"), c("p_size"), F.lit(0), c("p_partkey"), F.lit(1)).alias("value")).write.text(path)
    return sources.read_symbols(spark, path, types_only=(3, 7)).select("file_id")


@query("SELECT l_suppkey AS a, l_partkey AS b, min(s_nationkey) AS file_id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL")
def reversed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("derived"), F.col("l_suppkey").alias("base")).distinct()
    return graph.reversed_edges(links, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sym"), F.col("s_nationkey").alias("file_id")))


@query("SELECT DISTINCT l_suppkey AS file, l_linenumber AS line FROM lineitem WHERE l_partkey = 7")
def direct_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_linenumber").alias("line"))
    return graph.neighbours(links, 7)


@query("SELECT DISTINCT l_partkey AS file, l_linenumber AS line FROM lineitem WHERE l_suppkey = 3")
def included_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_linenumber").alias("line"))
    return graph.neighbours(links, 3, incoming=True)


@query("""WITH c AS (SELECT r_name, n_name, c_mktsegment, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT ancestor, CAST(sum(v) AS BIGINT) AS total, count(*) AS n FROM (SELECT r_name AS ancestor, c_custkey AS v FROM c UNION ALL SELECT r_name || ':' || n_name, c_custkey FROM c UNION ALL SELECT r_name || ':' || n_name || ':' || c_mktsegment, c_custkey FROM c) GROUP BY 1""")
def hierarchy_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws(":", "r_name", "n_name", "c_mktsegment").alias("path"), "c_custkey")
    return graph.roll_up(rows, "path", "c_custkey")


REFS = "(SELECT l_orderkey * 10 + l_linenumber AS seq, l_partkey AS src, 1000000 + l_suppkey AS dst, l_linenumber % 3 AS kind, CAST(1 << l_linenumber AS BIGINT) AS attrs, CAST(l_quantity AS INTEGER) % 5 AS line FROM lineitem)"


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("seq"), c("l_partkey").alias("src"), (c("l_suppkey") + 1_000_000).alias("dst"), (c("l_linenumber") % 3).alias("kind"), F.call_function("shiftleft", F.lit(1), c("l_linenumber")).cast("long").alias("attrs"), (c("l_quantity").cast("int") % 5).alias("line"))


@query(f"""WITH e AS (SELECT src AS node, seq, kind, attrs, line FROM {REFS} UNION ALL SELECT dst, seq, kind, attrs, line FROM {REFS})
SELECT node, bit_or(attrs) AS attrs, coalesce(arg_min(kind, seq) FILTER (kind <> 0), 0) AS kind, coalesce(arg_min(line, seq) FILTER (line <> 0), 0) AS line FROM e GROUP BY node""")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes_and_links(references(spark, sf_dir))[0]


@query(f"SELECT src, dst, count(*) AS refs, min(line) AS line FROM {REFS} GROUP BY ALL")
def graph_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes_and_links(references(spark, sf_dir))[1]


@query("SELECT DISTINCT p_size AS node, CAST((p_size - 1) // 10 AS BIGINT) AS level FROM part")
def topological_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, each of which must precede the one that is ten larger."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_size").alias("node")).distinct()
    before = nodes.select(F.col("node").alias("a"), (F.col("node") + 10).alias("b"))
    return graph.levels(before, nodes).withColumn("level", F.col("level").cast("long"))


@query("""WITH p AS (SELECT a.page_id, string_split(a.url, '/') AS x, string_split(b.url, '/') AS y FROM pages a JOIN pages b ON b.page_id = a.page_id + 1), n AS (SELECT *, least(len(x), len(y)) - 1 AS m FROM p),
k AS (SELECT *, list_position(list_concat(list_transform(range(1, m + 1), lambda i: x[i] = y[i]), [false]), false) - 1 AS k FROM n) SELECT page_id, CASE WHEN k > 0 THEN array_to_string(x[1:k], '/') || '/' ELSE '' END AS prefix FROM k""")
def common_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The common directory of each page and the next."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    following = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next"))
    return pages.join(following, "page_id").select("page_id", text.common_prefix(F.col("url"), F.col("next")).alias("prefix"))


@query("SELECT p_partkey AS file_id, p_brand AS scope, p_name AS sym, p_type AS def, CAST(p_size AS BIGINT) AS sym_type, CAST(p_size * 3 AS BIGINT) AS attrs, CAST(p_partkey % 97 AS BIGINT) AS line FROM part")
def symbol_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols written as delimited text, read and parsed again."""
    c = F.col
    rows = table(spark, sf_dir, "part").select(sources.record(F.concat_ws(":", F.lit(""), "p_brand", "p_name"), c("p_type"), c("p_size"), c("p_size") * 3, c("p_partkey"), c("p_partkey") % 97).alias("value"))
    path = shared_folder(spark, "symbols")
    rows.unionByName(spark.createDataFrame([("0\x02hidden",), ("#comment",), ("1\x02:a:9x\x02d\x0200000001\x020\x021\x021",), ("1\x02short",)], "value string")).write.text(path)
    back = sources.read_symbols(spark, path)
    return back.select("file_id", F.regexp_replace("scope", "^:", "").alias("scope"), "sym", "def", c("sym_type").cast("long").alias("sym_type"), "attrs", c("line").cast("long").alias("line"))


@query("SELECT DISTINCT p_name AS sym, p_brand AS scope FROM part WHERE starts_with(p_name, 're')")
def letter_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins by first letter, of which one is read."""
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("sym"), F.col("p_brand").alias("scope"), F.lit(1).alias("sym_type"), F.lit(0).alias("attrs"))
    path = shared_folder(spark, "bins")
    sources.write_letter_bins(rows, path)
    return sources.read_letter(spark, path, "re").select("sym", "scope")


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@query("SELECT p_type AS kind, p_brand AS namespace, p_name AS symbol FROM (SELECT DISTINCT p_type, p_brand, p_name FROM part)")
def header_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested header table written as JSON and flattened again."""
    names = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.collect_set("p_name").alias("names"))
    nested = names.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "names"))).alias("symbols"))
    path = shared_folder(spark, "headers")
    nested.select(F.concat(F.translate("p_brand", "#", "_"), F.lit(".h")).alias("filename"), F.col("p_brand").alias("namespace"), "symbols").write.json(path)
    return sources.read_headers(spark, path, lines=True).select("kind", "namespace", "symbol")


@query("SELECT doc_id, count(w) AS n, count(DISTINCT w) AS n_distinct FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_@$\\x{80}-\\x{10FFFF}][A-Za-z0-9_@$\\x{80}-\\x{10FFFF}]*')) AS w FROM documents) GROUP BY doc_id")
def source_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, different = sources.identifier_counts(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n"), different.alias("n_distinct")).where("n > 0")


@query("SELECT w AS identifier, count(*) AS n, count(DISTINCT (doc_id, line)) AS lines FROM (SELECT doc_id, line, unnest(regexp_extract_all(t, '[A-Za-z_@$\\x{80}-\\x{10FFFF}][A-Za-z0-9_@$\\x{80}-\\x{10FFFF}]*')) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents)) GROUP BY w")
def identifier_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each identifier's occurrences, and the lines that have it."""
    return sources.identifier_lines(table(spark, sf_dir, "documents"), F.col("text"), "doc_id")


@query("SELECT lower(t) AS tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS t FROM pages) GROUP BY 1")
def markup_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.tags(table(spark, sf_dir, "pages"), F.col("html"), "page_id").groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


@query(f"SELECT doc_id, CAST(line AS BIGINT) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents) WHERE regexp_matches(t, '(^|[^A-Za-z0-9_@$\\x{{80}}-\\x{{10FFFF}}])this([^A-Za-z0-9_@$\\x{{80}}-\\x{{10FFFF}}]|$)')")
def find_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a word: texts are searched before they are split."""
    docs = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("this")) & text.has_word(F.col("text"), "this"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return lines.where(text.has_word(F.col("t"), "this")).select("doc_id", (F.col("line") + 1).cast("long").alias("line"))
