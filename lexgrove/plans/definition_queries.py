"""Queries of what the last kept row or a call's types decide: de-duplicated symbol lists and overloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adjacent, refine
from ..operators.overloads import Call
from .shared import query, table


def neighbours_sql(rows: str) -> str:
    """SQL of the numbers that stay of symbols (name, path, file_id, line, kind, solution, body, seq), folded row by row."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY lower(path), file_id, line, kind, solution, body, seq) AS k FROM ({rows})),
f AS (SELECT name, k, [seq] AS kept, kind, solution, body, file_id, line FROM o WHERE k = 1 UNION ALL
SELECT name, k, CASE a WHEN 'append' THEN list_append(kept, seq) WHEN 'replace' THEN list_append(kept[:-2], seq) ELSE kept END, CASE a WHEN 'drop' THEN kind ELSE o_kind END, CASE a WHEN 'drop' THEN solution ELSE o_solution END, CASE a WHEN 'drop' THEN body ELSE o_body END, CASE a WHEN 'drop' THEN file_id ELSE o_file END, CASE a WHEN 'drop' THEN line ELSE o_line END
FROM (SELECT f.name, o.k, f.kept, o.seq, f.kind, f.solution, f.body, f.file_id, f.line, o.kind AS o_kind, o.solution AS o_solution, o.body AS o_body, o.file_id AS o_file, o.line AS o_line,
CASE WHEN f.kind = 'LINQ_VAR' OR o.kind = 'LINQ_VAR' OR NOT (f.solution OR o.solution) THEN 'drop' WHEN o.kind = 'GOTODEF' AND f.kind <> 'GOTODEF' THEN 'replace' WHEN f.kind = 'GOTODEF' AND o.kind <> 'GOTODEF' OR f.file_id = o.file_id AND f.line = o.line THEN 'drop'
WHEN f.kind <> o.kind OR o.kind IN ('GOTODEF', 'CLASS', 'STRUCT', 'C_INTERFACE') THEN 'append' WHEN o.kind <> 'FUNC' THEN 'drop' WHEN f.body = o.body THEN 'append' WHEN o.body THEN 'replace' ELSE 'drop' END AS a FROM f JOIN o ON o.name = f.name AND o.k = f.k + 1)),
kept AS (SELECT unnest(kept) AS seq FROM (SELECT name, arg_max(kept, k) AS kept FROM f GROUP BY name))"""


LISTED = """SELECT p_name AS name, 'C:/f' || CAST(p_partkey % 97 AS VARCHAR) || '.h' AS path, p_partkey % 97 AS file_id, p_size AS line, CASE p_type WHEN 'PROMO' THEN CASE WHEN p_size < 12 THEN 'GOTODEF' ELSE 'VAR' END WHEN 'SMALL' THEN 'FUNC' WHEN 'LARGE' THEN 'FUNC' WHEN 'ECONOMY' THEN 'CLASS' WHEN 'MEDIUM' THEN 'TYPE' ELSE CASE WHEN p_size = 7 THEN 'LINQ_VAR' ELSE 'STRUCT' END END AS kind, p_size > 25 AS solution, p_size % 2 = 0 AS body, p_partkey AS seq FROM part"""


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    kind = F.when(c("p_type") == "PROMO", F.when(c("p_size") < 12, "GOTODEF").otherwise("VAR")).when(c("p_type").isin("SMALL", "LARGE"), "FUNC").when(c("p_type") == "ECONOMY", "CLASS").when(c("p_type") == "MEDIUM", "TYPE").otherwise(F.when(c("p_size") == 7, "LINQ_VAR").otherwise("STRUCT"))
    file_id = c("p_partkey") % 97
    return table(spark, sf_dir, "part").select(c("p_name").alias("sym_scope"), F.concat(F.lit("C:/f"), file_id.cast("string"), F.lit(".h")).alias("path"), file_id.alias("file_id"), c("p_size").alias("line"), kind.alias("sym_type"), (c("p_size") > 25).alias("in_solution"), (c("p_size") % 2 == 0).alias("has_body"), c("p_partkey").alias("seq"))


@query(f"WITH RECURSIVE {neighbours_sql(LISTED)} SELECT seq FROM kept")
def deduplicated_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sorted list of symbols, each held against the one kept before it."""
    return adjacent.without_neighbours(listed(spark, sf_dir)).select("seq")


#: Parameters of overloads by number, the last of them variadic; how many have defaults; and how welcome the call below finds them.
OVERLOADS = [(["short", "int"], 0, False, 0), (["double", "void *"], 0, False, 1), (["const short &", "char*"], 0, False, 2), (["std::string", "int"], 0, False, 9), (["short", "..."], 0, True, 0), (["Wide", "int"], 0, False, 0), (["short", "int", "long"], 1, False, 0), (["short"], 0, False, 9)]


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, no = F.col, F.lit(False)
    which = F.get(F.array(*(F.struct(F.array(*map(F.lit, p)).alias("params"), F.lit(d).alias("n_default"), F.lit(v).alias("variadic")) for p, d, v, _ in OVERLOADS)), (c("p_size") % 8).cast("int"))
    flags = {x: no for x in ("hidden", "is_hashtag", "is_reference", "preferred", "is_system", "is_external", "is_namespace", "has_body", "is_implementation")}
    rows = table(spark, sf_dir, "part").withColumn("_o", which).withColumns({"params": c("_o.params"), "n_default": c("_o.n_default"), "variadic": c("_o.variadic"), "is_const": c("p_partkey") % 3 == 0})
    return rows.withColumns(flags | {"name": c("p_name"), "path": c("p_brand"), "in_project": no, "projects": F.array("p_brand"), "file_id": c("p_partkey") % 97, "line": c("p_size"), "seq": c("p_partkey")})


WELCOME = " ".join(f"WHEN {i} THEN {w}" for i, (_, _, _, w) in enumerate(OVERLOADS))


@query(f"""WITH w AS (SELECT p_partkey, p_size % 8 = 4 AS rest, greatest(CASE p_size % 8 {WELCOME} END, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) AS w FROM part),
m AS (SELECT *, bool_or(w = 1) OVER () AS one, bool_or(w = 2) OVER () AS two, bool_or(w = 0) OVER () AS nil FROM w WHERE w < 9), k AS (SELECT * FROM m WHERE CASE WHEN one AND two THEN w <> 2 WHEN nil THEN w = 0 ELSE true END)
SELECT p_partkey, CASE WHEN EXISTS (SELECT 1 FROM k AS x WHERE x.p_partkey = part.p_partkey AND (NOT x.rest OR NOT EXISTS (SELECT 1 FROM k WHERE NOT rest))) THEN 0 ELSE 1 END AS part FROM part""")
def overloads_by_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overloads that fit a call by its arguments' types, then (after a separator) the others."""
    conversions = spark.createDataFrame([("short", "Wide"), ("Wide", "std::string")], "from string, to string")
    found = refine.definition_pipeline(candidates(spark, sf_dir), call=Call(("short", "0")), conversions=conversions, separate=True, exactly=None)
    return found.select("p_partkey", "part")


@query("SELECT p_partkey FROM part WHERE p_size % 8 = 7 AND p_partkey % 3 = 0")
def overloads_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the number of arguments leaves one signature, types aren't asked."""
    rows = candidates(spark, sf_dir).where("is_const or p_size % 8 <> 7")
    return refine.definition_pipeline(rows, call=Call(("Other",)), exactly=None).select("p_partkey")
