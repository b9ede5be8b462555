"""Queries of the text filters, ranks, fuzzy matches and scalar functions, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fuzzy, text
from ..operators import match, sorting
from .shared import query, table

#: A character that is no part of an identifier, for RE2.
EDGE = r"[^A-Za-z0-9_@$\x{80}-\x{10FFFF}]"
LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def plain_rank(column: str, want: str) -> str:
    """SQL of a plain term's rank; the text has no field delimiters."""
    low = LOW.format(column)
    return f"(CASE WHEN instr({low}, '{want}') = 0 THEN 0 WHEN instr({low}, '{want}') = 1 THEN 4 WHEN regexp_matches(substr({column}, instr({low}, '{want}') - 1, 1), '{EDGE}') THEN 2 ELSE 1 END)"


@query(f"SELECT p_partkey, p_name, {plain_rank('p_name', 'red')} AS rank FROM part WHERE {plain_rank('p_name', 'red')} > 0 AND instr({LOW.format('p_name')}, 'gear') = 0")
def find_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with `red` and without `gear`, ranked."""
    return match.filter_set(table(spark, sf_dir, "part"), F.col("p_name"), "red -gear").select("p_partkey", "p_name", "rank")


@query(f"SELECT p_partkey, least({plain_rank('p_name', 'e')}, {plain_rank('p_name', 'o')}) AS rank FROM part WHERE {plain_rank('p_name', 'e')} > 0 AND {plain_rank('p_name', 'o')} > 0")
def rank_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", match.rank_all(F.col("p_name"), "e o").alias("rank")).where("rank > 0")


@query(f"SELECT p_partkey, CAST(CASE WHEN {plain_rank('p_name', 'bolt')} > 0 THEN {plain_rank('p_name', 'bolt')} ELSE {plain_rank('p_name', 'r')} END AS INTEGER) AS rank FROM part WHERE {plain_rank('p_name', 'bolt')} > 0 OR {plain_rank('p_name', 'r')} > 0")
def rank_first_alternative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", match.rank_any(F.col("p_name"), "bolt,r").alias("rank")).where("rank > 0")


@query(f"SELECT p_partkey, CASE WHEN starts_with({LOW.format('p_name')}, 'b') THEN 4 ELSE 2 END AS rank FROM part WHERE regexp_matches({LOW.format('p_name')}, '(^|{EDGE})b')")
def rank_start_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", match.rank(F.col("p_name"), match.compile_term(".b")).alias("rank")).where("rank > 0")


@query(f"""WITH m AS (SELECT p_partkey, {LOW.format('p_name')} AS t, regexp_extract({LOW.format('p_name')}, '^(.*?)t({EDGE}|$)', 1) AS pre, regexp_matches({LOW.format('p_name')}, 't({EDGE}|$)') AS hit FROM part)
SELECT p_partkey, CASE WHEN pre = '' THEN 5 WHEN regexp_matches(right(pre, 1), '{EDGE}') THEN 4 ELSE 3 END AS rank FROM m WHERE hit""")
def rank_end_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", match.rank(F.col("p_name"), match.compile_term("t.")).alias("rank")).where("rank > 0")


@query(f"SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^red({EDGE}|$)') THEN 5 ELSE 4 END AS rank FROM part WHERE regexp_matches(p_name, '(^|{EDGE})red({EDGE}|$)')")
def rank_whole_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", match.rank(F.col("p_name"), match.compile_term(".red.")).alias("rank")).where("rank > 0")


@query("SELECT p_partkey, p_brand FROM part WHERE instr(p_brand, 'B') > 0 AND instr(p_brand, '#1') > 0")
def smart_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capital makes a term case-sensitive."""
    return match.filter_set(table(spark, sf_dir, "part"), F.col("p_brand"), "B #1").select("p_partkey", "p_brand")


@query(f"SELECT p_partkey, {plain_rank('p_name', 'ring')} AS rank FROM part WHERE {plain_rank('p_name', 'ring')} > 0 ORDER BY rank DESC, p_partkey LIMIT 1")
def suggested_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = match.filter_set(table(spark, sf_dir, "part"), F.col("p_name"), "ring")
    return match.suggested(ranked, "p_partkey").select("p_partkey", "rank")


@query(f"SELECT page_id, url FROM pages WHERE (instr({LOW.format('url')}, '/en/') > 0) OR (instr({LOW.format('url')}, '.org/') > 0)")
def filter_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.filter_files(table(spark, sf_dir, "pages"), F.col("url"), "/en/,.org/").select("page_id", "url")


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|{EDGE})the({EDGE}|$)')")
def whole_word_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(text.has_word(F.col("text"), "the")).select("doc_id")


CAMEL = "(upper(left(p_name, 1)) || substr(split_part(p_name, ' ', 1), 2) || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2))"
TYPED = ("RedRing", "redring", "Re", "re", "rR", "in")


@query(f"""WITH n AS (SELECT p_partkey, {CAMEL} AS name FROM part), t AS (SELECT unnest({list(TYPED)}) AS typed), x AS (SELECT *, {LOW.format('name')} AS low, lower(typed) AS want, regexp_replace(name, '[^A-Z]', '', 'g') AS letters FROM n, t)
SELECT p_partkey, typed, CAST(CASE WHEN name = typed THEN 1 WHEN low = want THEN 3 WHEN starts_with(name, typed) THEN 5 WHEN starts_with(low, want) THEN 7 WHEN starts_with(letters, upper(typed)) AND length(letters) >= 2 THEN 8 WHEN contains(low, want) THEN 9 END AS BIGINT) AS class
FROM x WHERE class IS NOT NULL""")
def completion_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each class from exact to anywhere, for names in camel case."""
    c = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    parts = table(spark, sf_dir, "part")
    classes = F.map_from_arrays(F.array(*map(F.lit, TYPED)), F.array(*(match.completion_class(c, t).cast("long") for t in TYPED)))
    return parts.select("p_partkey", F.explode(classes).alias("typed", "class")).where("class is not null")


@query(f"""WITH RECURSIVE n AS (SELECT p_partkey, {CAMEL} AS name FROM part), w AS (SELECT DISTINCT name, 0 AS k, 0 AS place, 0 AS skips, 0 AS met, 0 AS passed FROM n WHERE lower(left(name, 1)) = 'r' UNION ALL
SELECT name, k + 1, place + p, skips + CASE WHEN p > 1 THEN 1 ELSE 0 END, met + CASE WHEN regexp_matches(substr(name, place + p, 1), '[A-Z]') THEN 1 ELSE 0 END, passed + length(regexp_replace(substr(name, place + 1, p - 1), '[^A-Z]', '', 'g')) FROM (SELECT *, instr(lower(substr(name, place + 1)), substr('rdg', k + 1, 1)) AS p FROM w WHERE k < 3) WHERE p > 0),
x AS (SELECT n.*, {LOW.format('n.name')} AS low, regexp_replace(n.name, '[^A-Z]', '', 'g') AS letters, 30 + skips - met + 2 * passed AS weak FROM n LEFT JOIN w ON w.name = n.name AND k = 3)
SELECT p_partkey, name, CAST(CASE WHEN low = 'rdg' THEN 3 WHEN starts_with(low, 'rdg') THEN 7 WHEN starts_with(letters, 'RDG') AND length(letters) >= 2 THEN 8 WHEN contains(low, 'rdg') THEN 9 ELSE weak END AS BIGINT) AS class FROM x WHERE class IS NOT NULL""")
def weak_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was typed stands in a name letter by letter."""
    names = table(spark, sf_dir, "part").withColumn("name", F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")))
    return match.completions(names, "name", "rdg").select("p_partkey", "name", F.col("class").cast("long").alias("class"))


def ngram_sql(a: str, b: str, most: str, apart: str) -> str:
    """SQL of the score of a's n-grams in b: each length's hits count while the length before had two."""
    hits = f"list_transform(range(1, least({most}, length({a})) + 1), lambda n: len(list_filter(range(1, length({a}) - n + 2), lambda i: contains({b}, substr({a}, i, n)))))"
    return f"(list_sum(list_transform(range(1, len({hits}) + 1), lambda k: CASE WHEN list_min(list_concat([2], {hits}[1:k - 1])) < 2 THEN 0 ELSE {hits}[k] END)) - greatest(0, {apart} - 2))"


def similarity_sql(term: str) -> str:
    """SQL of the names of parts with their best partial ratio to a term and their edits without replacing: common subsequences of the
    term and each stretch, a row of the table for each character."""
    row = "list_prepend(0, list_transform(range(1, length(x) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(l[k + 1], CASE WHEN substr(x, k, 1) = substr(y, i + 1, 1) THEN l[k] + 1 ELSE 0 END)))))"
    return f"""n AS (SELECT DISTINCT p_name, CASE WHEN length(p_name) <= length('{term}') THEN p_name ELSE '{term}' END AS x, CASE WHEN length(p_name) <= length('{term}') THEN '{term}' ELSE p_name END AS whole FROM part),
s AS (SELECT p_name, x, substr(whole, greatest(b, 0) + 1, b + length(x) - greatest(b, 0)) AS y, false AS total FROM (SELECT *, unnest(range(1 - length(x), length(whole))) AS b FROM n) UNION ALL SELECT p_name, x, whole, true FROM n),
l AS (SELECT p_name, x, y, total, 0 AS i, list_transform(range(length(x) + 1), lambda j: 0::BIGINT) AS l FROM s UNION ALL SELECT p_name, x, y, total, i + 1, {row} FROM l WHERE i < length(y)),
q AS (SELECT p_name, max(200.0::DOUBLE * l[-1] / (length(x) + length(y))) FILTER (NOT total) AS ratio, max(length(x) + length(y) - 2 * l[-1]) FILTER (total) AS indel FROM l WHERE i = length(y) GROUP BY p_name)"""


@query(f"WITH RECURSIVE {similarity_sql('widgte')} SELECT p_partkey, p_name, CASE WHEN {plain_rank('p_name', 'widgte')} > 0 THEN {plain_rank('p_name', 'widgte')} ELSE 1 END AS rank FROM part JOIN q USING (p_name) WHERE {plain_rank('p_name', 'widgte')} > 0 OR ratio >= 75")
def fuzzy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A misspelt term still finds similar names."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", match.fuzzy_rank(F.col("p_name"), match.compile_term("widgte")).alias("rank")).where("rank > 0")


@query(f"WITH RECURSIVE {similarity_sql('red wdget')} SELECT p_name, ratio, indel, {ngram_sql("'red wdget'", "p_name", "3", "abs(length(p_name) - 9)")} AS ngrams FROM q")
def partial_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return names.select("p_name", fuzzy.partial_ratio_of(F.col("p_name"), F.lit("red wdget")).alias("ratio"), fuzzy.indel_of(F.col("p_name"), F.lit("red wdget")).alias("indel"), fuzzy.ngram_score_of(F.lit("red wdget"), F.col("p_name")).alias("ngrams"))


@query("SELECT p_name, levenshtein(p_name, 'red wdget') AS edits FROM (SELECT DISTINCT p_name FROM part) WHERE levenshtein(p_name, 'red wdget') <= 4")
def spelling_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return names.select("p_name", F.levenshtein("p_name", F.lit("red wdget")).cast("long").alias("edits")).where("edits <= 4")


@query("SELECT p_partkey, upper(substr(p_type, 1, 1)) || regexp_replace(substr(p_type, 2), '[^A-Z]', '', 'g') AS letters FROM part")
def significant_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.initials(F.col("p_type")).alias("letters"))


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) - CASE WHEN suffix(text, chr(10)) OR text = '' THEN 1 ELSE 0 END AS BIGINT) AS pieces FROM documents WHERE text IS NOT NULL")
def split_with_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(text.split_keeping(F.col("text"))).cast("long").alias("pieces"))


@query("SELECT conv_id, turn, array_to_string(list_filter(list_filter(string_split(replace(text, chr(10), chr(10) || chr(1)), chr(1)), lambda x: x <> ''), lambda x: instr(x, ' le ') = 0), '') AS text FROM conversations")
def lines_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.without_lines(F.col("text"), " le ").alias("text"))


@query(f"SELECT {LOW.format("regexp_replace(text, '[\r\n\t ]', '', 'g')")} AS k, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def similar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that differ in white space and case alone."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(text.similarity_key(F.col("text")).alias("k")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT user_id, lower(printf('%x', event_id)) AS hexed, event_id AS back FROM events")
def hex_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    hexed = text.to_hex(F.col("event_id"))
    return table(spark, sf_dir, "events").select("user_id", hexed.alias("hexed"), text.from_hex(hexed).alias("back"))


@query("SELECT c_custkey, regexp_extract(c_name, '[^#]*$') AS symbol, regexp_replace(c_name, '(^|#)[^#]*$', '') AS scope FROM customer")
def symbol_and_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", text.symbol_of(c, "#").alias("symbol"), text.scope_of(c, "#").alias("scope"))


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER), p_partkey) AS place FROM part")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand#2 before Brand#17."""
    return sorting.place(table(spark, sf_dir, "part"), [sorting.natural_order(F.col("p_brand"))], "p_partkey", ["p_type"]).select("p_partkey", F.col("place").cast("long").alias("place"))


@query(f"SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY {LOW.format('p_name')}, p_name, p_partkey) AS place FROM part")
def completion_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.place(table(spark, sf_dir, "part"), sorting.completion_order(F.col("p_name")), "p_partkey", ["p_brand"]).select("p_partkey", F.col("place").cast("long").alias("place"))


@query(f"SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_brand <> 'Brand#2', {LOW.format('p_name')}, p_name, p_partkey) AS place FROM part")
def own_scope_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.place(table(spark, sf_dir, "part"), sorting.own_scope_first(F.col("p_brand"), "Brand#2", F.col("p_name")), "p_partkey", ["p_type"]).select("p_partkey", F.col("place").cast("long").alias("place"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.top(table(spark, sf_dir, "orders"), [F.desc("o_totalprice")], "o_orderkey", 50).select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")
def top_in_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.top_in_groups(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice")], "o_orderkey", 3).select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"))


@query("SELECT doc_id, sha1(array_to_string(list_sort(list_filter(string_split(regexp_replace(text, chr(10), chr(10) || chr(1), 'g'), chr(1)), lambda x: x <> '')), '')) AS h FROM documents WHERE text IS NOT NULL")
def line_sorted_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.line_sorted_hash(F.col("text")).alias("h"))
