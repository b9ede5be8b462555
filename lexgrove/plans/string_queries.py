"""Queries of the scalar text functions, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fuzzy, text
from ..operators import lookup, match, spelling
from .shared import query, table
from .text_queries import LOW, ngram_sql, plain_rank

UP = "translate({}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


@query("""SELECT p_partkey, left(p_name, 3) AS first, right(p_name, 3) AS last, substr(p_name, 3, 4) AS middle, CAST(instr(p_name, 'e') - 1 AS BIGINT) AS found,
CAST(CASE WHEN instr(p_name, 'e') = 0 THEN -1 ELSE length(p_name) - instr(reverse(p_name), 'e') END AS BIGINT) AS last_found, CAST(CASE WHEN regexp_matches(p_name, '[aiou]') THEN length(regexp_extract(p_name, '^[^aiou]*')) ELSE -1 END AS BIGINT) AS any_found FROM part""")
def parts_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("p_name")
    places = {"found": text.find(c, "e"), "last_found": text.reverse_find(c, "e"), "any_found": text.find_one_of(c, "aiou")}
    return table(spark, sf_dir, "part").select("p_partkey", F.left(c, F.lit(3)).alias("first"), F.right(c, F.lit(3)).alias("last"), F.substring(c, 3, 4).alias("middle"), *(v.cast("long").alias(k) for k, v in places.items()))


@query(f"""SELECT page_id, {UP.format('url')} AS up, {LOW.format('url')} AS low, reverse(url) AS backwards, trim(' ' || url || ' ') AS trimmed, ltrim('  ' || url || ' ') AS left_trimmed, rtrim(' ' || url || '  ') AS right_trimmed,
regexp_replace(regexp_replace('(' || url || '/)', '^[^A-Za-z0-9_@$\\x{{80}}-\\x{{10FFFF}}]+', ''), '[^A-Za-z0-9_@$\\x{{80}}-\\x{{10FFFF}}]+$', '') AS word FROM pages""")
def case_and_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, space = F.col("url"), lambda n: F.lit(" " * n)
    return table(spark, sf_dir, "pages").select(
        "page_id", text.ascii_upper(c).alias("up"), text.ascii_lower(c).alias("low"), F.reverse(c).alias("backwards"), F.trim(F.concat(space(1), c, space(1))).alias("trimmed"),
        F.ltrim(F.concat(space(2), c, space(1))).alias("left_trimmed"), F.rtrim(F.concat(space(1), c, space(2))).alias("right_trimmed"), text.trim_word(F.concat(F.lit("("), c, F.lit("/)"))).alias("word"),
    )


@query("""WITH t AS (SELECT page_id, string_split_regex(url, '[/?&=#]') AS f FROM pages) SELECT page_id, coalesce(f[3], '') AS host, coalesce(f[6], '') AS sixth, CAST(len(f) - 1 AS BIGINT) AS marks FROM t""")
def token_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, marks = F.col("url"), "/?&=#"
    return table(spark, sf_dir, "pages").select("page_id", text.token_field(c, marks, 2).alias("host"), text.token_field(c, marks, 5).alias("sixth"), text.token_count(c, marks).cast("long").alias("marks"))


@query("""SELECT p_partkey, replace(p_name, 'e', '<e>') AS plain, array_to_string(list_transform(string_split(p_name, ' '), lambda x: CASE WHEN x = 'red' THEN '$1 blue' ELSE x END), ' ') AS word,
regexp_replace(p_type, 'pr?o', '*', 'gi') AS without_case, regexp_replace(p_name, '([aeiou])([a-z])', '\\2\\1', 'g') AS pattern FROM part""")
def replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("p_name")
    kind = text.replace_without_case(text.replace_without_case(F.col("p_type"), "pro", "*"), "po", "*")
    return table(spark, sf_dir, "part").select("p_partkey", F.replace(c, F.lit("e"), F.lit("<e>")).alias("plain"), text.replace_word(c, "red", "$1 blue").alias("word"), kind.alias("without_case"), F.regexp_replace(c, "([aeiou])([a-z])", "$2$1").alias("pattern"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]{3,}') THEN CAST(length(regexp_extract(text, '^((?s).*?)[0-9]{3,}', 1)) AS BIGINT) ELSE -1 END AS at, regexp_extract(text, '[0-9]{3,}') AS found FROM documents WHERE text IS NOT NULL")
def pattern_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, digits = F.col("text"), "[0-9]{3,}"
    # places are in characters, as those of Spark's length are
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", (F.regexp_instr(c, F.lit(digits)) - 1).cast("long").alias("at"), F.regexp_extract(c, digits, 0).alias("found"))


@query(f"""SELECT p_partkey, contains(p_name, 'bolt') AS has, contains({LOW.format('p_type')}, 'mo') AS has_without_case, starts_with(p_name, 're') AS starts, suffix(p_name, 'ng') AS ends, starts_with({LOW.format('p_brand')}, 'brand#1') AS starts_without_case, suffix({LOW.format('p_type')}, 'o') AS ends_without_case FROM part""")
def contains_starts_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, low = F.col, lambda x: text.ascii_lower(F.col(x))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.contains("p_name", F.lit("bolt")).alias("has"), F.contains(low("p_type"), F.lit("mo")).alias("has_without_case"), c("p_name").startswith("re").alias("starts"), c("p_name").endswith("ng").alias("ends"),
        low("p_brand").startswith("brand#1").alias("starts_without_case"), low("p_type").endswith("o").alias("ends_without_case"),
    )


@query(f"""SELECT p_partkey, CAST(CASE WHEN p_name < 'green bolt' THEN -1 WHEN p_name > 'green bolt' THEN 1 ELSE 0 END AS BIGINT) AS by_code, CAST(CASE WHEN {LOW.format('p_type')} < 'promo' THEN -1 WHEN {LOW.format('p_type')} > 'promo' THEN 1 ELSE 0 END AS BIGINT) AS without_case FROM part""")
def comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.compare(F.col("p_name"), F.lit("green bolt")).cast("long").alias("by_code"), text.compare(F.col("p_type"), F.lit("pRoMo"), case_sensitive=False).cast("long").alias("without_case"))


@query("""WITH s AS (SELECT page_id AS id, unnest([url, upper(url), 'http', '', 'É', 'aÉB', 'Ab']) AS t, unnest(range(7)) AS k FROM pages) SELECT id, k, t <> '' AND NOT regexp_matches(t, '[A-Z\\x{80}-\\x{10FFFF}]') AS is_lower, t <> '' AND NOT regexp_matches(t, '[a-z\\x{80}-\\x{10FFFF}]') AS is_upper,
regexp_matches(t, '^[\\x00-\\x40\\x5B-\\x7F]*[A-Z]') AS has_upper, regexp_matches(t, '[A-Z]') AND regexp_matches(t, '[a-z]') AS mixed FROM s""")
def case_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(F.col("url"), F.upper("url"), *map(F.lit, ["http", "", "É", "aÉB", "Ab"]))
    t = F.col("t")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.posexplode(texts).alias("k", "t")).select("id", F.col("k").cast("long").alias("k"), text.is_lower(t).alias("is_lower"), text.is_upper(t).alias("is_upper"), text.has_upper(t).alias("has_upper"), text.has_mixed_case(t).alias("mixed"))


@query("""SELECT page_id, regexp_extract(url, '[^/]*$') AS base, regexp_extract(url, '^(.*/)?') AS directory, regexp_extract(regexp_extract(url, '[^/]*$'), '\\.[^.]*$') AS extension, regexp_matches(url, '^[a-z]+://') OR starts_with(url, '/') AS absolute,
CASE WHEN starts_with(url, 'https://') THEN substr(url, 8) ELSE url END AS relative FROM pages""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.base_name(c).alias("base"), text.directory(c).alias("directory"), text.extension(c).alias("extension"), text.is_absolute(c).alias("absolute"), text.relative_path(c, "https:/").alias("relative"))


@query("""SELECT p_partkey, CASE WHEN p_type = 'PROMO' AND p_brand = 'Brand#2' THEN ':' || p_name WHEN p_type = 'PROMO' THEN ':' || p_brand || ':' || p_name ELSE ':' || p_type || ':' || p_brand || ':' || p_name END AS short,
CASE WHEN p_type = 'PROMO' AND p_brand = 'Brand#2' OR p_type = 'SMALL' AND p_brand = 'Brand#3' THEN ':' || p_name WHEN p_type IN ('PROMO', 'SMALL') THEN ':' || p_brand || ':' || p_name ELSE ':' || p_type || ':' || p_brand || ':' || p_name END AS shortest FROM part""")
def minimum_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(":", F.lit(""), "p_type", "p_brand", "p_name")
    scopes = F.split(F.lit(":PROMO:Brand#2\f:SMALL:Brand#3:x\f:\f"), "\f")
    return table(spark, sf_dir, "part").select("p_partkey", text.minimum_name(name, F.lit(":PROMO:Brand#2")).alias("short"), text.shortest_name(name, scopes).alias("shortest"))


SCOPE_MARKS, SCOPE_CODES = "'<> .' || chr(9) || chr(13) || chr(10) || '-=,&*^\"''()!'", " || ".join(f"chr({14 + i})" for i in range(18))


@query(f"SELECT doc_id, translate(text, {SCOPE_MARKS}, {SCOPE_CODES}) AS coded, translate(text, {SCOPE_CODES}, {SCOPE_MARKS}) AS back FROM documents WHERE text IS NOT NULL")
def scope_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts come back as they were, but for codes that they had themselves: those come back as what they stand for."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    coded = text.encode_scope(F.col("text"))
    return docs.select("doc_id", coded.alias("coded"), text.decode_scope(coded).alias("back"))


@query("SELECT doc_id, regexp_replace(translate(text, ',.;', '   '), ' +', ' ', 'g') AS text FROM documents WHERE text IS NOT NULL")
def squeezed_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Punctuation as spaces, and spaces that follow each other as one."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.squeeze_spaces(F.translate("text", ",.;", "   ")).alias("text"))


@query("SELECT doc_id, true AS valid, strlen(text) <= 100 OR substr(hex(encode(text)), 201, 1) NOT IN ('8', '9', 'A', 'B') AS cut_valid, CAST(length(text) AS BIGINT) AS n, CAST(strlen(text) AS BIGINT) AS bytes, CAST(strlen(left(text, 100)) AS BIGINT) AS at FROM documents WHERE text IS NOT NULL")
def utf8_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths in characters and bytes, and whether the text and its first 100 bytes, which may end within a character, are valid."""
    c = F.col("text")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.is_valid_utf8(c).alias("valid"), F.is_valid_utf8(F.substring(F.encode(c, "UTF-8"), 1, 100).cast("string")).alias("cut_valid"), F.char_length(c).cast("long").alias("n"), F.octet_length(c).cast("long").alias("bytes"), text.byte_offset(c, 100).cast("long").alias("at"))


@query("SELECT doc_id, url_encode(text) AS encoded FROM documents WHERE text IS NOT NULL")
def url_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.url_query(F.col("text")).alias("encoded"))


@query("""SELECT event_id, 'By ' || strftime(ts, '%A') || ', ' || CAST(day(ts) AS VARCHAR) || ' ' || strftime(ts, '%B %Y') || ' (' || strftime(ts, '%a %d %b %m') || ') at ' || strftime(ts, '%H:%M:%S') AS text FROM events""")
def snippet_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = F.lit("By $DAYLONGNAME_EN$, $DAY$ $MONTHLONGNAME_EN$ $YEAR$ ($DAYNAME_EN$ $DAY_02$ $MONTHNAME_EN$ $MONTH_02$) at $HOUR_02$:$MINUTE$:$SECOND$")
    return table(spark, sf_dir, "events").select("event_id", text.expand_snippet(template, F.col("ts")).alias("text"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN true ELSE strftime(o_orderdate, '%Y.%m.%d') < '1995.06.17' END AS passed FROM orders")
def passed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.when(F.col("o_orderkey") % 7 == 0, F.date_format("o_orderdate", "yy.MM.dd")).otherwise(F.date_format("o_orderdate", "yyyy.MM.dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.date_passed(date, F.lit("1995-06-17").cast("timestamp")).alias("passed"))


@query("SELECT l_orderkey, l_linenumber, (CAST(l_quantity AS BIGINT) & 4) <> 0 AS four, (CAST(l_quantity AS BIGINT) & 16) <> 0 AS sixteen FROM lineitem")
def flag_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", lookup.flag(bits, 4).alias("four"), lookup.flag(bits, 16).alias("sixteen"))


@query("SELECT p_partkey FROM part WHERE p_type IN ('PROMO', 'ECONOMY')")
def object_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds that are objects; two kinds of parts stand for a class and an enumeration."""
    kind = F.when(F.col("p_type") == "PROMO", "CLASS").when(F.col("p_type") == "ECONOMY", "ENUM").otherwise("FUNC")
    return table(spark, sf_dir, "part").where(lookup.is_object(kind)).select("p_partkey")


CAMEL = "(upper(left(p_name, 1)) || regexp_extract(p_name, '^[^ ]', 0)[2:] || substr(regexp_extract(p_name, '^[^ ]*'), 2) || upper(left(regexp_extract(p_name, '[^ ]*$'), 1)) || substr(regexp_extract(p_name, '[^ ]*$'), 2))"


@query(f"SELECT p_partkey, CASE WHEN {plain_rank(CAMEL, 'rg')} > 0 THEN {plain_rank(CAMEL, 'rg')} WHEN contains(regexp_replace({CAMEL}, '[^A-Z]', '', 'g'), 'RG') THEN 1 ELSE 0 END AS rank FROM part")
def acronym_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in camel case by their capitals."""
    camel = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", match.acronym_rank(camel, match.compile_term("rg")).alias("rank"))


@query("SELECT DISTINCT p_name, levenshtein(p_name, 'read wdget') AS edits FROM part")
def grapheme_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits between characters as they are seen; the same as plain ones for ASCII text, and marks don't add to them."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return names.select("p_name", fuzzy.grapheme_distance_of(F.translate("p_name", "e", "ê"), F.lit("réad wdget"), marks=False).alias("edits"))


MISSPELT = "SELECT DISTINCT substr(w, 1, 1) || substr(w, 3, 1) || substr(w, 2, 1) || substr(w, 4) AS word FROM d WHERE length(w) > 3 UNION SELECT DISTINCT substr(w, 1, 2) || substr(w, 4) FROM d UNION SELECT DISTINCT w || 'x' FROM d UNION SELECT DISTINCT 'x' || substr(w, 2) FROM d"


@query(f"""WITH d AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), m AS ({MISSPELT}) SELECT word, w AS candidate, CASE WHEN damerau_levenshtein(word, w) = 1 AND levenshtein(word, w) > 1 THEN 'swap' WHEN length(word) < length(w) THEN 'missing' WHEN length(word) > length(w) THEN 'extra' ELSE 'wrong' END AS edit
FROM m, d WHERE damerau_levenshtein(word, w) = 1 AND word NOT IN (SELECT w FROM d)""")
def corrected_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt words of names, and the words that are one edit away."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    w, cut = F.col("word"), lambda a, n=1 << 30: F.substring("word", a, n)
    wrong = F.array(F.when(F.length(w) > 3, F.concat(cut(1, 1), cut(3, 1), cut(2, 1), cut(4))), F.concat(cut(1, 2), cut(4)), F.concat(w, F.lit("x")), F.concat(F.lit("x"), cut(2)))
    return spelling.candidates(words.select(F.explode(wrong).alias("word")).where("word is not null"), words)


@query("WITH d AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), j AS (SELECT DISTINCT replace(p_name, ' ', '') AS word FROM part) SELECT word, a.w || ' ' || b.w AS candidate FROM j, d a, d b WHERE word = a.w || b.w")
def words_run_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return spelling.two_words(parts.select(F.replace("p_name", F.lit(" "), F.lit("")).alias("word")), parts.select(F.explode(F.split("p_name", " ")).alias("word")))


POOR = "SELECT DISTINCT substr(w, 3, 2) || 'z' || substr(w, 1, 2) || 'q' AS word FROM d UNION SELECT DISTINCT substr(w, 1, 3) || 'zz' || substr(w, 4) FROM d UNION SELECT DISTINCT reverse(w) FROM d UNION SELECT DISTINCT substr(w, 1, 2) FROM d"
LOST = ["list_aggregate(list_transform(range(0, length(word)), lambda i: CASE WHEN i >= {0} AND (i - {0}) % 4 = 0 THEN '*' ELSE substr(word, i + 1, 1) END), 'string_agg', '')".format(k) for k in (1, 2, 3)]


@query(f"""WITH d AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), m AS (SELECT * FROM ({POOR}) WHERE word NOT IN (SELECT w FROM d)),
r AS (SELECT word, w, {ngram_sql("word", "w", "3", "length(w) - length(word)")} AS s FROM m, d), t AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY s DESC, w) AS k FROM r),
l AS (SELECT word, {LOST[0]} AS l1, {LOST[1]} AS l2, {LOST[2]} AS l3 FROM m), h AS (SELECT word, ({" + ".join(ngram_sql("word", f"l{k}", "length(word)", "0") for k in (1, 2, 3))}) // 3 - 1 AS least FROM l),
g AS (SELECT word, w AS candidate, {ngram_sql("word", "w", "length(word)", "abs(length(w) - length(word))")} AS score FROM t WHERE k <= 10), o AS (SELECT g.*, row_number() OVER (PARTITION BY word ORDER BY score DESC, candidate) AS k FROM g JOIN h USING (word) WHERE score > least)
SELECT word, candidate, CAST(score AS BIGINT) AS score FROM o WHERE k <= 10""")
def resembling_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words spelt very poorly, and what resembles them most by their n-grams."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    cut = lambda a, n=1 << 30: F.substring("word", a, n)
    poor = F.array(F.concat(cut(3, 2), F.lit("z"), cut(1, 2), F.lit("q")), F.concat(cut(1, 3), F.lit("zz"), cut(4)), F.reverse("word"), cut(1, 2))
    found = spelling.resembling(words.select(F.explode(poor).alias("word")), words)
    return found.withColumn("score", F.col("score").cast("long"))


@query("""WITH d AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), m AS (SELECT DISTINCT translate(w, 'eai', 'éàa') AS word FROM d WHERE translate(w, 'eai', 'éàa') <> w)
SELECT word, w AS candidate FROM m, d WHERE word NOT IN (SELECT w FROM d) AND length(word) > 1 AND translate(word, 'éèàâio', 'eeaaaa') = translate(w, 'éèàâio', 'eeaaaa')""")
def related_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with characters that are related to the right ones."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    wrong = F.translate("word", "eai", "éàa")
    return spelling.related(words.where(wrong != F.col("word")).select(wrong.alias("word")), words, ["eéè", "aàâ", "oi", "ia"])


@query("""WITH d AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), m AS (SELECT DISTINCT replace(replace(w, 'e', 'ee'), 't', 'ph') AS word FROM d), t(p, r) AS (VALUES ('ee', 'e'), ('ph', 't'), ('e', 'ee')),
v AS (SELECT word, p, r, unnest(range(1, length(word) + 1)) AS i FROM m, t) SELECT DISTINCT word, substr(word, 1, i - 1) || r || substr(word, i + length(p)) AS candidate FROM v WHERE substr(word, i, length(p)) = p AND word NOT IN (SELECT w FROM d) AND length(word) > 1 AND substr(word, 1, i - 1) || r || substr(word, i + length(p)) IN (SELECT w FROM d)""")
def replaced_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in which a pattern of a table stands for another."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    wrong = F.replace(F.replace("word", F.lit("e"), F.lit("ee")), F.lit("t"), F.lit("ph"))
    return spelling.replaced(words.select(wrong.alias("word")), words, [("ee", "e"), ("ph", "t"), ("e", "ee")])


@query("SELECT p_name, sha1(p_name) AS sha1, md5(p_name) AS md5, sha256(p_name) AS sha256 FROM (SELECT DISTINCT p_name FROM part)")
def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_name").distinct().select("p_name", F.sha1("p_name").alias("sha1"), F.md5("p_name").alias("md5"), F.sha2("p_name", 256).alias("sha256"))


#: Comments, and literals with their first quote as a group.
STRIPPED = r"""//[^\n]*|/\*.*?(?:\*/|\z)|(")(?:\\.|[^"\\\n])*"?|('')(?:\\.|[^''\\\n])*''?"""


@query(f"""SELECT doc_id, sha256(regexp_replace('s = "a // b"; /* ' || text || ' */ t = ''x''; // ' || replace(text, chr(10), ' ') || chr(10) || text, '{STRIPPED}', '\\1\\1\\2\\2', 'gs')) AS sha256 FROM documents WHERE text IS NOT NULL""")
def stripped_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source text without comments and the contents of literals."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    code = F.concat(F.lit('s = "a // b"; /* '), F.col("text"), F.lit(" */ t = 'x'; // "), F.regexp_replace("text", "\n", " "), F.lit("\n"), F.col("text"))
    return docs.select("doc_id", F.sha2(fuzzy.strip_code_of(code), 256).alias("sha256"))


@query()
def new_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new id for each row; they are random, so they have no SQL."""
    return table(spark, sf_dir, "nation").select("n_nationkey", F.uuid().alias("id"))
