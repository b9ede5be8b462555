"""Symbol tables from delimited text, and other text sources. Parsing is by built-in functions, so column pruning and filters
work as for any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, from_hex, scope_of, symbol_of, to_hex

#: Field delimiter of symbol records (a fixed value of the format).
DELIMITER = "\x02"
#: Low bits of a record's first number are the kind, bit 7 and up the table's flags (fixed values).
TYPE_MASK = 0x3F

SYMBOLS = "seq long, sym_scope string, scope string, sym string, def string, sym_type int, attrs long, db_flags long, file_id long, line int"


def parse_records(lines: DataFrame, value: str = "value", *, types_only: tuple[int, ...] = ()) -> DataFrame:
    """Symbols of records `visible, sym_scope, def, type and flags, attrs, file, line` (numbers in hex). Records that are
    hidden, commented, malformed, operators, or whose symbol begins with a digit are left out."""
    f = F.split(F.col(value), DELIMITER)
    get = lambda i: F.get(f, F.lit(i))
    rows = lines.where(F.col(value).startswith("1") & (F.size(f) >= 7)).select(
        get(1).alias("sym_scope"), scope_of(get(1)).alias("scope"), symbol_of(get(1)).alias("sym"), get(2).alias("def"),
        from_hex(get(3)).bitwiseAND(TYPE_MASK).cast("int").alias("sym_type"), from_hex(get(4)).alias("attrs"),
        from_hex(get(3)).bitwiseAND(~TYPE_MASK & 0xFFFFFFFF).alias("db_flags"), from_hex(get(5)).alias("file_id"), from_hex(get(6)).cast("int").alias("line"),
    )
    rows = rows.where((F.col("sym") != "") & ~F.col("sym").rlike("^([0-9]|operator\\b)"))
    return rows.where(F.col("sym_type").isin(*types_only)) if types_only else rows


def read_symbols(spark: SparkSession, path: str, **options) -> DataFrame:
    return parse_records(spark.read.text(path), **options)


def record(sym_scope: Column, definition: Column, kind: Column, attrs: Column, file_id: Column, line: Column) -> Column:
    """A record's text."""
    hexed = lambda c: F.lower(F.hex(c.cast("long")))
    return F.concat_ws(DELIMITER, F.lit("1"), sym_scope, definition, F.lpad(hexed(kind), 8, "0"), hexed(attrs), hexed(file_id), hexed(line))


def write_letter_bins(symbols: DataFrame, path: str) -> None:
    """Parquet partitioned by the upper-case first letter, sorted and without exact duplicates in each file."""
    letter = F.upper(F.substring("sym", 1, 1)).alias("letter")
    symbols.select("sym", "scope", "sym_type", "attrs", letter).distinct().repartition("letter").sortWithinPartitions("letter", F.lower("sym"), "sym", "scope").write.partitionBy("letter").parquet(path)


def read_letter(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Symbols with a prefix (without case): one letter's partition is read."""
    return spark.read.parquet(path).where((F.col("letter") == prefix[:1].upper()) & F.lower("sym").startswith(prefix.lower()))


def read_headers(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """(file, namespace, kind, symbol) of a JSON array of headers, or of headers in lines."""
    raw = spark.read.schema("filename string, namespace string, symbols map<string, array<string>>").json(path, multiLine=not lines)
    return raw.select(F.col("filename").alias("file"), "namespace", F.explode("symbols").alias("kind", "names")).select("file", "namespace", "kind", F.explode("names").alias("symbol"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder (hidden ones are skipped by Spark): path, size, time. Contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def identifiers(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    """(kept columns, line, identifier) of source text, a row for each occurrence; a lexical scan."""
    lines = df.select(*keep, F.posexplode(F.split(text, "\n")).alias("line", "_text"))
    words = F.regexp_extract_all("_text", F.lit(r"([A-Za-z_@$\x{80}-\x{10FFFF}][A-Za-z0-9_@$\x{80}-\x{10FFFF}]*)"), 1)
    return lines.select(*keep, (F.col("line") + 1).alias("line"), F.explode(words).alias("identifier"))


def identifier_lines(df: DataFrame, text: Column, key: str) -> DataFrame:
    """(identifier, n, lines) of source texts: how often each identifier occurs, and in how many lines, a line being that of a key. Lines
    are counted where they are, so what is shuffled are the identifiers of each task. Texts that share a key share their lines;
    the lines of these alone are told apart over all of them."""
    shared = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key).alias("_key"))
    several = None
    if not shared.isEmpty():
        same = F.col(key).eqNullSafe(F.col("_key"))
        several, df = df.join(shared, same, "left_semi"), df.join(shared, same, "left_anti")
    lines = df.select(F.explode(F.split(text, "\n")).alias("_text"))
    words = lines.select(F.regexp_extract_all("_text", F.lit(r"([A-Za-z_@$\x{80}-\x{10FFFF}][A-Za-z0-9_@$\x{80}-\x{10FFFF}]*)"), 1).alias("_words"))
    row = lambda n, line: lambda w: F.struct(w.alias("identifier"), F.lit(n).alias("n"), F.lit(line).alias("lines"))
    counts = words.select(F.inline(F.concat(F.transform("_words", row(1, 0)), F.transform(F.array_distinct("_words"), row(0, 1)))))
    counts = counts.groupBy("identifier").agg(F.sum("n").alias("n"), F.sum("lines").alias("lines"))
    if several is not None:
        more = identifiers(several, text, key).groupBy(key, "line", "identifier").agg(F.count("*").alias("n")).groupBy("identifier").agg(F.sum("n").alias("n"), F.count("*").alias("lines"))
        counts = counts.unionByName(more).groupBy("identifier").agg(F.sum("n").alias("n"), F.sum("lines").alias("lines"))
    return counts


def identifier_counts(text: Column) -> tuple[Column, Column]:
    """How many identifiers a source text has, and how many different ones; counted where the text is. Null texts have null."""
    words = F.regexp_extract_all(text, F.lit(r"([A-Za-z_@$\x{80}-\x{10FFFF}][A-Za-z0-9_@$\x{80}-\x{10FFFF}]*)"), 1)
    return F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")


def tags(df: DataFrame, html: Column, *keep: str) -> DataFrame:
    """(kept columns, tag) of the begin tags of markup."""
    return df.select(*keep, F.explode(F.regexp_extract_all(html, F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), 1)).alias("tag")).withColumn("tag", F.lower("tag"))


def write_symbols(symbols: DataFrame, path: str) -> None:
    """Records of symbols (sym_scope, def, sym_type, attrs, file_id, line) as text, one folder for each database; a symbol
    without a name has no hash and is left out."""
    c = F.col
    text = record(c("sym_scope"), c("def"), c("sym_type"), c("attrs"), c("file_id"), c("line"))
    symbols.where(symbol_of(c("sym_scope")) != "").select("db_id", text.alias("value")).write.partitionBy("db_id").text(path)


def write_index(symbols: DataFrame, path: str) -> None:
    """Parquet by database and language."""
    symbols.write.partitionBy("db_id", "language").parquet(path)


def load_index(spark: SparkSession, path: str, *, without_dbs: tuple[int, ...] = (), without_languages: tuple[str, ...] = ()) -> DataFrame:
    """An index without some databases and languages; their folders are not read."""
    rows = spark.read.parquet(path)
    rows = rows.where(~F.col("db_id").isin(*without_dbs)) if without_dbs else rows
    return rows.where(~F.col("language").isin(*without_languages)) if without_languages else rows


def sorted_unique(records: DataFrame, value: str = "value") -> DataFrame:
    """Records once each, by symbol (up to the first delimiter) without case, then by the whole record without case."""
    symbol = ascii_lower(F.substring_index(value, DELIMITER, 1))
    return records.select(value).distinct().orderBy(symbol, ascii_lower(F.col(value)), value)


def write_file_dictionary(files: DataFrame, path: str) -> None:
    """`name, hex id` of files (name, file_id), by name."""
    files.orderBy("name").select(F.concat_ws(DELIMITER, "name", to_hex(F.col("file_id"))).alias("value")).write.text(path)


def read_file_dictionary(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", DELIMITER)
    return spark.read.text(path).select(F.get(f, F.lit(0)).alias("name"), from_hex(F.get(f, F.lit(1))).alias("file_id"))


#: Fields of a graph's links and nodes, which stand in hex (names as they are) between bars.
LINKS, NODES = ("src", "scope", "dst", "dir", "kind", "line", "own_dir"), ("node", "scope", "sym", "kind", "attrs", "lines", "line", "dir")
#: Fields that stand as they are.
NAMES = ("sym",)


def write_graph(nodes: DataFrame, links: DataFrame, path: str) -> None:
    for name, df, fields in (("Nodes", nodes, NODES), ("Links", links, LINKS)):
        df.select(F.concat_ws("|", *(F.replace(F.col(f), F.lit("|"), F.lit(" ")) if f in NAMES else to_hex(F.col(f)) for f in fields)).alias("value")).write.text(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, name: str) -> DataFrame:
    f, fields = F.split("value", r"\|"), {"Nodes": NODES, "Links": LINKS}[name]
    return spark.read.text(f"{path}/{name}").select(*((F.get(f, F.lit(i)) if k in NAMES else from_hex(F.get(f, F.lit(i)))).alias(k) for i, k in enumerate(fields)))


def read_line_lists(spark: SparkSession, path: str, encoding: str = "UTF-16LE") -> DataFrame:
    """(line, text) of short lists of lines in another encoding, each file a row before it is split; a byte-order mark goes."""
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_replace(F.decode("content", encoding), "^\\x{FEFF}", "").alias("t"))
    return whole.select(F.posexplode(F.split("t", "\r?\n")).alias("line", "text")).where("text <> ''")


def read_snippets(spark: SparkSession, paths: str, row_tag: str = "CodeSnippet") -> DataFrame:
    """Snippets of XML files below the folders of a list divided by `;`."""
    return spark.read.format("xml").option("rowTag", row_tag).option("recursiveFileLookup", "true").schema("Title string, Shortcut string, Code string").load([p for p in paths.split(";") if p])
