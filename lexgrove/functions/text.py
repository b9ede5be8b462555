"""Scalar text functions as Column expressions; all but ``replace_by`` are built-in functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A character of an identifier, as a Java pattern: ASCII letters, digits, `_`, `@`, `$`, and everything outside ASCII.
IDENT = r"[A-Za-z0-9_@$\x{80}-\x{10FFFF}]"


def quote(text: str) -> str:
    """The text as a pattern that matches itself."""
    return "".join(c if c.isalnum() or ord(c) > 127 else f"\\x{ord(c):02x}" for c in text)


def ascii_lower(c: Column) -> Column:
    """Folds A-Z alone, unlike lower()."""
    return F.translate(c, UPPER, LOWER)


def ascii_upper(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


def record_text(c: Column) -> Column:
    """The text up to the first NUL or field delimiter (0x02)."""
    return F.substring_index(F.substring_index(c, "\x02", 1), "\x00", 1)


def has_word(c: Column, word: str, case_sensitive: bool = True) -> Column:
    """Whether the word occurs with no identifier character on either side."""
    flags = "" if case_sensitive else "(?i)"
    return c.rlike(f"{flags}(?<!{IDENT}){quote(word)}(?!{IDENT})")


def split_keeping(c: Column, mark: str = "\n") -> Column:
    """Pieces that keep their delimiter; no empty piece at the end."""
    return F.filter(F.split(c, f"(?<={quote(mark)})"), lambda x: x != "")


def symbol_of(path: Column, mark: str = ":") -> Column:
    return F.substring_index(path, mark, -1)


def scope_of(path: Column, mark: str = ":") -> Column:
    """The path without its last part; empty at the top."""
    return F.regexp_replace(path, f"(^|{quote(mark)})[^{quote(mark)}]*$", "")


def ancestors(path: Column, mark: str = ":") -> Column:
    """All prefixes of a path at its marks, the shortest first, the path itself last; none of an empty path."""
    parts = F.filter(F.split(path, quote(mark)), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), mark))).otherwise(F.array().cast("array<string>"))


def squeeze_spaces(c: Column) -> Column:
    return F.regexp_replace(c, " +", " ")


def similarity_key(c: Column) -> Column:
    """Equal for texts that differ in (ASCII) case and white space alone."""
    return ascii_lower(F.regexp_replace(c, r"[\r\n\t ]", ""))


def without_lines(c: Column, fragment: str) -> Column:
    """The text without the lines that contain the fragment; each line has its own line break with it."""
    return F.array_join(F.filter(split_keeping(c), lambda x: ~F.contains(x, F.lit(fragment))), "")


def line_sorted_hash(c: Column) -> Column:
    """SHA-1 of the text's lines in order, so equal for texts whose lines were moved."""
    return F.sha1(F.array_join(F.array_sort(split_keeping(c)), ""))


def natural_key(c: Column) -> Column:
    """A sort key in which digit runs stand for their numbers: letters, digits, spaces and others are tokens of their own."""
    tokens = F.regexp_extract_all(c, F.lit(r"([A-Za-z\x{80}-\x{10FFFF}]+|[0-9]+|\s+|[^A-Za-z0-9\s\x{80}-\x{10FFFF}])"), 1)

    def key(t: Column) -> Column:
        digits = F.regexp_replace(t, "^0+", "")
        # a token begins as it did before, so it stands as before against tokens of other kinds
        return F.when(t.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 6, "0"), digits)).otherwise(t)

    return F.transform(tokens, key)


def initials(c: Column) -> Column:
    """The significant letters: the first one and any after `_` in upper case, and all capitals."""
    marked = F.regexp_replace(F.concat(F.lit("_"), c), "_(.?)", "\x01$1")
    kept = F.regexp_replace(marked, "(?<!\x01)[^A-Z\x01]", "")
    return ascii_upper(F.regexp_replace(kept, "\x01", ""))


def path_id(path: Column) -> Column:
    """A number of 32 bits for a scope or a directory; 0 for none."""
    return F.when(path == "", 0).otherwise(F.conv(F.substring(F.md5(path), 1, 8), 16, 10).cast("long"))


def common_prefix(a: Column, b: Column, mark: str = "/") -> Column:
    """The longest common prefix of two paths that ends at a mark."""
    x, y = F.split(a, quote(mark)), F.split(b, quote(mark))
    n = F.least(F.size(x), F.size(y)) - 1
    same = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.element_at(x, i) == F.element_at(y, i))).otherwise(F.array(F.lit(False)))
    first = F.array_position(same, F.lit(False))
    upto = F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")
    return F.when(upto > 0, F.concat(F.array_join(F.slice(x, F.lit(1), upto), mark), F.lit(mark))).otherwise("")


def without_one(c: Column) -> Column:
    """The word, and the word without each of its characters."""
    return F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))))


def base_name(path: Column) -> Column:
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def from_hex(c: Column) -> Column:
    return F.conv(c, 16, 10).cast("long")


def to_hex(c: Column) -> Column:
    return F.lower(F.hex(c.cast("long")))


def find(c: Column, what: str | Column) -> Column:
    """The first place, from 0; -1 if there is none."""
    return F.instr(c, what) - 1 if isinstance(what, str) else F.locate(what, c) - 1


def reverse_find(c: Column, what: str) -> Column:
    """The last place, from 0; -1 if there is none."""
    at = F.instr(F.reverse(c), what[::-1])
    return F.when(at == 0, -1).otherwise(F.length(c) - at - len(what) + 1)


def find_one_of(c: Column, marks: str) -> Column:
    """The first place of any of the marks, from 0; -1 if there is none."""
    return F.regexp_instr(c, F.lit(f"[{quote(marks)}]")) - 1


def trim_word(c: Column) -> Column:
    """Without what is no part of an identifier at either end."""
    return F.regexp_replace(c, rf"^(?:(?!{IDENT})[\s\S])+|(?:(?!{IDENT})[\s\S])+$", "")


def token_field(c: Column, marks: str, n: int) -> Column:
    """The n-th field (from 0) of a text divided by any of the marks; empty beyond the last."""
    return F.coalesce(F.get(F.split(c, f"[{quote(marks)}]"), F.lit(n)), F.lit(""))


def token_count(c: Column, marks: str) -> Column:
    """How many marks there are."""
    return F.size(F.split(c, f"[{quote(marks)}]")) - 1


def replace_word(c: Column, word: str, new: str) -> Column:
    """Whole words alone."""
    return F.regexp_replace(c, f"(?<!{IDENT}){quote(word)}(?!{IDENT})", _literal(new))


def replace_without_case(c: Column, old: str, new: str) -> Column:
    return F.regexp_replace(c, f"(?i){quote(old)}", _literal(new))


def _literal(new: str) -> str:
    return new.replace("\\", "\\\\").replace("$", "\\$")


def compare(a: Column, b: Column, *, case_sensitive: bool = True, collation: str | None = None) -> Column:
    """-1, 0 or 1, by code point or with A-Z folded; or by a collation's letters (UNICODE, or a language's as ``de``)."""
    if collation is not None:
        name = collation if case_sensitive else f"{collation}_CI"
        a, b = F.collate(a, name), F.collate(b, name)
    elif not case_sensitive:
        a, b = ascii_lower(a), ascii_lower(b)
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def is_lower(c: Column) -> Column:
    """Some text, all ASCII, and no capital."""
    return c.rlike(r"\A[\x{0}-@\[-\x7f]+\z")


def is_upper(c: Column) -> Column:
    """Some text, all ASCII, and no small letter."""
    return c.rlike(r"\A[\x{0}-`{-\x7f]+\z")


def has_upper(c: Column) -> Column:
    """A capital before anything beyond ASCII."""
    return c.rlike(r"\A[\x{0}-@\[-\x7f]*[A-Z]")


def has_mixed_case(c: Column) -> Column:
    return c.rlike("[A-Z]") & c.rlike("[a-z]")


def directory(path: Column) -> Column:
    """The path up to its last slash, with it; empty without one."""
    return F.regexp_extract(F.translate(path, "\\", "/"), "^(.*/)?", 0)


def extension(path: Column) -> Column:
    """From the name's last dot on; empty without one."""
    return F.regexp_extract(base_name(path), r"\.[^.]*$", 0)


def is_absolute(path: Column) -> Column:
    return path.rlike(r"^([A-Za-z]:)?[\\/]|^[a-z]+://")


def relative_path(path: Column, base: str) -> Column:
    """The path from a directory on, if it is below it; else as it is."""
    base = base.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


def minimum_name(name: Column, scope: Column, mark: str = ":") -> Column:
    """What must be written of a qualified name inside a scope: the leading parts that they share go, but for the last part."""
    parts = lambda c: F.split(F.substring(c, 2, 1 << 30), quote(mark))
    a, b = parts(name), parts(scope)
    same = F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: F.coalesce(F.get(a, i - 1) == F.get(b, i - 1), F.lit(False)))
    shared = F.array_position(F.concat(same, F.array(F.lit(False))), F.lit(False)).cast("int") - 1
    upto = F.least(shared, F.size(a) - 1)
    short = F.concat(F.lit(mark), F.array_join(F.slice(a, upto + 1, F.size(a)), mark))
    return F.when(name.startswith(mark) & scope.startswith(mark), short).otherwise(name)


def shortest_name(name: Column, scopes: Column, mark: str = ":") -> Column:
    """The shortest of a name's minimum names in several scopes; the first of equal ones."""
    found = F.transform(F.filter(scopes, lambda x: (x != "") & (x != mark)), lambda x: minimum_name(name, x, mark))
    return F.aggregate(found, name, lambda best, x: F.when(F.length(x) < F.length(best), x).otherwise(best))


#: Characters that scopes may not have stand as the control characters from 0x0E on, in this order (a fixed value).
ENCODED = "<> .\t\r\n-=,&*^\"'()!"
CODES = "".join(chr(0x0E + i) for i in range(len(ENCODED)))


def encode_scope(c: Column) -> Column:
    return F.translate(c, ENCODED, CODES)


def decode_scope(c: Column) -> Column:
    return F.translate(c, CODES, ENCODED)


def byte_offset(c: Column, n: int) -> Column:
    """The place in bytes of the n-th character (from 0) of the text in UTF-8."""
    return F.octet_length(F.substring(c, 1, n))


def url_query(c: Column) -> Column:
    """For a query of a URL: letters, digits and `-._~` stay, all else is encoded."""
    once = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        once = F.replace(once, F.lit(a), F.lit(b))
    return once


#: Placeholders of snippets (fixed names), and their date patterns.
DATES = {
    "YEAR": "yyyy", "YEAR_02": "yy", "MONTH": "M", "MONTH_02": "MM", "MONTHNAME_EN": "MMM", "MONTHLONGNAME_EN": "MMMM", "DAY": "d", "DAY_02": "dd", "DAYNAME_EN": "E", "DAYLONGNAME_EN": "EEEE", "HOUR": "H", "HOUR_02": "HH", "MINUTE": "mm", "SECOND": "ss",
}


def date_field(time: Column, name: str) -> Column:
    return F.date_format(time, DATES[name])


def expand_snippet(template: Column, time: Column) -> Column:
    """A snippet with its placeholders of date and time, as ``$YEAR$``, filled in."""
    out = template
    for name in DATES:
        out = F.replace(out, F.lit(f"${name}$"), date_field(time, name))
    return out


def date_passed(date: Column, now: Column) -> Column:
    """Whether a date `yyyy.MM.dd` is over; any other text is."""
    return F.when(F.length(date) == 10, F.date_format(now, "yyyy.MM.dd") > date).otherwise(True)


def replace_by(c: Column, pattern: str, make: Callable[[str], str]) -> Column:
    """Each match of a pattern replaced by what a function makes of it (in batches in Python, as Spark has no such function)."""

    def replaced(texts: pd.Series) -> pd.Series:
        return texts.str.replace(pattern, lambda m: make(m[0]), regex=True)

    return F.pandas_udf(replaced, "string")(c)
