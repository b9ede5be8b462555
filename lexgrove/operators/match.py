"""Text filters with match ranks, as Column expressions that the optimiser can push to the scan.

A filter has terms divided by spaces (all must match) and, where alternatives are allowed, by commas (the first that matches
counts). A term: leading `-` excludes, leading and trailing `.` anchor it to words' begins and ends, and it is case-sensitive
if it has a capital. Ranks: 5 whole word at the beginning, 4 beginning (or whole word elsewhere), 3 end of a word, 2 begin of
a word, 1 anywhere, 0 none; they are those of the first place where the term matches.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions.text import IDENT, ascii_lower, initials, quote, record_text


@dataclass(frozen=True)
class Term:
    text: str
    excludes: bool = False
    starts: bool = False
    ends: bool = False
    case_sensitive: bool = False
    eats_mark: str | None = None  # a mark at the very beginning that doesn't count as text

    @property
    def plain(self) -> bool:
        return not (self.excludes or self.starts or self.ends or self.case_sensitive)


def compile_term(term: str, *, mark: str = ".", eats_mark: str | None = None, case_option: bool = True) -> Term:
    excludes = len(term) > 1 and term.startswith("-")
    term = term[1:] if excludes else term
    starts = len(term) > 1 and term.startswith(mark)
    term = term[1:] if starts else term
    ends = len(term) > 1 and term.endswith(mark)
    term = term[:-1] if ends else term
    return Term(term, excludes, starts, ends, case_option and any("A" <= c <= "Z" for c in term), eats_mark)


def normalise_filter(text: str, *, file_search: bool = False, mark: str = ".") -> str:
    """The filter as typed, without what would not change the result: trailing dashes, lone dots, outer spaces."""
    text = text.rstrip("-")
    for end in ("-.", " ."):
        text = text.removesuffix(end)
    text = text.strip(" ")
    text = "" if text == "." else text
    text = text.replace("::", ".")
    return text.replace(".", ":") if mark == ":" else text if file_search else text.replace(":", ".")


def rank(c: Column, term: Term) -> Column:
    """The rank of one term; 1 or 0 for an excluding term. A term without text ranks 0 (excluding: 1)."""
    if not term.text:
        return F.lit(int(term.excludes))
    text = record_text(c)
    text, want = (text, term.text) if term.case_sensitive else (ascii_lower(text), term.text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    before = f"(?<!{IDENT})" if term.starts else ""
    after = f"(?!{IDENT})" if term.ends else ""
    eaten = f"(?<=\\A{quote(term.eats_mark)})|" if term.eats_mark else ""
    if not before and not after:
        place = F.instr(text, want)
    else:
        place = F.regexp_instr(text, F.lit((f"(?:{eaten}{before})" if before else "") + quote(want) + after))
    if term.excludes:
        return (place == 0).cast("int")
    beginning = (place == 1) | ((place == 2) & (F.substring(text, 1, 1) == term.eats_mark)) if term.eats_mark else place == 1
    word = ~F.substring(text, place - 1, F.lit(1)).rlike(IDENT)
    best, good, rest = (5, 4, 3) if term.ends else (4, 2, 1)
    return F.when(place == 0, 0).when(beginning, best).when(word, good).otherwise(rest).cast("int")


def rank_all(c: Column, terms: str, **options) -> Column:
    """Terms divided by spaces: the least rank, 0 if any is 0."""
    ranks = [rank(c, compile_term(t, **options)) for t in terms.split(" ") if t]
    return F.lit(0) if not ranks else ranks[0] if len(ranks) == 1 else F.least(*ranks)


def rank_any(c: Column, alternatives: str, **options) -> Column:
    """Alternatives divided by commas: the first one's rank that is not 0."""
    ranks = [rank_all(c, t, **options) for t in alternatives.split(",") if t]
    return F.lit(0) if not ranks else F.coalesce(*(F.nullif(r, F.lit(0)) for r in ranks), F.lit(0))


def filter_set(df: DataFrame, c: Column, text: str, **options) -> DataFrame:
    """Rows that match all including terms and no excluding one, with ``rank`` (that of the including terms). A term with a
    dash anywhere is put with the excluding ones. An empty filter keeps all rows."""
    terms = [t for t in normalise_filter(text, mark=options.get("mark", ".")).split(" ") if t]
    if not terms:
        return df.withColumn("rank", F.lit(0))
    wanted, unwanted = [t for t in terms if "-" not in t], [t for t in terms if "-" in t]
    kept = df
    for t in unwanted:
        kept = kept.where(rank(c, compile_term(t, **options)) > 0)
    ranked = kept.withColumn("rank", rank_all(c, " ".join(wanted), **options) if wanted else F.lit(1))
    return ranked.where(F.col("rank") > 0)


def filter_files(df: DataFrame, path: Column, text: str) -> DataFrame:
    """Files by alternatives; both slashes are one; the whole path counts if the filter has a slash, else the name."""
    text = normalise_filter(text, file_search=True)
    if not text:
        return df.withColumn("rank", F.lit(0))
    folded = F.translate(path, "\\", "/")
    subject = folded if "/" in text or "\\" in text else F.substring_index(folded, "/", -1)
    return df.withColumn("rank", rank_any(subject, text.replace("\\", "/"))).where(F.col("rank") > 0)


def same_exclusions(before: str, after: str) -> bool:
    """Whether two filters have the same terms with a dash."""
    dashed = lambda text: sorted(t for t in text.split(" ") if "-" in t)
    return dashed(before) == dashed(after)


def narrows(before: str, after: str) -> bool:
    """Whether all that a longer filter finds is among what the shorter one has found."""
    return bool(before) and after.startswith(before) and "," not in after and ("-" not in after or same_exclusions(before, after))


def refilter(every: DataFrame, found: DataFrame, before: str, after: str, c: Column, **options) -> DataFrame:
    """The filter ``after`` over what ``before`` has found, where it narrows that, else over every row."""
    return filter_set(found.select(*every.columns) if narrows(before, after) else every, c, after, **options)


def filter_nodes(nodes: DataFrame, c: Column, text: str) -> DataFrame:
    """Nodes of a tree with ``shown``: whether all terms without a dash, and none with one, match a node's own text; each level
    is judged alone. A single term is never an excluding one."""
    terms = [normalise_filter(t, file_search=True) for t in text.split(" ")] if " " in text else [normalise_filter(text, file_search=True)]
    tests = [rank(c, compile_term(t)) > 0 for t in terms if t]
    return nodes.withColumn("shown", reduce(lambda x, y: x & y, tests, F.lit(True)))


def filter_groups(items: DataFrame, group: str, c: Column, text: str) -> DataFrame:
    """Items that match, and their groups' numbers of them; a group without any is gone. An empty filter hides nothing."""
    kept = filter_set(items, c, text).drop("rank")
    return kept.join(kept.groupBy(group).agg(F.count("*").alias("shown")), group)


def without_excluded(df: DataFrame, path: Column, fragments: list[str], patterns: list[str]) -> DataFrame:
    """Without paths that have any of some fragments, or that a pattern matches from end to end; case doesn't count."""
    low = F.lower(path)
    drop = [F.contains(low, F.lit(f.lower())) for f in fragments] + [low.rlike(f"\\A(?:{p})\\z") for p in patterns]
    return df.where(~reduce(lambda x, y: x | y, drop)) if drop else df


def suggested(ranked: DataFrame, seq: str) -> DataFrame:
    """The earliest row of the highest rank."""
    return ranked.orderBy(F.desc("rank"), seq).limit(1)


def fuzzy_rank(c: Column, term: Term, threshold: int = 75) -> Column:
    """The rank, or 1 where a plain term is similar enough to a stretch of the text. The UDF sees only rows that rank 0."""
    exact = rank(c, term)
    if not term.plain or len(term.text) <= 2:
        return exact
    text = ascii_lower(record_text(c))
    near = F.when((exact == 0) & (F.length(text) > 2), text)
    return F.when(exact > 0, exact).when(fuzzy.partial_ratio_of(near, F.lit(term.text.lower())) >= threshold, 1).otherwise(0)


def acronym_rank(c: Column, term: Term) -> Column:
    """The rank, or 1 where a plain term occurs among the text's significant letters."""
    exact = rank(c, term)
    if not term.plain:
        return exact
    letters = initials(record_text(c))
    hit = (F.length(letters) >= 2) & (F.length(letters) < F.length(record_text(c))) & F.contains(letters, F.lit(term.text.upper()))
    return F.when(exact > 0, exact).when(hit, 1).otherwise(0)


def completion_class(c: Column, typed: str) -> Column:
    """How well a symbol completes what was typed: 1 equal, 3 equal but for case, 5 and 7 likewise for its beginning, 8 its
    significant letters, 9 anywhere; null if none of these."""
    low = typed.lower()
    letters = initials(c)
    classes = [(c == typed, 1), (ascii_lower(c) == low, 3), (c.startswith(typed), 5), (ascii_lower(c).startswith(low), 7), (letters.startswith(typed.upper()) & (F.length(letters) >= 2), 8), (F.contains(ascii_lower(c), F.lit(low)), 9)]
    return reduce(lambda when, x: when.when(*x), classes[1:], F.when(*classes[0]))


def completions(symbols: DataFrame, name: str, typed: str) -> DataFrame:
    """Symbols that complete what was typed, with their ``class``. Names of no better class are tried letter by letter, each
    different name once."""
    c = F.col(name)
    classed = symbols.withColumn("class", completion_class(c, typed))
    rest = classed.where(F.col("class").isNull()).select(name).distinct()
    weak = rest.select(name, fuzzy.subsequence_class_of(c, F.lit(typed)).alias("_class")).where("_class is not null")
    return classed.join(weak, name, "left").withColumn("class", F.coalesce("class", "_class")).where(F.col("class").isNotNull()).select(*symbols.columns, "class")
