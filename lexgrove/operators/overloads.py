"""Overloads that fit a call: by the number of arguments where that decides, else by types, with conversions that are less welcome.

A candidate has ``params`` (types, an array), ``n_default`` (how many of the last have a default), ``variadic`` (its last
parameter takes what is left) and ``is_const``. ``judged`` gives each candidate, by itself, whether the count fits and how
welcome the types are; ``decide`` needs of a set of candidates only how many there are of each judgement, so it works on counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types of C that are primitive, and those that are strings.
PRIMITIVE = ("bool", "char", "int", "float", "double", "void", "wchar_t", "unsigned", "short", "long", "signed", "TCHAR", "WCHAR")
STRINGS = ("string", "CString", "TCHAR*", "WCHAR*", "LPSTR", "LPCSTR", "LPWSTR", "LPCWSTR", "LPTSTR", "LPCTSTR", "char*", "std::string")

#: A literal 0 as an argument.
ZERO = "0"
#: How welcome a conversion is: the same type, one that others go before, one that all others go before; and none.
SAME, WEAK, WEAKEST, NO = 0, 1, 2, 9


@dataclass(frozen=True)
class Call:
    """A call's argument types, and whether it stands in a const method. A literal 0 is the type ``0``."""

    args: tuple[str, ...]
    in_const: bool = False


def plain(kind: Column) -> Column:
    """A type with no white space but between words."""
    return F.regexp_replace(F.trim(F.regexp_replace(kind, r"\s+", " ")), r"(?<=\W) | (?=\W)", "")


def _bare(kind: Column) -> Column:
    """Without const."""
    return F.trim(F.regexp_replace(kind, r"\b(const|CONST)\b ?", ""))


def welcome(arg: Column, param: Column, convertible: Column | None = None) -> Column:
    """How welcome an argument's type is as a parameter's. convertible: whether a base class, a cast or a constructor leads
    from the one to the other."""
    zero = arg == ZERO
    kind, wanted = plain(F.when(zero, "int").otherwise(arg)), plain(param)
    marked = F.contains(wanted, F.lit("*")) | F.contains(wanted, F.lit("&"))
    kind, wanted = F.when(marked, kind).otherwise(_bare(kind)), _bare(wanted)
    strings = kind.isin(*STRINGS) & wanted.isin(*STRINGS)  # by value: a reference to a string is none of them
    kind = F.regexp_replace(F.when(wanted.endswith("&"), _bare(kind)).otherwise(kind), "&$", "")
    wanted = F.regexp_replace(wanted, "&+$", "")
    signless = lambda c: F.trim(F.regexp_replace(c, r"\b(un)?signed\b ?", ""))
    pointer = F.contains(wanted, F.lit("*"))
    whole = _bare(kind).isin("int", "long")
    return (
        F.when((kind == wanted) | strings, SAME)
        .when(F.lit(False) if convertible is None else convertible, SAME)
        .when(zero & (wanted == "void*"), WEAK).when(whole & pointer, WEAKEST)
        .when((kind == "nullptr") & pointer, SAME)
        .when(signless(kind).isin(*PRIMITIVE) & signless(wanted).isin(*PRIMITIVE), WEAK)
        .when(F.contains(kind, F.lit("*")) & (wanted == "void*"), WEAK)
        .otherwise(NO)
    )


def required(df: DataFrame, name: str = "name") -> DataFrame:
    """Candidates with ``n_required``: an implementation doesn't repeat the defaults of its declaration, so rows of one name with
    the same types have those of the one that has any."""
    own = F.size("params") - F.col("n_default")
    known = df.where("n_default > 0").groupBy(F.col(name).alias("_name"), F.transform("params", plain).alias("_types")).agg(F.min(own).alias("_known"))
    same = F.col(name).eqNullSafe(F.col("_name")) & (F.transform("params", plain) == F.col("_types"))
    return df.join(known, same, "left").withColumn("n_required", F.coalesce("_known", own)).drop("_name", "_types", "_known")


def judged(df: DataFrame, call: Call, conversions: DataFrame | None = None, name: str = "name") -> DataFrame:
    """Candidates with ``by_count`` (the number of arguments fits), ``by_type`` (the least welcome conversion; const counts, too)
    and ``signature`` (what may differ where the count alone is to decide). conversions: (from, to) types that others lead
    to, by base classes, casts or constructors."""
    n = len(call.args)
    rows = required(df, name)
    size = F.size("params")
    by_count = (F.lit(n) >= F.col("n_required")) & (F.col("variadic") | (F.lit(n) <= size))
    # a variadic's last parameter takes whatever comes
    typed = F.when(F.col("variadic"), size - 1).otherwise(F.least(size, F.lit(n)))
    args = F.array(*map(F.lit, call.args)).cast("array<string>")
    if conversions is None:
        leads = lambda a, p: None
    else:
        # the few conversions that start from one of the call's types
        wanted = conversions.where(F.col("from").isin([a for a in call.args if a != ZERO])).select(F.concat(plain(F.col("from")), F.lit("\n"), plain(F.col("to"))).alias("pair"), F.col("to").alias("_to")).distinct()
        used = rows.select(F.explode(F.transform("params", lambda p: F.regexp_replace(_bare(plain(p)), "&+$", ""))).alias("_type")).distinct()
        met = wanted.join(used, plain(F.col("_to")) == F.col("_type")).select("_type", "pair")
        by_row = rows.select(F.col("seq").alias("_seq"), F.explode(F.array_distinct(F.transform("params", lambda p: F.regexp_replace(_bare(plain(p)), "&+$", "")))).alias("_type")).join(met, "_type").groupBy("_seq").agg(F.collect_set("pair").alias("_pairs"))
        rows = rows.join(by_row, rows["seq"] == by_row["_seq"], "left").drop("_seq")
        bare = lambda c: F.regexp_replace(_bare(plain(c)), "&+$", "")
        leads = lambda a, p: F.coalesce(F.array_contains("_pairs", F.concat(bare(a), F.lit("\n"), bare(p))), F.lit(False))
    steps = F.transform(F.slice("params", F.lit(1), F.greatest(F.least(typed, F.lit(n)), F.lit(0))), lambda p, i: welcome(F.get(args, i), p, leads(F.get(args, i), p)))
    worst = F.coalesce(F.array_max(steps), F.lit(SAME))
    const = F.when(F.col("is_const") == F.lit(call.in_const), SAME).when(F.col("is_const"), WEAK).otherwise(NO)
    by_type = F.when(by_count, F.greatest(worst, const)).otherwise(NO)
    signature = F.concat_ws("\n", F.col("is_const").cast("string"), F.transform(F.slice("params", F.lit(1), F.col("n_required")), plain))
    return rows.withColumns({"by_count": by_count, "by_type": by_type, "signature": F.when(by_count, signature)}).drop("_pairs", "n_required")


def decide(groups: list[dict]) -> list[dict]:
    """Of groups of candidates (by_count, by_type, variadic, n_params, low and high of their signatures) those that are the call's.
    If all that the count admits have one signature, the count decides; else the types. What needs a less welcome conversion goes if
    there is better; variadic ones go if there are others, else those with most parameters stay."""
    counted = [g for g in groups if g["by_count"]]
    if len({s for g in counted for s in (g["low"], g["high"])}) == 1:
        left = counted
    else:
        left = [g for g in groups if g["by_type"] != NO]
        kinds = {g["by_type"] for g in left}
        if {WEAK, WEAKEST} <= kinds:
            left = [g for g in left if g["by_type"] != WEAKEST]
        elif SAME in kinds:
            left = [g for g in left if g["by_type"] == SAME]
    if any(not g["variadic"] for g in left):
        return [g for g in left if not g["variadic"]]
    most = max((g["n_params"] for g in left), default=0)
    return [g for g in left if g["n_params"] == most]
