"""Column functions over script texts."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMENT = r"(?s)--[^\n]*|/\*.*?\*/"

# Names of engine-specific syntax and the patterns that find it in lower-cased text without comments.
MARKERS = (
    ("rollup", r"\brollup\s*\("),
    ("cube", r"\bcube\s*\("),
    ("grouping_sets", r"\bgrouping\s+sets\b"),
    ("grouping_fn", r"\bgrouping\s*\("),
    ("select_top", r"\bselect\s+top\b"),
    ("backtick_identifier", r"`[^`]+`"),
    ("interval_arithmetic", r"\binterval\s+['\"]"),
    ("qualify", r"\bqualify\b"),
    ("connect_by", r"\bconnect\s+by\b"),
    ("decode_fn", r"\bdecode\s*\("),
    ("nvl_fn", r"\bnvl\s*\("),
    ("rownum", r"\brownum\b"),
    ("oracle_outer_join", r"\(\+\)"),
    ("stddev_samp", r"\bstddev_samp\s*\("),
    ("listagg", r"\blistagg\s*\(|\bstring_agg\s*\(|\bgroup_concat\s*\("),
)


def strip_comments(sql: Column) -> Column:
    """Without line and block comments; string literals are not told apart."""
    return F.regexp_replace(sql, COMMENT, "")


def lines(text: Column) -> Column:
    """Non-blank lines without white space at their right end."""
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != "")


def line_count(text: Column) -> Column:
    return F.size(lines(text)).cast("long")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that it names several times, computed once (inside a lambda, names are variables)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _needles(pattern: str) -> list[str]:
    """Plain text of which one piece must occur where a pattern matches: the first word of each of its alternatives."""
    words_of = (re.findall("[a-z_]{3,}", re.sub(r"\\[bs]", " ", p)) for p in pattern.split("|"))
    return [w[0] if w else "`" if "`" in pattern else "(+)" for w in words_of]


def markers(sql: Column) -> Column:
    """Names of the markers that occur, in the order of ``MARKERS``; a pattern is tried only where its first word occurs."""

    def found(low: Column) -> Column:
        may = lambda p: functools.reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in _needles(p)])
        return F.array_compact(F.array(*[F.when(may(p) & F.rlike(low, F.lit(p)), F.lit(n)) for n, p in MARKERS]))

    return once(F.lower(strip_comments(sql)), found)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    """Whole part of 1.3 x words + words that hold a digit or ``=``."""
    # From the first digit or = of a word its rest is one match, so each such word is counted once.
    return F.floor(F.regexp_count(text, F.lit(r"\S+")) * F.lit(1.3) + F.regexp_count(text, F.lit(r"[0-9=]\S*"))).cast("long")


def windows(sql: Column, budget: int = 380) -> Column:
    """Windows of whole lines whose estimates (1 a line at least) sum to the budget at most, packed greedily.

    A line over the budget is a window of its own.  The fold carries the closed
    windows, the open one and its tokens, so it stays in the JVM and is linear in lines.
    """
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).cast("long").alias("used"))

    def add(acc: Column, item: Column) -> Column:
        line, cost = item["line"], item["cost"]
        fits = (acc["used"] + cost <= budget) | (F.size(acc["open"]) == 0)
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], F.array_join(acc["open"], "\n"))).alias("done"),
            F.when(fits, F.array_append(acc["open"], line)).otherwise(F.array(line)).alias("open"),
            F.when(fits, acc["used"] + cost).otherwise(cost).alias("used"),
        )

    close = lambda acc: F.when(F.size(acc["open"]) > 0, F.array_append(acc["done"], F.array_join(acc["open"], "\n"))).otherwise(acc["done"])
    weighed = F.transform(lines(strip_comments(sql)), lambda x: F.struct(x.alias("line"), F.greatest(F.lit(1).cast("long"), token_estimate(x)).alias("cost")))
    return F.aggregate(weighed, zero, add, close)


def each_window(scripts: DataFrame, name: str, cut: Column) -> DataFrame:
    """``name``, n, window, sql: a row for each of the windows ``cut``, and their number.

    The optimiser filters by what a plain explode opens, with a copy of the whole computation for each test; an outer one is
    left alone, so texts are cut once.
    """
    rows = scripts.select(name, cut.alias("_w"))
    return rows.select(name, F.size("_w").alias("n"), F.posexplode_outer("_w").alias("window", "sql")).where("window IS NOT NULL")


def window_note(index: Column, total: Column) -> Column:
    """What a window says of its place; null if it is the only one."""
    return F.when(total > 1, F.format_string("Fragment %d of %d of one SQL script.", index + 1, total))


def plural(n: Column, noun: str) -> Column:
    many = noun[:-1] + "ies" if noun.endswith("y") and noun[-2] not in "aeiou" else noun + "s"
    return F.concat(n.cast("string"), F.when(n == 1, f" {noun}").otherwise(f" {many}"))


def join_list(items: Column, conjunction: str = "and") -> Column:
    """a, b and c."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n <= 1, F.coalesce(F.get(items, F.lit(0)), F.lit(""))).otherwise(F.concat(head, F.lit(f" {conjunction} "), F.get(items, n - 1)))
