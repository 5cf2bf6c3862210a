"""Citations, numbers and codes in answers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skarn.functions.text import CODE, NUMBER, _all, fold, overlap_words
from skarn.settings import DEFAULT, Settings

# How citations and the not-found mark are written.
CITATION = r"\[\s*(\p{Nd}+(?:\s*[,\-–]\s*\p{Nd}+)*)\s*\]"
NOT_FOUND = r"(?i)\s*\[\s*NOT[_ ]FOUND\s*\]"
LIST_MARK = r"(?m)^\s*\p{Nd}+[.)]\s+"
STATEMENT_END = r"(?<=[.!?])\s+|\n+"
_IS_CODE = r"^(?=.*\p{Nd})(?=.*\p{L})"


def cited_numbers(text: Column, s: Settings = DEFAULT) -> Column:
    """All cited numbers in order, repeats included; an ascending range of at most 20 counts as its members."""

    def members(part: Column) -> Column:
        ends = F.transform(F.split(part, r"\s*[-–]\s*"), lambda x: F.expr("bigint(0)") + F.trim(x).try_cast("bigint"))
        a, b = F.get(ends, 0), F.get(ends, 1)
        ranged = (F.size(ends) == 2) & (b > a) & (b - a <= s.max_citation_range)
        return F.when(ranged, F.sequence(a, F.when(ranged, b).otherwise(a))).otherwise(ends)

    groups = _all(text, CITATION, 1)
    return F.flatten(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*"))), members))


def citations(text: Column, sources: Column, s: Settings = DEFAULT) -> Column:
    """(numbers, invalid, not_found, clean_text) of an answer given with so many numbered sources."""
    cited = F.array_distinct(cited_numbers(text, s))
    valid = F.filter(cited, lambda n: (n >= 1) & (n <= sources))
    return F.struct(
        valid.alias("numbers"),
        F.filter(cited, lambda n: (n < 1) | (n > sources)).alias("invalid"),
        text.rlike(NOT_FOUND).alias("not_found"),
        F.trim(F.regexp_replace(text, NOT_FOUND, "")).alias("clean_text"),
    )


def number_key(c: Column) -> Column:
    """Digits without separators and leading zeros."""
    digits = F.regexp_replace(F.regexp_replace(c, r"\P{Nd}", ""), "^0+", "")
    return F.when(digits == "", F.lit("0")).otherwise(digits)


def facts_written(text: Column) -> Column:
    """(key, written) of every code (a digit and a letter, joined by - _ /) and of every number outside of codes."""
    codes = F.filter(_all(text, CODE), lambda x: x.rlike(_IS_CODE))
    rest = F.regexp_replace(fold(text), r"(?<![\p{L}\p{N}])(?=[\p{L}\p{N}]++[-_/])(?=[\p{L}\p{N}\-_/]*\p{Nd})(?=[\p{L}\p{N}\-_/]*\p{L})" + CODE, " ")
    return F.concat(
        F.transform(codes, lambda x: F.struct(F.concat(F.lit("code:"), F.regexp_replace(fold(x), "[-_/]", "")).alias("key"), x.alias("written"))),
        F.transform(_all(rest, NUMBER), lambda x: F.struct(number_key(x).alias("key"), x.alias("written"))),
    )


def fact_keys(text: Column, parts: bool = False) -> Column:
    """Distinct keys of the facts of a text; with `parts` also those inside codes and of the parts of numbers."""
    keys = F.transform(facts_written(text), lambda f: f["key"])
    if parts:
        numbers = _all(fold(text), NUMBER)
        inside = F.flatten(F.transform(numbers, lambda n: F.transform(F.split(n, "[.,:/]"), number_key)))
        keys = F.concat(keys, F.transform(numbers, number_key), inside)
    return F.array_distinct(keys)


def unverified(answer: Column, sources: Column, question: Column, s: Settings = DEFAULT) -> Column:
    """Facts of an answer that the sources it cites do not hold: (key, fact, statement, cited, found_in).

    Each statement is held against its own citations, or against all citations of the answer if it has none; facts of
    the question need no source. An answer without any valid citation has nothing to be held against."""
    n = F.size(sources)
    everywhere = F.filter(F.array_distinct(cited_numbers(answer, s)), lambda x: (x >= 1) & (x <= n))
    held = F.transform(sources, lambda t: fact_keys(t, True))
    known = fact_keys(question, True)
    statements = F.split(F.regexp_replace(F.regexp_replace(answer, NOT_FOUND, ""), LIST_MARK, ""), STATEMENT_END)

    def of(statement: Column) -> Column:
        own = F.filter(F.array_distinct(cited_numbers(statement, s)), lambda x: (x >= 1) & (x <= n))
        cited = F.when(F.size(own) > 0, own).otherwise(everywhere)
        text = F.trim(F.regexp_replace(statement, CITATION, ""))
        allowed = F.flatten(F.transform(cited, lambda i: F.get(held, i.cast("int") - 1)))
        missing = F.filter(facts_written(text), lambda f: ~F.array_contains(allowed, f["key"]) & ~F.array_contains(known, f["key"]))
        places = F.sequence(F.lit(1).cast("bigint"), F.greatest(n, F.lit(1)).cast("bigint"))
        return F.transform(
            missing,
            lambda f: F.struct(
                f["key"].alias("key"), f["written"].alias("fact"), text.alias("statement"), cited.alias("cited"),
                F.filter(places, lambda i: F.coalesce(F.array_contains(F.get(held, i.cast("int") - 1), f["key"]), F.lit(False)) & ~F.array_contains(cited, i)).alias("found_in"),
            ),
        )

    found = F.flatten(F.transform(statements, of))
    # The first of equal (fact, citations) counts.
    tag = lambda f: F.concat_ws("|", f["key"], F.concat_ws(",", F.transform(f["cited"], lambda x: x.cast("string"))))
    tags = F.transform(found, tag)
    first = F.filter(found, lambda f, i: F.array_position(tags, tag(f)) == i + 1)
    return F.when((F.size(everywhere) > 0) & (n > 0), first).otherwise(F.filter(found, lambda f: F.lit(False)))


def pieces(content: Column) -> Column:
    """Sentences of a text's lines; a table row stays whole."""
    lines = F.transform(F.split(content, r"\r\n|\n|\r"), lambda x: F.trim(x))
    cut = F.flatten(F.transform(lines, lambda x: F.when(x.startswith("|"), F.array(F.regexp_replace(x, r"^[ |]+|[ |]+$", ""))).otherwise(F.split(x, r"(?<=[.!?])\s+"))))
    return F.filter(cut, lambda p: F.size(overlap_words(p)) > 0)


def best_piece(content: Column, answer: Column) -> Column:
    """The piece that shares most words with the answer, the earliest of equal ones; empty if there is none."""
    wanted = overlap_words(answer)
    ranked = F.transform(pieces(content), lambda p, i: F.struct(F.size(F.array_intersect(wanted, overlap_words(p))).alias("n"), (-i).alias("i"), p.alias("piece")))
    return F.coalesce(F.array_max(ranked)["piece"], F.lit(""))


def shortened(c: Column, width: int) -> Column:
    """A text in single spaces, cut after a word with an ellipsis if it is longer than `width`."""
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    head = F.regexp_extract(flat, rf"^(.{{0,{width - 2}}})(?=\s)", 1)
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.rtrim(head), F.when(head != "", " …").otherwise("…")))
