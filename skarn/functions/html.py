"""The main text of web pages as a column: no page leaves the JVM, and no row meets another."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from skarn.settings import DEFAULT, Settings

# Elements without an end tag, elements that start a line, and the roots in the order they are looked for.
VOID = tuple("area base br col embed hr img input link meta source track wbr".split())
BREAKS = tuple("p div section article main li ul ol table tr h1 h2 h3 h4 h5 h6 header blockquote pre br".split())
ROOTS = ("main", "article", "body")

# Loops over quoted values are possessive: Java runs these in a loop, others by recursion, which long tags would overflow.
_ATTRIBUTES = r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+"""
_PIECE = "|".join(
    (
        r"<!--.*?(?:-->|\z)",
        r"<(?:[!?]|/(?![a-z]))[^>]*+>",
        rf"<(script|style)(?=[\s>]){_ATTRIBUTES}(?<!/)>.*?(?:</\1(?=[\s/>])[^>]*+>|\z)",
        rf"</?[a-z][^\s/>]*+{_ATTRIBUTES}>",
        r"</?[a-z][^>]*+>",
        r"[^<]++",
        r"<",
    )
)
_ATTRIBUTE = r"""[^\s"'=<>/]++\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""
_REFERENCE = r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[^\t\n\f <&#;]{1,32};?)"

# Common names stand first: a map is searched from its start.
_COMMON = ("amp;", "nbsp;", "quot;", "lt;", "gt;", "apos;", "copy;", "middot;")
_NAMED = {**{k: html5[k] for k in _COMMON}, **html5}
_OPEN_ENDED = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=len, reverse=True))


def _windows(n: int) -> str:
    try:
        return bytes([n]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(n)


#: Numbers that pages mean as Windows letters.
_NUMBERED = {str(n): _windows(n) for n in range(0x80, 0xA0)}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _map(values: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def _code_point(n: Column) -> Column:
    """The character of a number, by the rules of web pages."""
    gone = n.between(1, 8) | n.between(14, 31) | n.isin(11, 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    letter = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when(n.between(0x80, 0x9F), F.try_element_at(_map(_NUMBERED), n.cast("string"))).when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "�").when(gone, "").otherwise(letter)


def _character(ref: Column) -> Column:
    """What one reference (with its ampersand) stands for; itself, if for nothing."""
    digits = F.regexp_extract(ref, r"^&#[xX]?0*+([0-9a-fA-F]*+)", 1)
    number = F.when(F.length(digits) > 8, F.lit(0x110000).cast("long")).when(digits == "", F.lit(0).cast("long"))
    number = number.when(F.lower(F.substring(ref, 3, 1)) == "x", F.conv(digits, 16, 10).cast("long")).otherwise(digits.cast("long"))
    name = F.substring(ref, 2, 40)
    whole = let(name, lambda k: F.try_element_at(_map(_NAMED), k))
    start = F.regexp_extract(name, f"^(?:{_OPEN_ENDED})", 0)
    part = let(start, lambda k: F.when(k != "", F.concat(F.try_element_at(_map(_NAMED), k), F.substr(name, F.length(k) + 1))))
    return F.when(ref.startswith("&#"), let(number, _code_point)).otherwise(F.coalesce(whole, part, ref))


def unescaped(text: Column) -> Column:
    """A text with its character references replaced, those without a semicolon too; what stands for nothing stays."""
    refs = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    joined = let(refs, lambda found: F.array_join(F.transform(F.split(text, _REFERENCE, -1), lambda p, i: F.concat(p, F.when(i < F.size(found), _character(F.get(found, i))).otherwise(""))), ""))
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def _elements(pieces: Column, s: Settings) -> Column:
    """(at, name, end, empty, noisy) of the tags among a page's pieces, without scripts, styles and void elements."""

    def element(t: Column, i: Column) -> Column:
        name = F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][^\s/>]*+)", 1))
        named = F.exists(F.regexp_extract_all(t, F.lit(_ATTRIBUTE), F.lit(0)), lambda a: F.rlike(a, F.lit(rf"(?is)^(?:class|id)\s*=.*(?:{s.noise_attributes})")))
        noisy = F.when(F.startswith(t, F.lit("</")), F.lit(False)).otherwise(name.isin(*s.noise_tags) | (F.contains(t, F.lit("=")) & named))
        return F.struct(i.alias("at"), name.alias("name"), F.startswith(t, F.lit("</")).alias("end"), F.endswith(t, F.lit("/>")).alias("empty"), noisy.alias("noisy"))

    return F.filter(F.transform(pieces, element), lambda x: (x["name"] != "") & ~x["name"].isin("script", "style", *VOID))


def _kept(stack: Column, tag: Column) -> Column:
    """The open elements below the innermost one of an end tag; all, if none is open."""
    mark = F.concat(F.lit("/"), tag["name"], F.lit(">"))
    after = F.call_function("substring_index", stack, mark, F.lit(-1))
    return F.when(F.contains(stack, mark), F.left(stack, F.length(stack) - F.length(after) - F.length(mark))).otherwise(stack)


def _moved(stack: Column, tag: Column) -> Column:
    """The open elements after a tag, outermost first: a string of /name> each, which copies fast."""
    return F.when(tag["end"], _kept(stack, tag)).when(tag["empty"], stack).otherwise(F.concat(stack, F.lit("/"), tag["name"], F.lit(">")))


def _root(tags: Column, n: Column) -> Column:
    """(a, b): the pieces from the root's first tag to its last one; all pieces, if there is no root."""
    names = F.transform(F.filter(tags, lambda x: ~x["end"]), lambda x: x["name"])
    wanted = F.lit(None).cast("string")
    for r in reversed(ROOTS):
        wanted = F.when(F.array_contains(names, r), r).otherwise(wanted)

    def step(root: Column) -> Callable[[Column, Column], Column]:
        def run(acc: Column, tag: Column) -> Column:
            def after(stack: Column) -> Column:
                opens = acc["a"].isNull() & ~tag["end"] & (tag["name"] == root)
                left = (acc["depth"] >= F.length(stack)) & acc["b"].isNull() & tag["end"]
                depth = F.when(opens, F.length(acc["stack"])).otherwise(acc["depth"])
                b = F.when(left | (opens & tag["empty"]), tag["at"]).otherwise(acc["b"])
                return F.struct(stack.alias("stack"), F.when(opens, tag["at"]).otherwise(acc["a"]).alias("a"), b.alias("b"), depth.alias("depth"))

            return F.when(acc["b"].isNotNull(), acc).otherwise(let(_moved(acc["stack"], tag), after))

        return run

    none = F.lit(None).cast("int")
    start = F.struct(F.lit("").alias("stack"), none.alias("a"), none.alias("b"), none.alias("depth"))
    found = lambda root: F.aggregate(tags, start, step(root), lambda x: F.struct(x["a"].alias("a"), F.coalesce(x["b"], n - 1).alias("b")))
    return let(wanted, lambda root: F.when(root.isNull(), F.struct(F.lit(-1).alias("a"), n.alias("b"))).otherwise(found(root)))


def _clear(tags: Column, root: Column) -> Column:
    """(a, b): the stretches of pieces inside the root that no noisy element holds; an element's own tags count as outside."""

    def step(acc: Column, tag: Column) -> Column:
        def after(stack: Column) -> Column:
            hides = acc["hidden"].isNull() & tag["noisy"] & ~tag["empty"]
            shows = tag["end"] & (acc["hidden"] >= F.length(stack))
            hidden = F.when(hides, F.length(acc["stack"])).when(~shows, acc["hidden"])
            kept = F.when(hides, F.array_append(acc["kept"], F.struct(acc["a"].alias("a"), tag["at"].alias("b")))).otherwise(acc["kept"])
            return F.struct(stack.alias("stack"), hidden.alias("hidden"), F.when(shows, tag["at"]).otherwise(acc["a"]).alias("a"), kept.alias("kept"))

        return let(_moved(acc["stack"], tag), after)

    inside = F.filter(tags, lambda x: (x["at"] > root["a"]) & (x["at"] < root["b"]))
    start = F.struct(F.lit("").alias("stack"), F.lit(None).cast("int").alias("hidden"), root["a"].alias("a"), F.array().cast("array<struct<a:int,b:int>>").alias("kept"))
    last = lambda x: F.when(x["hidden"].isNull(), F.array_append(x["kept"], F.struct(x["a"].alias("a"), root["b"].alias("b")))).otherwise(x["kept"])
    return F.aggregate(inside, start, step, last)


def main_text(html: Column, s: Settings = DEFAULT) -> Column:
    """The text of a page's first main, else article, else body element, else of all of it, one line a block.

    Noisy elements inside the root (by tag, or by class or id) are left out, as are scripts, styles and comments; a root is
    read even where it is noisy itself or lies in something noisy. An end tag closes all that was opened after its start tag;
    one that closes nothing is ignored. A `<` that begins no tag is text; a comment, script or style that is never closed
    reaches to the end. Null and empty pages have an empty text. A page is one row: the time is that of its tags times the
    bytes of the names of elements open at once."""

    def text(pieces: Column, tags: Column) -> Column:
        def said(t: Column) -> Column:
            name = F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][^\s/>]*+)", 1))
            return F.when(~F.startswith(t, F.lit("<")), unescaped(t)).when(t == "<", t).when(name.isin(*BREAKS), "\n").otherwise("")

        def between(root: Column) -> Column:
            stretches = F.transform(_clear(tags, root), lambda r: F.slice(pieces, F.greatest(r["a"], F.lit(0)) + 1, F.greatest(r["b"] - F.greatest(r["a"], F.lit(0)) + 1, F.lit(0))))
            return F.array_join(F.transform(F.flatten(stretches), said), "")

        return let(_root(tags, F.size(pieces)), between)

    pieces = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(f"(?is){_PIECE}"), F.lit(0))
    joined = let(pieces, lambda p: let(_elements(p, s), lambda t: text(p, t)))
    spaced = F.regexp_replace(joined, r"[\t\x0B\f\r \x1c-\x1f\x85\p{Z}]+", " ")
    return F.regexp_replace(F.regexp_replace(spaced, r" ?\n[ \n]*+", "\n"), r"^[ \n]++|[ \n]++$", "")
