"""Text as columns: folding, search words, phrase matching, lines, records and numbers.

Three normal forms are kept apart on purpose: `fold` for search words and facts (ASCII look-alikes merge), `normalize`
for phrases (Turkish lower case, no look-alikes) and `line_key` for repeated lines (plain lower case)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skarn.settings import DEFAULT, Settings

# Letters that search treats alike.
FOLD_FROM = "çğıöşüâîû"
FOLD_TO = "cgiosuaiu"
# The shapes of codes, numbers and words.
# A code starts where a run of letters and digits does; runs are never given up in part, so other words are passed over in one go.
CODE = r"(?<![\p{L}\p{N}])[\p{L}\p{N}]++(?:[-_/][\p{L}\p{N}]++)+"
TOKEN = r"\p{Nd}+(?:[.,]\p{Nd}+)*|[\p{L}\p{Nl}\p{No}]+"
APOSTROPHE = r"['’][\p{L}\p{N}_]+"
NUMBER = r"\p{Nd}+(?:[.,:/]\p{Nd}+)*"
PAGE_NUMBER = r"(?iu)^\s*(sayfa|page)\s*\p{Nd}+(\s*(/|of)\s*\p{Nd}+)?\s*$"


def _lit(x: str) -> Column:
    return F.lit(x)


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, _lit(pattern), F.lit(group))


def fold(c: Column) -> Column:
    """Lower case with Turkish and accented look-alikes as ASCII."""
    c = F.lower(F.replace(c, _lit("İ"), _lit("i")))
    # Looking for nine letters one after the other costs less than looking each letter of the text up.
    for a, b in zip(FOLD_FROM, FOLD_TO, strict=True):
        c = F.replace(c, _lit(a), _lit(b))
    return c


def search_tokens(c: Column, s: Settings = DEFAULT) -> Column:
    """The search words of a text, repeats included: codes that hold a digit (joined), numbers without separators, and
    words of two letters or more cut to a prefix. What follows an apostrophe is dropped."""

    def words(plain: Column) -> Column:
        codes = F.transform(F.filter(_all(plain, CODE), lambda x: x.rlike(r"\p{Nd}")), lambda x: F.regexp_replace(x, "[-_/]", ""))
        runs = F.filter(_all(plain, TOKEN), lambda x: x.rlike(r"^\p{Nd}") | (F.length(x) > 1))
        cut = F.transform(runs, lambda x: F.when(x.rlike(r"^\p{Nd}"), F.regexp_replace(x, "[.,]", "")).otherwise(F.substring(x, 1, s.prefix_letters)))
        return F.concat(codes, cut)

    # As the variable of a function over an array of one, the folded text is made once and used twice.
    return F.flatten(F.transform(F.array(F.regexp_replace(fold(c), APOSTROPHE, "")), words))


def query_tokens(c: Column, s: Settings = DEFAULT) -> Column:
    """A question's search words, each once."""
    return F.array_distinct(search_tokens(c, s))


def turkish_lower(c: Column) -> Column:
    return F.lower(F.replace(F.replace(c, _lit("İ"), _lit("i")), _lit("I"), _lit("ı")))


#: White space as `(?U)\\s` has it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column, spaces: str = SPACES) -> Column:
    """Without white space at both ends; nothing between is looked at."""
    return F.btrim(c, _lit(spaces))


def collapse(c: Column) -> Column:
    """Runs of white space as one space. A single space is what it becomes, so only other runs are matched: replacing costs
    far more than looking."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s&&[^ ]]\s*+| \s++", " "))


def _unmarked(c: Column) -> Column:
    """Without the Markdown marks that phrases ignore."""
    return F.replace(F.replace(c, _lit("*"), _lit("")), _lit("`"), _lit(""))


def normalize(c: Column) -> Column:
    """The form in which phrases are compared: Turkish lower case, no Markdown marks, straight quotes, single spaces."""
    return collapse(F.replace(_unmarked(turkish_lower(c)), _lit("’"), _lit("'")))


def phrase_words(c: Column) -> Column:
    """The runs of letters and digits of the normalized text, in order: what a phrase's words are looked up in."""
    # What else normalizing does leaves these runs as they are.
    return _all(_unmarked(turkish_lower(c)), r"[\p{L}\p{N}]++")


def phrase_pattern(phrase: Column) -> Column:
    """A pattern that finds a normalized phrase where a word starts; its right edge is open."""
    quoted = F.concat(_lit(r"\Q"), F.replace(phrase, _lit(r"\E"), _lit(r"\E\\E\Q")), _lit(r"\E"))
    return (
        F.when(phrase.rlike(r"^\p{Nd}"), F.concat(_lit(r"(?<![\p{L}\p{N}])(?<!\p{Nd}[.,])"), quoted))
        .when(phrase.rlike(r"^[\p{L}\p{N}]"), F.concat(_lit(r"(?<![\p{L}\p{N}])"), quoted))
        .otherwise(quoted)
    )


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whether the phrase stands in the text at the start of a word; both are normalized first."""
    # As variables, the normal forms are made once and used twice.
    return F.exists(F.array(normalize(text)), lambda t: F.exists(F.array(normalize(phrase)), lambda p: contains_normalized(t, p)))


def contains_normalized(text: Column, phrase: Column) -> Column:
    """The same for sides that are normalized already. Patterns are made only where the phrase stands in the text at all, and
    nowhere after a space, which ends any word."""
    return F.when(text.startswith(phrase) | F.contains(text, F.concat(_lit(" "), phrase)), F.lit(True)).when(F.contains(text, phrase), F.regexp_like(text, phrase_pattern(phrase))).otherwise(F.when(text.isNotNull() & phrase.isNotNull(), F.lit(False)))


def overlap_words(c: Column) -> Column:
    """Distinct words of three characters or more, and numbers, in Turkish lower case."""
    return F.array_distinct(F.filter(_all(turkish_lower(c), r"[\p{L}\p{N}_]+"), lambda w: (F.length(w) > 2) | w.rlike(r"^\p{Nd}+$")))


def is_line_candidate(line: Column, s: Settings = DEFAULT) -> Column:
    """Short lines that are neither headings nor table rows can be page headers or footers."""
    t = F.trim(line)
    return (t != "") & (F.length(t) <= s.repeated_length) & ~t.rlike(r"^[#|]")


def line_key(line: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(line)), r"\p{Nd}+", "#")


def is_page_number(line: Column) -> Column:
    return line.rlike(PAGE_NUMBER)


def grouped_number(c: Column, decimals: int = 2) -> Column:
    """1234.5 as 1.234,50."""
    return F.translate(F.format_number(c, decimals), ",.", ".,")


def percent(c: Column, decimals: int = 0) -> Column:
    """0.15 as %15; the sign comes first."""
    return F.concat(F.when(c < 0, "-").otherwise(""), _lit("%"), grouped_number(F.abs(c) * 100, decimals))


def day(c: Column) -> Column:
    """A date as dd.MM.yyyy, with the time of day unless it is midnight."""
    at = c.cast("timestamp_ntz")
    return F.when(F.date_format(at, "HH:mm:ss") == "00:00:00", F.date_format(at, "dd.MM.yyyy")).otherwise(F.date_format(at, "dd.MM.yyyy HH:mm"))


def record(fields: list[tuple[str, Column]]) -> Column:
    """`Name: value | Name: value` of the filled fields; one without a name is called by its place."""
    return F.concat_ws(" | ", *(F.when(F.coalesce(v, _lit("")) != "", F.concat(_lit(f"{name or f'Column {i}'}: "), v)) for i, (name, v) in enumerate(fields, 1)))


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def round_down(c: Column) -> Column:
    """Down to one significant digit."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(c)))
    return F.when(c > 0, F.floor(c / unit) * unit).otherwise(F.lit(0.0))


def without_thoughts(c: Column) -> Column:
    """A model's reply without its <think> blocks; an unclosed one goes to the end."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""), r"(?is)<think>.*$", ""))


def rewritten(reply: Column, question: Column, extra: int = 200) -> Column:
    """A rewritten question: the reply's first line without label and quotes, or the question itself if that is empty
    or too long."""
    line = F.regexp_extract(reply, r"(?m)^\s*(\S.*?)\s*$", 1)
    line = F.regexp_replace(line, r"(?iu)^[\p{L} ]{0,40}(question|soru)\s*:\s*", "")
    line = F.trim(F.regexp_replace(line, r"""^(["'“])(.*)(["'”])$""", "$2"))
    return F.when((line == "") | (F.length(line) > F.length(question) + extra), question).otherwise(line)


def verdict(reply: Column) -> Column:
    """(verdict, reason) from the first to the last brace of a judge's reply; null if it is not usable."""
    data = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "verdict string, reason string")
    said = F.lower(F.trim(data["verdict"]))
    return F.when(said.isin("correct", "partial", "wrong"), F.struct(said.alias("verdict"), F.trim(F.coalesce(data["reason"], _lit(""))).alias("reason")))


def page_label(start: Column, end: Column) -> Column:
    return F.when(start.isNull(), _lit("")).when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start, end))


def chunk_content(text: Column) -> Column:
    """A chunk without its first line, which names source and headings."""
    return F.regexp_replace(text, r"^\[[^\n]*\]\n", "")
