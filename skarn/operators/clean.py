"""Lines that repeat over a document's pages, and the main text of web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.functions.html import main_text
from skarn.functions.text import is_line_candidate, is_page_number, line_key, stripped
from skarn.runtime import written
from skarn.settings import DEFAULT, Settings


def page_lines(pages: DataFrame) -> DataFrame:
    """(source, number, pos, line) of pages (source, number, markdown)."""
    return pages.select("source", "number", F.posexplode(F.split("markdown", r"\r\n|\n|\r")).alias("pos", "line"))


def repeated_lines(pages: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(source, line_key, pages, least): lines that stand on enough of a source's numbered pages.

    A line counts once for each page; at least two pages are needed. Rows are counted by hashes first, where a line counts
    once for each row: lines whose hash has too few stand on too few pages, and their texts are never shuffled."""
    numbered = pages.where("number is not null")
    size = numbered.groupBy("source").agg(F.count_distinct("number").alias("n")).select("source", F.greatest(F.lit(2), F.ceil(F.col("n") * s.repeated_share)).alias("least"))
    size = written(size, "least")
    # Once for each row: the keys of a page are made and told apart where it is.
    line = F.split("markdown", r"\r\n|\n|\r")
    keys = F.array_distinct(F.transform(F.filter(line, lambda x: is_line_candidate(x, s)), line_key))
    each = numbered.select("source", "number", F.explode(keys).alias("line_key")).withColumn("h", F.xxhash64("source", "line_key"))
    often = each.groupBy("source", "h").agg(F.count("*").alias("rows")).join(size, "source").where(F.col("rows") >= F.col("least"))
    # Once they are written, hashes are known to be few: no one then shuffles lines to join them.
    often = written(often.select("h").distinct(), "often")
    lines = each.join(often, "h", "left_semi").select("source", "number", "line_key").distinct()
    return lines.groupBy("source", "line_key").agg(F.count("*").alias("pages")).join(size, "source").where(F.col("pages") >= F.col("least"))


def marked_lines(pages: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(source, number, pos, line, out): all lines, and whether they repeat or are page numbers."""
    again = written(repeated_lines(pages, s).select("source", "line_key", F.lit(True).alias("again")), "repeated")
    lines = page_lines(pages).withColumn("line_key", F.when(is_line_candidate(F.col("line"), s), line_key(F.col("line"))))
    return lines.join(again, ["source", "line_key"], "left").select("source", "number", "pos", "line", (F.coalesce("again", F.lit(False)) | is_page_number(F.col("line"))).alias("out"))


def without_repeated(pages: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(source, number, markdown, removed): pages without repeated lines and page numbers, and the lines taken out."""
    marked = marked_lines(pages, s)
    both = marked.groupBy("source", "number").agg(
        F.sort_array(F.collect_list(F.when(~F.col("out"), F.struct("pos", "line")))).alias("kept"),
        F.array_sort(F.collect_set(F.when(F.col("out"), F.trim("line")))).alias("removed"),
    )
    text = F.array_join(F.transform("kept", lambda x: x["line"]), "\n")
    return both.select("source", "number", stripped(F.regexp_replace(text, "\n{3,}", "\n\n"), " \t\n\x0b\f\r").alias("markdown"), "removed")


def with_main_text(pages: DataFrame, html: str = "html", name: str = "text", s: Settings = DEFAULT) -> DataFrame:
    """The pages with the main text of each (`functions.html.main_text`)."""
    return pages.withColumn(name, main_text(F.col(html), s))
