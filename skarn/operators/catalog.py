"""Document labels: reading and checking the catalog, and joining it to chunks."""

from __future__ import annotations

import datetime
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.settings import DEFAULT, Settings

SCHEMA = "file string, access_level string, status string, effective_date date, replaced_by string"
RAW = "entry int, file string, access_level string, status string, effective_date string, date_kind string, replaced_by string, fields array<string>"
# The fields of an entry.
FIELDS = ("file", "access_level", "status", "effective_date", "replaced_by")


class CatalogError(ValueError):
    """The catalog breaks a rule."""


def parsed(spark: SparkSession, text: str) -> DataFrame:
    """The entries of a catalog in TOML as they are written, one row each."""
    try:
        entries = tomllib.loads(text).get("document", [])
    except tomllib.TOMLDecodeError as e:
        raise CatalogError(f"not valid TOML: {e}") from e
    if not isinstance(entries, list):
        raise CatalogError("entries stand under [[document]]")
    say = lambda x: None if x is None else str(x)
    rows = [(i, say(e.get("file")), say(e.get("access_level")), say(e.get("status", "active")), say(e.get("effective_date")), type(e.get("effective_date")).__name__ if "effective_date" in e else None, say(e.get("replaced_by")), sorted(e)) for i, e in enumerate(entries, 1)]
    return spark.createDataFrame(rows, RAW)


def violations(raw: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(entry, file, rule) for every broken rule of every entry; an empty frame for a sound catalog."""
    names = raw.select(F.col("file").alias("name")).where("name <> ''").distinct()
    known = F.array(*map(F.lit, FIELDS))
    rules = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("file"), F.lit("")) == "", "no file"),
            F.when(F.size(F.array_except("fields", known)) > 0, "unknown field"),
            F.when(~F.coalesce(F.col("access_level"), F.lit("")).isin(*s.access_levels), "access level"),
            F.when(~F.coalesce(F.col("status"), F.lit("")).isin(*s.statuses), "status"),
            F.when(F.col("date_kind") != "date", "date"),
            F.when((F.col("status") == "superseded") != F.col("replaced_by").isNotNull(), "superseded without replacement or the reverse"),
        )
    )
    own = raw.select("entry", "file", F.explode(rules).alias("rule"))
    twice = raw.where("file <> ''").withColumn("n", F.expr("count(1) over (partition by file)")).where("n > 1").select("entry", "file", F.lit("listed more than once").alias("rule"))
    dangling = raw.where("replaced_by is not null").join(names, F.col("replaced_by") == F.col("name"), "left_anti").select("entry", "file", F.lit("replacement is not listed").alias("rule"))
    return own.unionByName(twice).unionByName(dangling)


def checked(raw: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The typed catalog, or CatalogError with all that is wrong."""
    wrong = violations(raw, s).orderBy("entry", "rule").limit(100).collect()
    if wrong:
        raise CatalogError("; ".join(f"entry {r.entry} ({r.file}): {r.rule}" for r in wrong))
    return raw.select("file", "access_level", "status", F.col("effective_date").cast("date"), "replaced_by")


def labelled(rows: DataFrame, catalog: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds the labels of `source`; what nobody has labelled is restricted and active."""
    labels = catalog.select(F.col("file").alias("source"), "access_level", "status", "effective_date", "replaced_by")
    joined = rows.join(labels, "source", "left")
    return joined.withColumn("catalogued", F.col("access_level").isNotNull()).withColumns({"access_level": F.coalesce("access_level", F.lit(s.default_access)), "status": F.coalesce("status", F.lit("active"))})


def missing_files(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """Catalog entries whose file is not there."""
    return catalog.select("file").join(files.select("file"), "file", "left_anti")


def with_ocr(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds whether a chunk's page range holds a page read by OCR; no range, no page.

    Pages are bits of a number for each 64 of a source, and so are the pages of a range: the two meet by equal blocks, so
    that no source comes together in one row and no range is compared with pages outside its blocks."""
    block = lambda c: F.floor(c / 64).cast("long")
    bit = lambda c: F.pmod(c, F.lit(64)).cast("int")
    all_, number = F.lit(-1).cast("long"), F.col("number")
    read = pages.where("ocr and number is not null").groupBy("source", block(number).alias("block")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(number))).alias("read"))
    first, last = F.col("page_start"), F.col("page_end")
    ranges = chunks.where(first <= last).select("source", first, last).distinct().withColumn("block", F.explode(F.sequence(block(first), block(last))))
    above = F.when(F.col("block") == block(first), F.call_function("shiftleft", all_, bit(first))).otherwise(all_)
    below = F.when(F.col("block") == block(last), F.call_function("shiftrightunsigned", all_, 63 - bit(last))).otherwise(all_)
    mark = "ocr" + "_" * max(map(len, chunks.columns))  # A name that no column has.
    found = ranges.join(read, ["source", "block"]).where(F.col("read").bitwiseAND(above).bitwiseAND(below) != 0).select("source", "page_start", "page_end", F.lit(True).alias(mark)).distinct()
    return chunks.join(found, ["source", "page_start", "page_end"], "left").select(*(chunks.columns), F.coalesce(mark, F.lit(False)).alias("ocr"))


def entry_text(file: str, access_level: str, status: str = "active", effective_date: datetime.date | None = None, replaced_by: str | None = None) -> str:
    """An entry in TOML."""
    import json

    lines = ["[[document]]", f"file = {json.dumps(file, ensure_ascii=False)}", f'access_level = "{access_level}"', f'status = "{status}"']
    if effective_date:
        lines.append(f"effective_date = {effective_date.isoformat()}")
    if replaced_by:
        lines.append(f"replaced_by = {json.dumps(replaced_by, ensure_ascii=False)}")
    return "\n".join(lines) + "\n"
