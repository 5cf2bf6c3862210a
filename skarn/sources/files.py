"""Folders of documents, delimited text, logs, and stored results as DataFrames."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.html import main_text
from skarn.operators.logs import SCHEMA as LOG_SCHEMA
from skarn.operators.tabular import TabularError, cells_of_files, decoded, grid_markdown
from skarn.runtime import ship, written
from skarn.settings import DEFAULT, Settings


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def support(name: Column, s: Settings = DEFAULT) -> Column:
    """`supported`, or why a file is skipped."""
    kind = suffix(name)
    return F.when(kind.isin(*s.suffixes), "supported").when(kind.isin(*s.legacy_suffixes), F.concat(F.lit("old format ."), kind, F.lit(": save it anew"))).otherwise(F.concat(F.lit("unsupported format ."), kind))


def listed(spark: SparkSession, folder: str, s: Settings = DEFAULT) -> DataFrame:
    """(source, content, file_hash, status) of a folder's files, lock files and system files left out."""
    files = spark.read.format("binaryFile").load(folder).withColumn("source", F.element_at(F.split("path", "/"), -1))
    ignored = F.lower("source").isin(*s.ignored_names)
    for p in s.ignored_prefixes:
        ignored = ignored | F.col("source").startswith(p)
    return files.where(~ignored).select("source", "content", F.sha2("content", 256).alias("file_hash"), support(F.col("source"), s).alias("status"))


def read_text_pages(files: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(source, number, markdown, error) of text, Markdown and HTML files (source, content); one page without number.

    A file that cannot be read gives a row with its error, so that it does not stop the others."""
    ship(files.sparkSession)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for source, content in zip(pdf["source"], pdf["content"], strict=True):
                try:
                    rows.append((source, None, decoded(bytes(content)), None))
                except TabularError as e:
                    rows.append((source, None, "", str(e)))
            yield pd.DataFrame(rows, columns=["source", "number", "markdown", "error"]).astype({"number": "Int32"})

    read = files.select("source", "content").mapInPandas(run, "source string, number int, markdown string, error string")
    web = suffix(F.col("source")).isin("html", "htm")
    return read.withColumn("markdown", F.when(web, main_text(F.when(web, F.col("markdown")), s)).otherwise(F.col("markdown")))


def read_pages(files: DataFrame, s: Settings = DEFAULT, parsers: dict | None = None) -> DataFrame:
    """(source, number, markdown, error) of files of any supported kind: texts, tables as records (a sheet a page), and what
    `parsers` read (suffix -> function of files that gives such rows). A kind that no one reads gives an error row."""
    kind, parsers = suffix(F.col("source")), parsers or {}
    own = files.where(kind.isin("csv", "xlsx"))
    cells = cells_of_files(own)
    broken = cells.where("error is not null").select("source", F.lit(None).cast("int").alias("number"), F.lit("").alias("markdown"), "error")
    sheets = cells.where("error is null")
    number = F.nullif(F.regexp_extract("table", r"#(\d+)$", 1), F.lit("")).cast("int")
    tables = grid_markdown(sheets).join(sheets.select("table", "source").distinct(), "table").select("source", number.alias("number"), "markdown", F.lit(None).cast("string").alias("error"))
    out = read_text_pages(files.where(kind.isin("txt", "md", "html", "htm")), s).unionByName(broken).unionByName(tables)
    for k, parse in parsers.items():
        out = out.unionByName(parse(files.where(kind == k)).select("source", "number", "markdown", "error"))
    read = ("csv", "xlsx", "txt", "md", "html", "htm", *parsers)
    return out.unionByName(files.where(~kind.isin(*read)).select("source", F.lit(None).cast("int").alias("number"), F.lit("").alias("markdown"), F.concat(F.lit("no parser for ."), kind).alias("error")))


def read_cached(files: DataFrame, cache: DataFrame | None, version: int, parse) -> tuple[DataFrame, DataFrame]:
    """(pages of all files, pages that the cache lacked): files whose (hash, version) the cache has are not parsed.

    parse(files) gives (source, number, markdown, error); cache rows also have file_hash and version."""
    if cache is None:
        new = written(parse(files).join(files.select("source", "file_hash"), "source").withColumn("version", F.lit(version)), "parsed")
        return new, new
    known = cache.where(F.col("version") == version)
    keys = files.select("source", "file_hash")
    misses = files.join(known.select("file_hash").distinct(), "file_hash", "left_anti")
    new = written(parse(misses).join(keys, "source").withColumn("version", F.lit(version)), "parsed")
    hits = keys.join(known.drop("source"), "file_hash").select(*new.columns)
    return hits.unionByName(new), new


def warnings(pages: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(source, warning): documents of hardly any text, and how many pages came from OCR (column ocr)."""
    total = pages.groupBy("source").agg(F.sum(F.length(F.coalesce("markdown", F.lit("")))).alias("chars"), F.count_if("ocr").alias("ocr_pages"))
    found = F.array_compact(F.array(F.when(F.col("chars") < s.min_document_chars, F.lit("hardly any text")), F.when(F.col("ocr_pages") > 0, F.concat(F.col("ocr_pages").cast("string"), F.lit(" pages read by OCR")))))
    return total.select("source", F.explode(found).alias("warning"))


def needs_ocr(text_layer: Column, s: Settings = DEFAULT) -> Column:
    return F.length(F.trim(F.coalesce(text_layer, F.lit("")))) < s.ocr_min_chars


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_log(spark: SparkSession, path: str, month: str | None = None) -> DataFrame:
    """Log rows of batches that are committed, and of files that others have put there; blank and broken lines are left out."""
    rows = spark.read.schema(f"{LOG_SCHEMA}, month string, _attempt string, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    rows = rows.where("_broken is null and time is not null").drop("_broken")
    rows = rows.where(F.col("month") == month) if month else rows
    marks, fs = _at(spark, f"{path.rstrip('/')}/_batches")
    other = rows.where("_attempt is null")
    if fs.exists(marks):
        other = other.unionByName(rows.join(spark.read.text(marks.toString()).select(F.col("value").alias("_attempt")), "_attempt", "left_semi"))
    return other.drop("_attempt")


def append_log(rows: DataFrame, path: str, batch: str | None = None) -> bool:
    """Adds a batch of rows once. Rows carry the attempt that wrote them, and a marker under the batch's id, put in place by
    a rename, says which attempt counts: one that was killed half-way leaves nothing that is read, and a batch that is
    sent again adds nothing. Returns whether it was added."""
    spark, attempt = rows.sparkSession, uuid.uuid4().hex
    mark, fs = _at(spark, f"{path.rstrip('/')}/_batches/{batch or attempt}")
    if fs.exists(mark):
        return False
    rows.withColumns({"month": F.date_format("time", "yyyy-MM"), "_attempt": F.lit(attempt)}).write.mode("append").partitionBy("month").json(path)
    aside, _ = _at(spark, f"{path.rstrip('/')}/_batches/_{attempt}")
    out = fs.create(aside, False)
    out.write(bytearray(attempt.encode()))
    out.close()
    if fs.exists(mark) or not fs.rename(aside, mark):
        fs.delete(aside, False)
        return False
    return True


def save_run(results: DataFrame, path: str, run_id: str) -> None:
    """Stores a run's results; a run that exists is never overwritten."""
    results.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/run_id={run_id}")


def newest_runs(spark: SparkSession, path: str, n: int = 2) -> list[str]:
    """The ids of the last runs, by their files' times."""
    rows = spark.read.parquet(path).select("run_id", F.col("_metadata.file_modification_time").alias("at"))
    return [r.run_id for r in rows.groupBy("run_id").agg(F.max("at").alias("at")).orderBy(F.desc("at"), F.desc("run_id")).limit(n).collect()]


def inspection_text(pages: DataFrame) -> DataFrame:
    """(value): one line for each page, for a dump that people read; write it with `.write.text`."""
    head = F.concat(F.lit("=== "), "source", F.coalesce(F.concat(F.lit(" p. "), F.col("number").cast("string")), F.lit("")), F.lit(" ==="))
    return pages.select(F.concat_ws("\n", head, "markdown").alias("value"))
