"""Fingerprints, and keeping a stored index in step with a folder of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.operators import segments
from skarn.operators.catalog import labelled
from skarn.runtime import written
from skarn.settings import DEFAULT, Settings


class SyncError(RuntimeError):
    """A sync would do harm."""


def signature(s: Settings = DEFAULT, model: str = "none") -> str:
    """All settings that change what is stored."""
    return f"{model}|{s.chunk_tokens}|{s.chunk_overlap}|v{s.pipeline_version}|k1={s.bm25_k1}|b={s.bm25_b}|avg={s.bm25_average:g}|prefix={s.prefix_letters}"


def fingerprint(file_hash: Column, s: Settings = DEFAULT, model: str = "none") -> Column:
    """A hash of the file's hash, the settings and the labels (access_level, status, effective_date, replaced_by)."""
    none = F.lit("None")
    labels = (F.col("access_level"), F.col("status"), F.coalesce(F.col("effective_date").cast("string"), none), F.coalesce("replaced_by", none))
    return F.sha2(F.concat_ws("|", file_hash, F.lit(signature(s, model)), *labels).cast("binary"), 256)


def point_id(fp: Column, chunk: Column) -> Column:
    """The same fingerprint and chunk always give the same id."""
    return F.sha2(F.concat_ws("/", fp, chunk.cast("string")).cast("binary"), 256)


def fingerprints(files: DataFrame, catalog: DataFrame, s: Settings = DEFAULT, model: str = "none") -> DataFrame:
    """(source, fingerprint, catalogued) of files (source, file_hash)."""
    return labelled(files, catalog, s).select("source", fingerprint(F.col("file_hash"), s, model).alias("fingerprint"), "catalogued")


def stored_fingerprints(index: DataFrame) -> DataFrame:
    return index.groupBy("source").agg(F.sort_array(F.collect_set("fingerprint")).alias("stored"))


def sync_plan(current: DataFrame, stored: DataFrame, dry_run: bool = False) -> DataFrame:
    """(source, action, detail): what a sync does with each source.

    Unchanged means that the stored fingerprints are exactly the current one, so a half-finished write is repaired."""
    index, remove = ("would index", "would remove") if dry_run else ("index", "remove")
    both = current.join(stored, "source", "full_outer")
    action = F.when(F.col("fingerprint").isNull(), remove).when(F.coalesce(F.col("stored") == F.array("fingerprint"), F.lit(False)), "unchanged").otherwise(index)
    return both.select("source", action.alias("action"), F.when(~F.coalesce("catalogued", F.lit(True)), "not in the catalog, restricted").otherwise("").alias("detail"))


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The indexed rows, or None before the first sync."""
    found = segments.read(spark, path)
    return found.docs.drop("shard", "place", "words") if found else None


def sync(spark: SparkSession, files: DataFrame, catalog: DataFrame, path: str, build, dry_run: bool = False, s: Settings = DEFAULT, model: str = "none", unreadable: DataFrame | None = None) -> DataFrame:
    """Brings the index at `path` in step with files (source, file_hash, ...).

    build(changed files) gives their rows (source, chunk_index, text, ...). They are written as one segment that also
    deletes the old rows of changed and removed files, and the new version is put in place at the end: a crash leaves the
    index as it was, files that did not change are not written again, and an open reader keeps what it reads. Without any
    file nothing is touched. unreadable: (source, error) of files that could not be read; what is indexed of them stays.
    Returns the plan that was carried out."""
    if files.isEmpty():
        raise SyncError("no readable document: nothing was indexed or removed")
    labels = labelled(files.select("source", "file_hash"), catalog, s).withColumn("fingerprint", fingerprint(F.col("file_hash"), s, model)).drop("file_hash")
    old = segments.read(spark, path)
    stored = stored_fingerprints(old.docs) if old else spark.createDataFrame([], "source string, stored array<string>")
    plan = sync_plan(labels.select("source", "fingerprint", "catalogued"), stored, dry_run)
    if unreadable is not None:
        plan = plan.join(unreadable, "source", "left").select("source", F.when(F.col("error").isNull(), F.col("action")).otherwise("unreadable").alias("action"), F.coalesce("error", "detail").alias("detail"))
    plan = written(plan, "plan")
    stale = plan.where("action in ('index', 'remove')").select("source")
    if dry_run or stale.isEmpty():
        return plan
    changed = plan.where("action = 'index'").select("source")
    rows = build(files.join(changed, "source", "left_semi")).join(labels.drop("catalogued"), "source")
    rows = written(rows.withColumn("point_id", point_id(F.col("fingerprint"), F.col("chunk_index"))), "rows")
    gone = old.docs.join(stale, "source", "left_semi").select("shard", "place") if old else None
    segments.add(spark, path, rows, gone, "point_id", s)
    return plan
