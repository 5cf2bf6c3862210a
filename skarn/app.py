"""The engine end to end, as the commands use it: a folder becomes an index, questions become answers and measured runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.operators import answer, catalog, chunk, clean, embedding, evaluate, index, logs, search, segments, vectors
from skarn.plugins import overlap_reranker
from skarn.settings import DEFAULT, Settings
from skarn.runtime import ship, written
from skarn.sources import config, files


def read_catalog(spark: SparkSession, path: str | None) -> DataFrame:
    """The checked catalog; without a file nothing is catalogued, so all of it is restricted."""
    if path is None:
        return spark.createDataFrame([], catalog.SCHEMA)
    with open(path, encoding="utf-8") as f:
        return catalog.checked(catalog.parsed(spark, f.read()))


def index_folder(spark: SparkSession, folder: str, path: str, labels: DataFrame, dry_run: bool = False, s: Settings = DEFAULT, parsers: dict | None = None) -> DataFrame:
    """Brings the index in step with the folder's files and returns the plan: (source, action, detail).

    Texts are read as they are, tables as records; other kinds by `parsers`. What was read once is kept beside the index by
    the file's hash, failures too, so a file is parsed once; one that cannot be read is `unreadable` with its error."""
    ship(spark)
    known = files.listed(spark, folder, s).where("status = 'supported'")
    kept = f"{path.rstrip('/')}/read"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept)
    cache = spark.read.parquet(kept) if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else None
    pages, new = files.read_cached(known, cache, s.pipeline_version, lambda some: files.read_pages(some, s, parsers))
    pages = written(pages, "pages")
    if not dry_run and not new.isEmpty():
        new.write.mode("append").parquet(kept)
    lost = pages.where("error is not null").groupBy("source").agg(F.min("error").alias("error"))
    warned = files.warnings(pages.where("error is null").withColumn("ocr", F.lit(False)), s).groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("warning")), "; ").alias("warning"))

    def build(changed: DataFrame) -> DataFrame:
        own = pages.where("error is null").join(changed.select("source"), "source", "left_semi").select("source", "number", "markdown")
        clear = clean.without_repeated(own.where("number is not null"), s).select("source", "number", "markdown")
        return chunk.chunked(own.where("number is null").unionByName(clear), s=s)

    plan = index.sync(spark, known, labels, path, build, dry_run, s, unreadable=lost)
    if not dry_run:
        _learned(spark, path)
    return plan.join(warned, "source", "left").select("source", "action", F.concat_ws("; ", F.nullif("detail", F.lit("")), "warning").alias("detail"))


def _learned(spark: SparkSession, path: str) -> None:
    """Learns vectors of the newest version, unless that was done; they lie beside it under its number."""
    found = segments.read(spark, path)
    at = f"{path.rstrip('/')}/learned-{found.version}" if found else None
    if found is None or not found.size or _stands(spark, f"{at}/cells/about"):
        return
    learned = embedding.learn(found, at)
    vectors.write(learned.documents, f"{at}/cells", found.key)


def _stands(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def indexed(spark: SparkSession, path: str) -> tuple[DataFrame, segments.Snapshot]:
    """(the chunks with the labels they were indexed under, the snapshot that is searched)."""
    found = segments.read(spark, path)
    if found is None:
        raise FileNotFoundError(f"nothing is indexed at {path}")
    return found.docs.withColumnRenamed("point_id", "doc_id").withColumn("ocr", F.lit(False)), found


def hits(questions: DataFrame, chunks: DataFrame, stored: segments.Snapshot, levels: tuple[str, ...], s: Settings = DEFAULT) -> DataFrame:
    """The best chunks of each question (question_id, text) that these levels may see, reranked, with their source's fields.

    By words and by learned vectors where this version has them, else by words alone; a blank question is refused."""
    at = f"{stored.path}/learned-{stored.version}"
    hybrid = {}
    if _stands(stored.spark, f"{at}/cells/about"):
        learned = embedding.read(stored.spark, at, stored.key)
        hybrid = {"vectors": vectors.read(stored.spark, f"{at}/cells", stored.key), "query_vectors": learned.questions(questions, s)}
    found = search.search(questions, chunks, levels, mode="hybrid" if hybrid else "sparse", reranker=overlap_reranker, s=s, stored=stored, **hybrid)
    kept = found.select("question_id", "doc_id", "rank", "score")
    return kept.join(chunks, "doc_id")


def ask(spark: SparkSession, path: str, question: str, role: str, s: Settings = DEFAULT, log: str | None = None, user: str | None = None) -> DataFrame:
    """One question answered for a role, with its citations and what could not be verified; kept in the log if there is one."""
    chunks, stored = indexed(spark, path)
    asked = spark.createDataFrame([(1, question)], "question_id int, text string")
    got = answer.with_sources(asked.withColumnRenamed("text", "question"), hits(asked, chunks, stored, s.roles[role], s))
    said = answer.answered(got, s=s)
    if log is not None:
        said = written(said, "said")
        files.append_log(logs.asked(said, role, user, s), log)
    return said


def evaluate_retrieval(spark: SparkSession, path: str, questions_toml: str, runs: str, s: Settings = DEFAULT, only: tuple[int, ...] = ()) -> str:
    """Searches every question of a set (or `only` some, all of which it must have) as its role, stores the results as a run
    and returns the run's id."""
    asked = config.questions(spark, questions_toml, s)
    if only:
        asked = asked.where(F.col("question_id").isin(*only))
        unknown = sorted(set(only) - {r["question_id"] for r in asked.select("question_id").collect()})
        if unknown:
            raise config.ConfigError(f"no question has the id {', '.join(map(str, unknown))}")
    chunks, stored = indexed(spark, path)
    roles = spark.createDataFrame([(k, list(v)) for k, v in s.roles.items()], "role string, access_levels array<string>")
    found = None
    for role in s.roles:
        own = asked.where(F.col("role") == role).select("question_id", F.col("question").alias("text"))
        part = hits(own, chunks, stored, s.roles[role], s)
        found = part if found is None else found.unionByName(part)
    n = found.groupBy("question_id").agg(F.count("*").alias("hits"))
    lost = config.against_index(asked, stored).groupBy("question_id").agg(F.collect_list("problem").alias("not_indexed"))
    leaked = evaluate.leaks(found, asked, roles).groupBy("question_id").agg(F.collect_list("leak").alias("leaks"))
    rows = asked.join(evaluate.source_rank(found, asked), "question_id").join(evaluate.missing_evidence(found, asked).select("question_id", "evidence_total", "missing"), "question_id")
    none = F.expr("cast(array() as array<string>)")
    for more in (n, lost, leaked):
        rows = rows.join(more, "question_id", "left")
    rows = rows.withColumns({"hits": F.coalesce("hits", F.lit(0)), "leaks": F.coalesce("leaks", none), "not_indexed": F.coalesce("not_indexed", none)})
    status, diagnosis = evaluate.retrieval_status({c: F.col(c) for c in rows.columns})
    run = uuid.uuid4().hex
    files.save_run(rows.withColumns({"status": status, "diagnosis": diagnosis}).select("question_id", "type", "status", "diagnosis", "source_rank", "hits", "missing", "leaks"), runs, run)
    return run
