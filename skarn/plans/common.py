"""Frames and SQL that several plans share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.operators import embedding, segments, vectors
from skarn.operators.catalog import labelled
from skarn.runtime import goes_with_session, parallelism, shared_path, table
from skarn.settings import DEFAULT

#: Labels of the sources of `documents`: src19 is not catalogued, src4 was replaced by src5, four are restricted.
CATALOG = [(f"src{i}", "restricted" if i < 4 else "internal", "superseded" if i == 4 else "active", "2024-05-01" if i % 2 else None, "src5" if i == 4 else None) for i in range(19)]
CATALOG_SQL = "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in row) + ")" for row in CATALOG) + ") AS c(file, access_level, status, effective_date, replaced_by)"
LABELS_SQL = f"""labelled AS (
  SELECT d.*, coalesce(c.access_level, 'restricted') AS access_level, coalesce(c.status, 'active') AS status, c.replaced_by, c.effective_date, c.file IS NOT NULL AS catalogued
  FROM documents d LEFT JOIN {CATALOG_SQL} ON d.source = c.file)"""


def catalog(spark: SparkSession) -> DataFrame:
    """The nineteen rows, marked as small: Spark knows no size of local rows and would shuffle the texts by source."""
    return F.broadcast(_catalog(spark))


def _catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG, "file string, access_level string, status string, effective_date string, replaced_by string").withColumn("effective_date", F.to_date("effective_date"))


def roles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, list(v)) for k, v in DEFAULT.roles.items()], "role string, access_levels array<string>")


def spread(df: DataFrame) -> DataFrame:
    """Deals a few input partitions out to all cores before costly text work: a file of one row group is read by one
    task however many splits it has. Inputs of many partitions stay as they are."""
    wanted = parallelism(df.sparkSession)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < 4 * wanted else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


_STORED: dict[tuple[str, str], str] = {}


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(documents(spark, sf_dir).select("doc_id", "text", "source"), catalog(spark))


def stored(spark: SparkSession, sf_dir: str) -> segments.Snapshot:
    """The search index of `documents` with their labels, which the first search of a session writes."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _STORED:
        path = shared_path(spark, "index")
        segments.write(labelled_documents(spark, sf_dir), path)
        goes_with_session(spark, path)
        _STORED[at] = path
    return segments.read(spark, _STORED[at])


def stored_vectors(spark: SparkSession, sf_dir: str) -> vectors.Cells:
    """The vectors in cells, with the labels of document i at vector i; written by the first search of a session."""
    at = (spark.sparkContext.applicationId, f"{sf_dir}/vectors")
    if at not in _STORED:
        path = shared_path(spark, "vectors")
        labels = labelled(documents(spark, sf_dir).select("doc_id", "source"), catalog(spark)).select(F.col("doc_id").alias("vec_id"), "access_level", "status")
        vectors.write(table(spark, sf_dir, "embeddings").join(labels, "vec_id", "left"), path)
        goes_with_session(spark, path)
        _STORED[at] = path
    return vectors.read(spark, _STORED[at])


def embedder(spark: SparkSession, sf_dir: str) -> tuple[embedding.Embedder, vectors.Cells]:
    """What is learned from `documents`, and their vectors in cells; made by the first search of a session."""
    at = (spark.sparkContext.applicationId, f"{sf_dir}/embedder")
    if at not in _LEARNED:
        path = shared_path(spark, "embedder")
        learned = embedding.learn(stored(spark, sf_dir), path)
        vectors.write(learned.documents, f"{path}/cells", "doc_id")
        goes_with_session(spark, path)
        _LEARNED[at] = learned
    learned = _LEARNED[at]
    return learned, vectors.read(spark, f"{learned.path}/cells", "doc_id")


_LEARNED: dict[tuple[str, str], embedding.Embedder] = {}


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items of `benchmark` as questions."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")


def tokens_sql(text: str) -> str:
    """A list of the search words of a text, in DuckDB."""
    plain = f"regexp_replace(translate(lower(replace({text}, 'İ', 'i')), 'çğıöşüâîû', 'cgiosuaiu'), '[''’][\\p{{L}}\\p{{N}}_]+', '', 'g')"
    codes = f"list_transform(list_filter(regexp_extract_all({plain}, '[\\p{{L}}\\p{{N}}]+(?:[-_/][\\p{{L}}\\p{{N}}]+)+'), lambda x: regexp_matches(x, '\\p{{Nd}}')), lambda x: regexp_replace(x, '[-_/]', '', 'g'))"
    runs = f"list_filter(regexp_extract_all({plain}, '\\p{{Nd}}+(?:[.,]\\p{{Nd}}+)*|[\\p{{L}}\\p{{Nl}}\\p{{No}}]+'), lambda x: regexp_matches(x, '^\\p{{Nd}}') OR length(x) > 1)"
    return f"list_concat({codes}, list_transform({runs}, lambda x: CASE WHEN regexp_matches(x, '^\\p{{Nd}}') THEN regexp_replace(x, '[.,]', '', 'g') ELSE substr(x, 1, 5) END))"


POSTINGS_SQL = f"""toks AS (SELECT doc_id, {tokens_sql("text")} AS t FROM documents),
postings AS (SELECT doc_id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM toks) GROUP BY doc_id, term),
weighted AS (SELECT doc_id, term, tf, round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / 60.0)), 4) AS weight FROM postings),
rarity AS (SELECT term, count(*) AS df, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings GROUP BY term)"""
ASKED_SQL = f"asked AS (SELECT question_id, term, idf FROM (SELECT item_id AS question_id, unnest(list_distinct({tokens_sql('text')})) AS term FROM benchmark) JOIN rarity USING (term))"


def sparse_sql(allowed: str = "", k: int = 20, name: str = "sparse") -> str:
    """Common table expressions that end in the ranked keyword hits (question_id, doc_id, score, rank)."""
    where = f"WHERE doc_id IN (SELECT doc_id FROM labelled WHERE {allowed})" if allowed else ""
    return f"""{name} AS (SELECT * FROM (SELECT question_id, doc_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT question_id, doc_id, round(sum(idf * weight), 6) AS score FROM weighted JOIN asked USING (term) {where} GROUP BY question_id, doc_id)) WHERE rank <= {k})"""
