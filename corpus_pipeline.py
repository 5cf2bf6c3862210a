"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir); `docs` is what the stage before has kept, read from Parquet. All stages but the
last return the columns of `documents`.

Defined results, of all stages: null text is an empty text, null ids are carried, columns beyond doc_id and text come
back as they are under whatever name, repeated rows are judged alike, and an empty table gives an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import decontaminate, packing, pii, quality, simhash
from skarn.runtime import dealt, table, written


def _free(docs: DataFrame) -> str:
    """A name for what an operator adds to the documents for a moment, which none of their columns has."""
    had = {c.lower() for c in docs.columns}
    return next(n for k in range(len(had) + 1) if (n := f"added_{k}") not in had)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, in one pass; a text of any length is scored whole, an empty
    one like any other. Without labels of both kinds all documents get the share of label 1, and 0.5 if there is none."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    score = _free(docs)
    return quality.scored(docs, model, name=score).where(F.col(score) >= 0.5).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: links verified on five-word shingles, similarity 0.8.

    Of a group the smallest doc_id stays (a null one last, ties by the hash of id and text), of repeated rows one, by the
    hash of all columns. Texts without a word are alike; a shorter text than a shingle is one shingle."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts hold none, and benchmark rows without a token
    are not searched; with an empty benchmark all documents stay."""
    leaks = _free(docs)
    return decontaminate.marked(docs, table(spark, sf_dir, "benchmark"), name=leaks).where(F.size(leaks) == 0).drop(leaks)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind; n_chars, where there is one, follows a changed
    text. A text without personal data, null included, stays as it is."""
    spans = _free(docs)
    found = pii.with_spans(docs, spans)
    redacted = F.col(f"{spans}.redacted")
    changed = redacted.isNotNull()
    new = {"text": F.when(changed, redacted).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(redacted).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumns(new).drop(spans)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens; a null or empty text is one token, and
    repeated rows are packed each."""
    return packing.packed(docs)


STAGES = [
    ("quality_classifier", quality_filter),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the learned and approximate stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`."""
    docs = dealt(table(spark, sf_dir, "documents"))
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = dealt(written(docs, name))
    return docs
