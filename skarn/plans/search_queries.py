"""Search words, weights, keyword, vector and fused search, reranking and access."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.functions.text import query_tokens, search_tokens
from skarn.operators import search as S
from skarn.operators import segments, vectors
from skarn.operators.catalog import labelled
from skarn.plans.common import ASKED_SQL, LABELS_SQL, POSTINGS_SQL, catalog, documents, labelled_documents, questions, embedder, roles, sparse_sql, spread, stored, stored_vectors, tokens_sql
from skarn.plugins import overlap_reranker, overlap_score
from skarn.runtime import goes_with_session, shared_path, table
from skarn.settings import DEFAULT


def tokenize_documents(spark, sf_dir: str) -> DataFrame:
    t = spread(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", search_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


def term_document_frequency(spark, sf_dir: str) -> DataFrame:
    """Every term with its document frequency and rarity, as stored."""
    return stored(spark, sf_dir).rarity.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_weights(spark, sf_dir: str) -> DataFrame:
    """The stored postings."""
    return stored(spark, sf_dir).postings.select("doc_id", "term", "tf", "weight")


def index_documents(spark, sf_dir: str) -> DataFrame:
    """Indexes all documents anew and counts what is stored."""
    path = shared_path(spark, "indexed")
    index = segments.write(labelled_documents(spark, sf_dir), path)
    goes_with_session(spark, path)
    total = lambda c, zero: F.aggregate(c, zero, lambda a, x: a + x)
    sums = index.table("postings").agg(F.sum(F.size("docs")).alias("postings"), F.sum(total(F.transform("tfs", lambda x: x.cast("long")), F.lit(0).cast("long"))).alias("words"), F.round(F.sum(total("weights", F.lit(0.0))), 2).alias("weight"))
    return sums.crossJoin(index.rarity.agg(F.count("*").alias("terms"))).withColumn("texts", F.lit(index.size).cast("long"))


def _sparse(spark, sf_dir: str, levels: tuple[str, ...] | None = None, k: int = DEFAULT.prefetch) -> DataFrame:
    """The k best documents of every question, all of them or those that may be seen."""
    return segments.sparse_topk(questions(spark, sf_dir), stored(spark, sf_dir), k, levels)


def bm25_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 best current internal documents for every benchmark item as a question."""
    return _sparse(spark, sf_dir, ("internal",))


def topk_blocks(spark, sf_dir: str) -> DataFrame:
    """For the same search: blocks of postings of each question's words, and how many of them its bounds left to read."""
    return segments.sparse_topk(questions(spark, sf_dir), stored(spark, sf_dir), levels=("internal",), count=True)


def _query_vectors(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))


def dense_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every hundredth one, by exact inner product."""
    return vectors.topk(_query_vectors(spark, sf_dir), stored_vectors(spark, sf_dir))


def dense_cells(spark, sf_dir: str) -> DataFrame:
    """For the same search: how many cells and vectors there are, and how many its bounds left to read."""
    return vectors.topk(_query_vectors(spark, sf_dir), stored_vectors(spark, sf_dir), count=True)


def search_hybrid(spark, sf_dir: str) -> DataFrame:
    """The whole search by words and by learned vectors: candidates that may be seen, fused, reranked, cut at five."""
    learned, cells = embedder(spark, sf_dir)
    docs, asked = labelled_documents(spark, sf_dir), questions(spark, sf_dir)
    found = S.search(asked, docs, ("internal",), "hybrid", cells, learned.questions(asked), overlap_reranker, stored=stored(spark, sf_dir))
    return found.select("question_id", "doc_id", "score", "rank", "old_rank")


def learned_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 documents nearest to every question by learned vectors alone, that may be seen."""
    learned, cells = embedder(spark, sf_dir)
    return vectors.topk(learned.questions(questions(spark, sf_dir)), cells, levels=("internal",))


def hybrid_rrf(spark, sf_dir: str) -> DataFrame:
    """Keyword and vector legs fused by rank; vector i stands for document i and for question i."""
    asked = questions(spark, sf_dir).select("question_id").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector")), "question_id")
    dense = vectors.topk(asked, stored_vectors(spark, sf_dir), levels=("internal",)).withColumnRenamed("vec_id", "doc_id")
    return S.fused([_sparse(spark, sf_dir, ("internal",)), dense], DEFAULT.prefetch)


def search_access_filtered(spark, sf_dir: str) -> DataFrame:
    """What each role finds, and how much of it is restricted: roles that see the same are searched for at once."""
    found = None
    for levels in dict.fromkeys(DEFAULT.roles.values()):
        who = F.broadcast(roles(spark).where(F.col("access_levels") == F.array(*map(F.lit, levels))).select("role"))
        part = _sparse(spark, sf_dir, levels).crossJoin(who)
        found = part if found is None else found.unionByName(part)
    hits = found.join(stored(spark, sf_dir).docs.select("doc_id", "access_level"), "doc_id")
    return hits.groupBy("role", "question_id").agg(F.count("*").alias("hits"), F.count_if(F.col("access_level") == "restricted").alias("restricted"))


def overlap_hits(spark, sf_dir: str) -> DataFrame:
    """The 20 candidates of every question with their word overlap, from the stored words: no text is read."""
    asked = questions(spark, sf_dir).select("question_id", query_tokens(F.col("text")).alias("asked"))
    both = _sparse(spark, sf_dir).join(stored(spark, sf_dir).docs.select("doc_id", "words"), "doc_id").join(asked, "question_id")
    return both.withColumn("overlap", overlap_score(F.col("asked"), F.col("words"))).drop("asked", "words")


def rerank_threshold_topk(spark, sf_dir: str) -> DataFrame:
    """20 candidates, scored anew by word overlap; those under 0.3 go, the best 5 stay."""
    return S.reranked(overlap_hits(spark, sf_dir), F.col("overlap"), 5, 0.3).select("question_id", "doc_id", "score", "rank", "old_rank")


def leak_check(spark, sf_dir: str) -> DataFrame:
    """Hits of the least role that it may not see: none, counted."""
    hits = _sparse(spark, sf_dir, ("internal",))
    both = hits.join(labelled(documents(spark, sf_dir).select("doc_id", "source"), catalog(spark)).select("doc_id", "access_level"), "doc_id")
    return both.agg(F.count("*").alias("hits"), F.count_if(F.col("access_level") != "internal").alias("leaks"))


_VISIBLE = "access_level = 'internal' AND status = 'active'"
_CURRENT = "status = 'active'"
_DENSE = "list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"

QUERIES = {f.__name__: f for f in (tokenize_documents, term_document_frequency, bm25_weights, index_documents, bm25_topk, topk_blocks, dense_topk, dense_cells, learned_topk, search_hybrid, hybrid_rrf, search_access_filtered, rerank_threshold_topk, leak_check)}

ORACLES = {
    "tokenize_documents": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)",
    "term_document_frequency": f"WITH {POSTINGS_SQL} SELECT term, df, round(idf, 6) AS idf FROM rarity",
    "bm25_weights": f"WITH {POSTINGS_SQL} SELECT doc_id, term, tf, weight FROM weighted",
    "index_documents": f"WITH {POSTINGS_SQL} SELECT count(*) AS postings, CAST(sum(tf) AS BIGINT) AS words, round(sum(weight), 2) AS weight, (SELECT count(*) FROM rarity) AS terms, (SELECT count(*) FROM documents) AS texts FROM weighted",
    "bm25_topk": f"WITH {LABELS_SQL}, {POSTINGS_SQL}, {ASKED_SQL}, {sparse_sql(_VISIBLE)} SELECT question_id, doc_id, score, rank FROM sparse",
    "dense_topk": f"""SELECT * FROM (SELECT question_id, vec_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS rank
  FROM (SELECT q.vec_id AS question_id, e.vec_id, round({_DENSE.format(a="e.embedding", b="q.embedding")}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE rank <= 20""",
    "hybrid_rrf": f"""WITH {LABELS_SQL}, {POSTINGS_SQL}, {ASKED_SQL}, {sparse_sql(_VISIBLE)},
dense AS (SELECT * FROM (SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT b.item_id AS question_id, e.vec_id AS doc_id, round({_DENSE.format(a="e.embedding", b="q.embedding")}, 6) AS score
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings e WHERE e.vec_id IN (SELECT doc_id FROM labelled WHERE {_VISIBLE}))) WHERE rank <= 20)
SELECT * FROM (SELECT question_id, doc_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT question_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT question_id, doc_id, rank FROM sparse UNION ALL SELECT question_id, doc_id, rank FROM dense) GROUP BY question_id, doc_id)) WHERE rank <= 20""",
    "search_access_filtered": f"WITH {LABELS_SQL}, {POSTINGS_SQL}, {ASKED_SQL}, {sparse_sql(_VISIBLE, name='low')}, {sparse_sql(_CURRENT, name='high')}"
    + " UNION ALL ".join(f" SELECT '{r}' AS role, question_id, count(*) AS hits, count(*) FILTER (WHERE access_level = 'restricted') AS restricted FROM {'high' if 'restricted' in v else 'low'} JOIN labelled USING (doc_id) GROUP BY question_id" for r, v in DEFAULT.roles.items()),
    "rerank_threshold_topk": f"""WITH {POSTINGS_SQL}, {ASKED_SQL}, {sparse_sql()},
q AS (SELECT item_id AS question_id, list_distinct({tokens_sql("text")}) AS words FROM benchmark),
scored AS (SELECT question_id, doc_id, rank AS old_rank, CASE WHEN len(words) > 0 THEN round(len(list_intersect(words, t)) / len(words), 6) ELSE 0 END AS score FROM sparse JOIN q USING (question_id) JOIN toks USING (doc_id))
SELECT * FROM (SELECT question_id, doc_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, old_rank) AS rank, old_rank FROM scored WHERE score >= 0.3) WHERE rank <= 5""",
    "leak_check": f"WITH {LABELS_SQL}, {POSTINGS_SQL}, {ASKED_SQL}, {sparse_sql(_VISIBLE)} SELECT count(*) AS hits, count(*) FILTER (WHERE access_level <> 'internal') AS leaks FROM sparse JOIN labelled USING (doc_id)",
}
