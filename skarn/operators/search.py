"""Keyword, vector and fused search for many questions at once.

The access filter is applied in here, to every leg and before any ranking; callers cannot leave it out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.text import query_tokens, search_tokens
from skarn.operators import segments
from skarn.operators.vectors import Cells
from skarn.operators.vectors import topk as nearest_topk
from skarn.settings import DEFAULT, Settings

#: Rows of a question or query-vector table that are broadcast at once; more go in blocks.
BLOCK_ROWS = 20_000


def counted(tokens: DataFrame, words: str, key: str = "doc_id") -> DataFrame:
    """(key, term, tf, length): how often each word stands in the array `words`."""
    # explode would put a filter on the size of the array, and with it the tokens, before itself a second time.
    each = tokens.select(key, F.size(words).alias("length"), F.explode_outer(words).alias("term")).where("term is not null")
    return each.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def postings(docs: DataFrame, s: Settings = DEFAULT, key: str = "doc_id") -> DataFrame:
    """(key, term, tf, length): the counts of every search word of every text."""
    return counted(docs.select(key, search_tokens(F.col("text"), s).alias("t")), "t", key)


def weights(post: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds the stored BM25 weight, four decimals, without the rarity of the word; the average length is a setting."""
    norm = s.bm25_k1 * (1 - s.bm25_b + s.bm25_b * F.col("length") / s.bm25_average)
    return post.withColumn("weight", F.round(F.col("tf") * F.lit(round((s.bm25_k1 + 1) * 1e6)) / 1e6 / (F.col("tf") + norm), 4))


def idf(post: DataFrame, docs: Column | int) -> DataFrame:
    """(term, df, idf) over the whole collection; never negative."""
    found = post.groupBy("term").agg(F.count("*").alias("df"))
    n = F.lit(docs) if isinstance(docs, int) else docs
    return found.withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def visible(rows: DataFrame, levels: tuple[str, ...], superseded: bool = False) -> DataFrame:
    """Rows that a reader with these access levels may see: none without levels, and only current ones by default."""
    if not levels:
        return rows.where(F.lit(False))
    allowed = rows.where(F.col("access_level").isin(*levels))
    return allowed if superseded else allowed.where(F.col("status") == "active")


def top(scored: DataFrame, k: int, key: str = "doc_id", question: str = "question_id", score: str = "score") -> DataFrame:
    """The k best of each question with their rank; equal scores go by key."""
    ranked = scored.withColumn("rank", F.expr(f"row_number() over (partition by {question} order by {score} desc, {key})"))
    return ranked.where(F.col("rank") <= k)


def sparse_topk(questions: DataFrame, weighted: DataFrame, rarity: DataFrame, k: int = DEFAULT.prefetch, allowed: DataFrame | None = None, key: str = "doc_id", s: Settings = DEFAULT) -> DataFrame:
    """(question_id, key, score, rank) over words that are not stored: all of them joined on those of the questions.

    allowed: the keys that may be found at all. What is stored is searched by `segments.sparse_topk`."""
    asked = questions.select("question_id", F.explode(query_tokens(F.col("text"), s)).alias("term")).join(rarity.select("term", "idf"), "term")
    scored = weighted.select(key, "term", "weight").join(asked, "term").groupBy("question_id", key).agg(F.round(F.sum(F.col("idf") * F.col("weight")), 6).alias("score"))
    return top(scored if allowed is None else scored.join(allowed.select(key), key, "left_semi"), k, key)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = DEFAULT.prefetch, key: str = "vec_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(question_id, key, score, rank) of query vectors (question_id, vector) against unit vectors (key, embedding).

    The queries are broadcast in blocks of bounded size; the vectors are never shuffled, only the best rows are."""
    n = queries.count()
    blocks = max(1, -(-n // block_rows))
    found = None
    for b in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == b)
        part = vectors.select(key, "embedding").crossJoin(F.broadcast(own)).select("question_id", key, F.round(inner_product(F.col("embedding"), F.col("vector")), 6).alias("score"))
        part = top(part, k, key)
        found = part if found is None else found.unionByName(part)
    return found


def fused(legs: list[DataFrame], k: int, key: str = "doc_id", s: Settings = DEFAULT) -> DataFrame:
    """Reciprocal rank fusion of ranked legs (question_id, key, rank)."""
    both = legs[0].select("question_id", key, "rank")
    for leg in legs[1:]:
        both = both.unionByName(leg.select("question_id", key, "rank"))
    scored = both.groupBy("question_id", key).agg(F.round(F.sum(1.0 / (s.rrf_k + F.col("rank"))), 9).alias("score"))
    return top(scored, k, key)


def reranked(hits: DataFrame, score: Column, k: int = DEFAULT.top_k, least: float = DEFAULT.min_score) -> DataFrame:
    """Hits scored anew: those below the threshold go first, then the k best stay; equal scores keep the old order."""
    new = hits.withColumn("old_rank", F.col("rank")).withColumn("score", F.round(score, 6)).where(F.col("score") >= least)
    return new.withColumn("rank", F.expr("row_number() over (partition by question_id order by score desc, old_rank)")).where(F.col("rank") <= k)


def search(
    questions: DataFrame,
    index: DataFrame,
    levels: tuple[str, ...],
    mode: str = "hybrid",
    vectors: DataFrame | Cells | None = None,
    query_vectors: DataFrame | None = None,
    reranker=None,
    superseded: bool = False,
    k: int | None = None,
    s: Settings = DEFAULT,
    stored=None,
) -> DataFrame:
    """Candidates, optional reranking, threshold and top k in one plan.

    stored: the snapshot that `segments.read` gives, whose bitmaps hold the labels; without it the texts are cut into words
    for this search alone.

    vectors: stored cells with labels, or a frame (doc_id, embedding).

    index: (doc_id, text, access_level, status). A hybrid question without any search word is searched by its vector
    alone; a sparse one then finds nothing. Each leg gives `prefetch` rows at most."""
    if mode not in ("hybrid", "dense", "sparse"):
        raise ValueError(f"unknown mode {mode}")
    k = s.top_k if k is None else k
    seen = visible(index, levels, superseded)
    legs = []
    if mode != "dense":
        if stored is not None:
            legs.append(segments.sparse_topk(questions, stored, s.prefetch, levels, superseded, s).withColumnRenamed(stored.key, "doc_id"))
        else:
            post = postings(index.select("doc_id", "text"), s)
            legs.append(sparse_topk(questions, weights(post, s), idf(post, index.count()), s.prefetch, seen, s=s))
    if mode != "sparse":
        if vectors is None or query_vectors is None:
            raise ValueError(f"mode {mode} needs vectors")
        if isinstance(vectors, Cells):
            legs.append(nearest_topk(query_vectors, vectors, s.prefetch, levels, superseded).withColumnRenamed(vectors.key, "doc_id"))
        else:
            legs.append(dense_topk(query_vectors, vectors.join(seen.select("doc_id"), "doc_id", "left_semi"), s.prefetch, "doc_id"))
    limit = max(k, s.prefetch) if reranker else k
    hits = fused(legs, limit, s=s) if len(legs) > 1 else legs[0].where(F.col("rank") <= limit)
    hits = hits.join(seen.select("doc_id", "text", "access_level"), "doc_id").join(questions.select("question_id", F.col("text").alias("question")), "question_id")
    return reranked(hits, reranker(F.col("question"), F.col("text")), k, s.min_score) if reranker else hits
