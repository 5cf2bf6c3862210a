"""All registered plans of the retrieval engine."""

from __future__ import annotations

from skarn.plans import chunk_queries, document_queries, engine_queries, evaluation_queries, search_queries

_PARTS = (search_queries, document_queries, chunk_queries, evaluation_queries, engine_queries)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}

#: Columns that Spark gives as 32-bit integers where DuckDB counts in 64 bits.
_INTEGERS = {
    "tokenize_documents": ("n_tokens", "n_distinct"), "bm25_topk": ("rank",), "dense_topk": ("rank",), "hybrid_rrf": ("rank",), "rerank_threshold_topk": ("rank", "old_rank"),
    "clean_repeated_lines": ("n_removed",), "history_last3": ("n_history",), "fact_counts": ("n",), "eval_ranks": ("source_rank",),
    "search_reranked": ("rank", "old_rank"), "answer_ranks": ("answer_rank",), "source_ranks": ("source_rank",), "model_replies": ("rewritten",),
}


def _typed(name: str, sql: str) -> str:
    columns = _INTEGERS.get(name, ())
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS INTEGER) AS {c}' for c in columns)}) FROM ({sql})" if columns else sql


ORACLES = {k: _typed(k, v) for p in _PARTS for k, v in p.ORACLES.items()}
