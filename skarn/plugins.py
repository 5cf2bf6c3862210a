"""What a deployment brings along, and deterministic stand-ins that need no network.

Each protocol works on columns or on batches, so that a model is loaded once for each Python worker."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.citations import best_piece
from skarn.functions.text import query_tokens, search_tokens
from skarn.runtime import ship


class TokenCounter(Protocol):
    def __call__(self, text: str) -> int: ...


class Reranker(Protocol):
    def __call__(self, question: Column, text: Column) -> Column: ...


class Generator(Protocol):
    def __call__(self, question: Column, sources: Column) -> Column: ...


class Embedder(Protocol):
    size: int

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


def count_words(text: str) -> int:
    """The default token counter: runs of characters other than white space."""
    return len(text.split())


class SubwordCounter:
    """Counts the ids of a public tokenizer's file, without special tokens; the file is read once in each process."""

    _held: dict = {}

    def __init__(self, path: str):
        self.path = path

    def __call__(self, text: str) -> int:
        if self.path not in self._held:
            from tokenizers import Tokenizer

            self._held[self.path] = Tokenizer.from_file(self.path)
        return len(self._held[self.path].encode(text, add_special_tokens=False).ids)


def overlap_reranker(question: Column, text: Column) -> Column:
    """The share of a question's search words that a text holds: a score from 0 to 1."""
    return overlap_score(query_tokens(question), search_tokens(text))


def overlap_score(asked: Column, words: Column) -> Column:
    """The same from a question's distinct search words and a text's, which the index keeps."""
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, words)) / F.size(asked)).otherwise(F.lit(0.0))


def extractive_generator(question: Column, sources: Column) -> Column:
    """The piece of the first source that shares most words with the question, cited; the mark if there is none."""
    piece = best_piece(F.get(sources, 0), question)
    return F.when((F.size(sources) > 0) & (piece != ""), F.concat(piece, F.lit(" [1]"))).otherwise(F.lit("[NOT_FOUND]"))


class HashEmbedder:
    """Signed hashing of words, of unit length."""

    def __init__(self, size: int = 64):
        self.size = size

    def __call__(self, texts: list[str]) -> list[list[float]]:
        import numpy as np
        import xxhash

        out = np.zeros((len(texts), self.size))
        for row, text in zip(out, texts, strict=True):
            for w in text.lower().split():
                h = xxhash.xxh64_intdigest(w, 1)
                row[h % self.size] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()


def embedded(df: DataFrame, text: str, embedder: Embedder, name: str = "embedding", batch: int = 64) -> DataFrame:
    """Adds the embeddings of a text column, batch by batch in the order of the rows."""
    ship(df.sparkSession)

    @F.pandas_udf("array<float>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in it:
            values = series.fillna("").tolist()
            yield pd.Series([v for a in range(0, len(values), batch) for v in embedder(values[a : a + batch])])

    return df.withColumn(name, run(F.col(text)))


def routed(sources_levels: Column, local_only: tuple[str, ...]) -> Column:
    """`local` where any source may not leave the house, else `any`."""
    return F.when(F.arrays_overlap(sources_levels, F.array(*map(F.lit, local_only))), "local").otherwise("any")
