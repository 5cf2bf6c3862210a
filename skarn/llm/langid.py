"""Language identification with hyperdimensional profiles.

Every letter class has a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters' vectors, each
permuted (rotated) by its distance from the trigram's end; a document's vector bundles (adds) those of all its trigrams,
a language's prototype those of all its training documents. A document is given the language whose prototype has the
largest cosine with its vector, both freed of what all languages have in common.

Letter classes: a to z, a separator for every run of other characters, and a class by code point for other letters;
A to Z count as a to z. Bundling is linear, so trigrams are counted first and each distinct one is added once, times
its count: the same vector, at a cost that does not grow with repeats.

Defined results: `und` and 0 for null text and text without a letter, and for all if nothing was learned; null
languages are not learned; a tie goes to the language that sorts first; repeated rows come back once for each row; a
null doc_id counts as the empty text in the fold rule; other columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.words import batches
from skarn.runtime import dealt, ship, table


@dataclass(frozen=True)
class LangConfig:
    size: int = 512
    seed: int = 11
    #: Languages learned at most (their prototypes travel to every task); more raise an error.
    most_languages: int = 2000


_CLASSES = 40
_GRAMS = _CLASSES**3


@lru_cache(1)
def letter_classes() -> np.ndarray:
    """The class of each code point: 0 for what is no letter, 1 to 26 for a to z, 27 to 39 for other letters."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x80, 0x110000):
        if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] == "L":
            out[c] = 27 + (c * 2654435761 >> 7) % (_CLASSES - 27)
    out[97:123] = np.arange(1, 27)
    out[65:91] = np.arange(1, 27)
    return out


@lru_cache(2)
def gram_vectors(size: int, seed: int) -> np.ndarray:
    """The bound vector of every trigram, as int8."""
    letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (_CLASSES, size))
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    return (first[:, None, None] * second[None, :, None] * letters[None, None]).reshape(_GRAMS, size)


def gram_counts(text: bytes) -> tuple[np.ndarray, np.ndarray, bool]:
    """Distinct trigrams, their counts, and whether there is a letter. The text is read as if between separators."""
    code = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    kind = np.zeros(len(code) + 2, np.uint8)
    kind[1:-1] = letter_classes()[code]
    there = np.ones(len(kind), bool)
    there[1:] = (kind[1:] != 0) | (kind[:-1] != 0)
    kind = kind[there].astype(np.int32)
    if len(kind) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), False
    n = np.bincount(kind[:-2] * (_CLASSES * _CLASSES) + kind[1:-1] * _CLASSES + kind[2:], minlength=0)
    at = np.flatnonzero(n)
    return at, n[at], True


def bundle(at: np.ndarray, n: np.ndarray, cfg: LangConfig) -> np.ndarray:
    """The sum of the trigrams' vectors, each times its count."""
    out, vectors = np.zeros(cfg.size, np.float32), gram_vectors(cfg.size, cfg.seed)
    for a in range(0, len(at), 4096):
        out += n[a : a + 4096].astype(np.float32) @ vectors[at[a : a + 4096]].astype(np.float32)
    return out


def learn(docs: DataFrame, cfg: LangConfig | None = None) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes): every (lang, text) row counts equally; prototypes are centred and of unit length."""
    cfg = cfg or LangConfig()
    ship(docs.sparkSession)

    def run(it):
        import pyarrow as pa

        held: dict[str, np.ndarray] = {}
        for batch, texts in batches(it):
            for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                at, n, some = gram_counts(text)
                if some:
                    v = bundle(at, n, cfg)
                    held[lang] = held.get(lang, 0) + v / max(1e-9, float(np.linalg.norm(v)))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v.astype(np.float64).tolist() for v in held.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = docs.where("lang is not null").select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    rows = sums.orderBy("lang").limit(cfg.most_languages + 1).collect()
    if len(rows) > cfg.most_languages:
        raise ValueError(f"more than {cfg.most_languages} languages")
    if not rows:
        return [], np.zeros((0, cfg.size))
    p = np.array([[x.x for x in r.v] for r in rows])
    p /= np.maximum(1e-12, np.linalg.norm(p, axis=1, keepdims=True))
    centre = p.mean(0) if len(rows) > 1 else np.zeros(cfg.size)
    return [r.lang for r in rows], np.vstack([(q := p - centre) / np.maximum(1e-12, np.linalg.norm(q, axis=1, keepdims=True)), centre])


def predicted(docs: DataFrame, learned: tuple[list[str], np.ndarray], cfg: LangConfig | None = None) -> DataFrame:
    """(doc_id, lang_pred, score): the score is (1 + cosine) / 2."""
    cfg = cfg or LangConfig()
    ship(docs.sparkSession)
    languages, p = learned

    def run(it):
        import pyarrow as pa

        for batch, texts in batches(it):
            names, scores = [], []
            for text in texts:
                at, n, some = gram_counts(text)
                if not some or not languages:
                    names.append("und")
                    scores.append(0.0)
                    continue
                v = bundle(at, n, cfg).astype(np.float64)
                v = v / max(1e-12, np.linalg.norm(v)) - p[-1]
                cos = p[:-1] @ v / max(1e-12, np.linalg.norm(v))
                k = int(np.argmax(cos))
                names.append(languages[k])
                scores.append(float(np.clip((1 + cos[k]) / 2, 0, 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op2_langid(spark, sf_dir: str) -> DataFrame:
    """The language of every whole text of `documents`, learned from those that are not held out."""
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    found = predicted(docs, learn(docs.where(~held).select("lang", "text")))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
