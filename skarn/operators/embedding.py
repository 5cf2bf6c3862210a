"""An embedder learned from the stored index: a truncated singular value decomposition of its weights.

A is the matrix of documents by search words, rarity times stored weight. Its leading right singular vectors come from block
power iteration: random signs for each word, Y = A X by shard, an orthonormal Q from the small matrix Y'Y, Z = A'Q summed
by word, and again with Z. Postings stay in groups of shards through all passes; only words' vectors move, once to each group. At the end the small matrix Z'Z gives the singular values and turns Z into vectors of words.
A text's embedding is the sum of its words' vectors by weight, of length one; questions are folded in the same way.

Only matrices of `size` by `size` numbers reach the driver. Documents that a later segment has deleted count until segments
are merged; they get no vector.

Defined results: a text without a known word has no vector; a blank or null question is refused (`ValueError`); a word's
vector does not depend on how documents are dealt."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.text import query_tokens
from skarn.operators.segments import Snapshot
from skarn.runtime import goes_with_session, parallelism, removed, shared_path, ship, written
from skarn.settings import DEFAULT, Settings


def signs(word: str, size: int) -> np.ndarray:
    """Random signs that depend on the word alone."""
    import xxhash

    data = word.encode()
    bits = np.array([xxhash.xxh64_intdigest(data, 101 + i) for i in range(-(-size // 64))], np.uint64)
    return np.unpackbits(bits.view(np.uint8))[:size] * 2.0 - 1.0


def _lists(rows):
    """(shard, word, places, weights) of a group's postings, shard by shard."""
    docs, weights = (rows.column(c).combine_chunks() for c in ("docs", "weights"))
    cut, d, w = np.asarray(docs.offsets), np.asarray(docs.values), np.asarray(weights.values)
    shard, words = np.asarray(rows.column("shard")), rows.column("term").to_pylist()
    for i in np.argsort(shard, kind="stable").tolist():
        yield int(shard[i]), words[i], d[cut[i] : cut[i + 1]], w[cut[i] : cut[i + 1]]


def _stacked(column) -> np.ndarray:
    column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _products(rows, held, size: int):
    """Y = A X of each shard of a group, X being the vectors of `held` or random signs: (shard, words and their weighted
    places, which places have a word, Y)."""
    names = held.column("term").to_pylist()
    x = _stacked(held.column("v")) if "v" in held.column_names else np.array([signs(t, size) for t in names])
    of = {t: (idf, i) for i, (t, idf) in enumerate(zip(names, held.column("idf").to_pylist(), strict=True))}
    for shard, own in groupby(_lists(rows), key=lambda r: r[0]):
        own = [(word, of[word][1], docs, of[word][0] * weights) for _, word, docs, weights in own if word in of]
        if not own:
            continue
        last = max(int(docs.max()) for _, _, docs, _ in own) + 1
        y, there = np.zeros((last, size)), np.zeros(last, bool)
        for _, i, docs, weights in own:
            y[docs] += weights[:, None] * x[i]
            there[docs] = True
        yield shard, own, there, y


def _cogrouped(post: DataFrame, pairs: DataFrame, words: DataFrame, run, shape: str) -> DataFrame:
    """Runs over each group's postings, which stay where they are, and the words (term, idf, and v if any) it has."""
    return post.groupBy("grp").cogroup(pairs.join(words, "term").groupBy("grp")).applyInArrow(run, shape)


def _times(post: DataFrame, pairs: DataFrame, words: DataFrame, size: int) -> DataFrame:
    """A X: (shard, place, y)."""

    def run(rows, held):
        import pyarrow as pa

        parts = [(np.full(int(there.sum()), shard), np.flatnonzero(there), y[there]) for shard, _, there, y in _products(rows, held, size)] if rows.num_rows and held.num_rows else []
        shard, place, y = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0), np.zeros(0), np.zeros((0, size)))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * size), pa.array(y.ravel()))
        return pa.table({"shard": shard.astype(np.int32), "place": place.astype(np.int32), "y": flat})

    return _cogrouped(post, pairs, words, run, "shard int, place int, y array<double>")


def _there_and_back(post: DataFrame, pairs: DataFrame, words: DataFrame, size: int, parts: int) -> tuple[DataFrame, np.ndarray]:
    """A'A X as (term, v), and the small matrix Y'Y of Y = A X. Both are made where a group's postings are, so that Y goes
    nowhere; what makes Y orthonormal is a small matrix on the right, and can follow."""

    def run(rows, held):
        import pyarrow as pa

        g, found = np.zeros((size, size)), {}
        for _, own, _, y in _products(rows, held, size) if rows.num_rows and held.num_rows else ():
            g += y.T @ y
            for word, _, docs, weights in own:
                found[word] = found.get(word, 0) + weights @ y[docs]
        v = np.concatenate([np.array(list(found.values())).reshape(-1, size), g])
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * size), pa.array(v.ravel()))
        return pa.table({"term": pa.array([*found, *[None] * size], pa.string()), "row": pa.array([*[-1] * len(found), *range(size)], pa.int32()), "v": flat})

    def summed(table):
        import pyarrow as pa

        keys = pa.table({"term": table.column("term"), "row": table.column("row"), "i": np.arange(table.num_rows)}).group_by(["term", "row"]).aggregate([("i", "list")])
        each = keys.column("i_list").combine_chunks()
        v = np.zeros((len(keys), size))
        np.add.at(v, np.repeat(np.arange(len(keys)), np.diff(np.asarray(each.offsets))), _stacked(table.column("v"))[np.asarray(each.flatten())])
        return pa.table({"term": keys.column("term"), "row": keys.column("row"), "v": pa.array(list(v), pa.list_(pa.float64()))})

    partial = _cogrouped(post, pairs, words, run, "term string, row int, v array<double>")
    # The rows of a group's Y'Y go along as those without a word.
    whole = written(partial.withColumn("part", F.pmod(F.xxhash64("term", "row"), F.lit(parts))).groupBy("part").applyInArrow(summed, "term string, row int, v array<double>"), "z")
    g = np.zeros((size, size))
    for r in whole.where("row >= 0").select("row", "v").collect():
        g[r["row"]] = r["v"]
    return whole.where("row < 0").select("term", "v"), g


def _gram(rows: DataFrame, name: str, size: int) -> np.ndarray:
    """The sum of each row's products with itself: `size` by `size` numbers."""

    def run(it):
        import pyarrow as pa

        g = np.zeros((size, size))
        for batch in it:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten(), np.float64).reshape(batch.num_rows, -1)
                g += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size, dtype=np.int32)), pa.array(g.ravel())], names=["i", "g"])

    out = np.zeros(size * size)
    for r in rows.select(name).mapInArrow(run, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).collect():
        out[r["i"]] = r["g"]
    return out.reshape(size, size)


def _inverse_root(g: np.ndarray) -> np.ndarray:
    """What makes the columns behind a Gram matrix orthonormal; directions without length become none."""
    value, vector = np.linalg.eigh(g)
    good = value > max(value.max(), 0) * 1e-12
    return (vector * np.where(good, 1 / np.sqrt(np.where(good, value, 1)), 0)) @ vector.T


def _turned(words: DataFrame, turn: np.ndarray) -> DataFrame:
    """Each word's vector times a small matrix."""
    sent = words.sparkSession.sparkContext.broadcast(turn)

    def run(it):
        import pyarrow as pa

        for batch in it:
            v = np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1) @ sent.value if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(v), pa.list_(pa.float64()))], names=["term", "v"])

    return words.select("term", "v").mapInArrow(run, "term string, v array<double>")


@dataclass(frozen=True)
class Embedder:
    """What has been learned: word vectors and document vectors at a path, and the singular values, largest first."""

    spark: SparkSession
    path: str
    key: str
    values: np.ndarray

    @property
    def words(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/words")

    @property
    def documents(self) -> DataFrame:
        """(key, access_level, status, embedding)."""
        return self.spark.read.parquet(f"{self.path}/documents")

    def questions(self, asked: DataFrame, s: Settings = DEFAULT) -> DataFrame:
        """(question_id, vector) of questions (question_id, text), null where no word is known."""
        blank = asked.where(F.col("text").isNull() | (F.trim("text") == "")).limit(1).collect()
        if blank:
            raise ValueError(f"question {blank[0]['question_id']} is blank")
        size = len(self.values)
        each = asked.select("question_id", F.explode(query_tokens(F.col("text"), s)).alias("term")).join(self.words, "term")
        summed = each.groupBy("question_id").agg(*(F.sum(F.get("v", i) * F.col("idf")).alias(f"v{i}") for i in range(size)))
        whole = summed.select("question_id", F.array(*(F.col(f"v{i}") for i in range(size))).alias("v"))
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        return asked.select("question_id").join(whole.select("question_id", F.when(length > 0, F.transform("v", lambda x: x / length)).alias("vector")), "question_id", "left")


def read(spark: SparkSession, path: str, key: str) -> Embedder:
    """What `learn` has left at a path."""
    values = spark.read.parquet(f"{path.rstrip('/')}/values").first()["values"]
    return Embedder(spark, path.rstrip("/"), key, np.array(values))


#: Groups of shards have so many documents or fewer: more groups move a word's vector more often, larger ones take more memory.
GROUP_DOCS = 65_536


@contextmanager
def _by_group(index: Snapshot, groups: int) -> Iterator[DataFrame]:
    """The postings (grp, shard, term, docs, weights) written once by groups of shards, as a table in buckets: passes then read
    a group where it is instead of shuffling it. The table goes at the end."""
    spark, name, path = index.spark, f"skarn_weights_{uuid.uuid4().hex}", shared_path(index.spark, "weights")
    rows = index.table("postings").select(F.pmod("shard", F.lit(groups)).cast("int").alias("grp"), "shard", "term", "docs", "weights")
    try:
        rows.repartition(groups, "grp").write.bucketBy(groups, "grp").option("path", path).saveAsTable(name)
        goes_with_session(spark, path)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        removed(spark, path)


def learn(index: Snapshot, path: str, size: int = 64, passes: int = 2) -> Embedder:
    """Learns from a snapshot and stores vectors of words and documents at the path."""
    spark, parts, path = index.spark, parallelism(index.spark), path.rstrip("/")
    ship(spark)
    groups = max(-(-index.size // GROUP_DOCS), min(spark.sparkContext.defaultParallelism, sum(x["shards"] for x in index.segments)))
    rarity = written(index.rarity.select("term", "idf"), "rarity")
    with _by_group(index, groups) as post:
        pairs = written(post.select("grp", "term").distinct(), "pairs")
        words = rarity
        for k in range(passes + 1):
            words, g = _there_and_back(post, pairs, words, size, parts)
            words = _turned(words, _inverse_root(g))
            if k < passes:
                # The words' side is made orthonormal too, so that small values do not drown in large ones.
                words = _turned(words, _inverse_root(_gram(words, "v", size))).join(rarity, "term")
        value, vector = np.linalg.eigh(_gram(words, "v", size))
        order = np.argsort(-value)
        value, vector = np.sqrt(np.maximum(value[order], 0)), vector[:, order]
        # The larger part of each small vector is positive, so that signs do not depend on the library.
        vector *= np.where(np.abs(vector.max(0)) >= np.abs(vector.min(0)), 1.0, -1.0)
        _turned(words, vector * np.where(value > value.max() * 1e-9, 1 / np.where(value > 0, value, 1), 0)).join(rarity, "term").write.parquet(f"{path}/words")
        spark.createDataFrame([(value.tolist(),)], "values array<double>").write.parquet(f"{path}/values")
        known = spark.read.parquet(f"{path}/words")
        length = F.sqrt(F.aggregate("y", F.lit(0.0), lambda a, x: a + x * x))
        y = _times(post, pairs, known, size).select("shard", "place", F.when(length > 0, F.transform("y", lambda x: x / length)).alias("embedding")).where("embedding is not null")
        index.docs.select("shard", "place", index.key, "access_level", "status").join(y, ["shard", "place"]).drop("shard", "place").write.parquet(f"{path}/documents")
    return Embedder(spark, path, index.key, value)
