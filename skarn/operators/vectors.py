"""Stored vectors in cells: exact nearest rows of many query vectors, reading only cells that can hold one.

Cells come from k-means: centres begin as rows of a bounded sample and are moved by passes over all vectors. Vectors lie in
Parquet by cell; of each cell its centre, size and radius are kept. For a query q and a cell of centre c and radius r no
inner product can be more than q.c + |q| r, so a cell is passed over once k rows are known that are better: the
result is that of all vectors. First each query looks into the cells that promise most until they hold k rows that it
may see; what those give is the floor for all other cells.

Labels (access_level, status) are filtered before anything is scored. A cell may hold a third of all vectors: it is read in
as many parts as its files have.

Defined results: vectors that are null, of another length than most or hold null or non-finite numbers are not indexed;
of equal scores the smaller key comes first; a query without a vector finds nothing; an empty table gives an empty index."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarn.operators.segments import blocks_of
from skarn.runtime import ship, written


@dataclass(frozen=True)
class CellConfig:
    #: Rows of the sample that centres begin from, and passes over all vectors after that.
    sample: int = 20_000
    passes: int = 3
    #: Cells: the square root of the number of vectors, and no more than this.
    most: int = 1024
    seed: int = 17


@dataclass(frozen=True)
class Cells:
    """A stored index: its rows (key, labels, embedding, cell) and what is known of each cell, in the order of `ids`."""

    spark: SparkSession
    path: str
    key: str
    ids: np.ndarray
    centres: np.ndarray
    radius: np.ndarray
    size: np.ndarray

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")


def matrix(column) -> np.ndarray:
    """The rows of a list column as a matrix of doubles."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The place of the nearest centre of each row."""
    return np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, 1)


def _moved(rows: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The means of the rows that are nearest to each centre; a centre without rows stays. Sums are made where rows are read:
    one row for each batch and centre leaves a task."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def run(it):
        import pyarrow as pa

        c = sent.value
        total, count = np.zeros_like(c), np.zeros(len(c), np.int64)
        for batch in it:
            if batch.num_rows:
                x = matrix(batch.column(0))
                own = nearest(x, c)
                np.add.at(total, own, x)
                count += np.bincount(own, minlength=len(c))
        there = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(there.astype(np.int32)), "n": pa.array(count[there]), "total": pa.array(list(total[there]), pa.list_(pa.float64()))})

    parts = rows.select("embedding").mapInArrow(run, "cell int, n long, total array<double>")
    d = centres.shape[1]
    summed = parts.groupBy("cell").agg(F.sum("n").alias("n"), *(F.sum(F.get("total", i)).alias(f"t{i}") for i in range(d)))
    out = centres.copy()
    for r in summed.collect():
        out[r["cell"]] = np.array([r[f"t{i}"] for i in range(d)]) / r["n"]
    return out


def write(vectors: DataFrame, path: str, key: str = "vec_id", cfg: CellConfig | None = None) -> Cells:
    """Indexes vectors (key, embedding, and labels where there are any) at the path."""
    cfg, spark = cfg or CellConfig(), vectors.sparkSession
    ship(spark)
    for c in ("access_level", "status"):
        if c not in vectors.columns:
            vectors = vectors.withColumn(c, F.lit(None).cast("string"))
    plain = vectors.select(key, "access_level", "status", F.col("embedding").cast("array<double>").alias("embedding"))
    good = plain.where(F.col(key).isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    width = good.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    n, d = (width[0]["n"], width[0]["d"]) if width else (0, 1)
    good = good.where(F.size("embedding") == d)
    k = max(1, min(cfg.most, math.isqrt(n)))
    share = min(1.0, 1.2 * cfg.sample / max(n, 1))
    sample = good.sample(share, cfg.seed).select("embedding").limit(cfg.sample).collect()
    x = np.array([r["embedding"] for r in sample]).reshape(-1, d)
    if not len(x):
        x = np.zeros((1, d))
    rng = np.random.default_rng(cfg.seed)
    # Far apart to begin with: each centre is drawn by its distance from those before.
    centres = [x[rng.integers(len(x))]]
    far = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < min(k, len(x)) and far.sum() > 0:
        centres.append(x[rng.choice(len(x), p=far / far.sum())])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(1))
    centres = np.array(centres)
    for _ in range(cfg.passes if n else 0):
        centres = _moved(good, centres)
    sent = spark.sparkContext.broadcast(centres)

    def dealt(it):
        import pyarrow as pa

        c = sent.value
        for batch in it:
            v = matrix(batch.column(3))
            own = nearest(v, c) if len(v) else np.zeros(0, np.int64)
            apart = np.sqrt(((v - c[own]) ** 2).sum(1)) if len(v) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(apart)], names=[*batch.schema.names, "cell", "apart"])

    kinds = dict(good.dtypes)
    shape = f"`{key}` {kinds[key]}, access_level string, status string, embedding array<double>, cell int, apart double"
    # A cell with many rows is dealt to several tasks.
    cells = written(good.mapInArrow(dealt, shape), "cells")
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 4096)))
    deal = cells.drop("apart").repartition(parts, "cell", F.pmod(F.xxhash64(key), F.lit(max(1, parts // len(centres)))))
    deal.sortWithinPartitions("cell").write.partitionBy("cell").mode("errorifexists").parquet(f"{path.rstrip('/')}/rows")
    found = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).orderBy("cell").collect()
    about = spark.createDataFrame([(r["cell"], r["n"], float(r["radius"]), centres[r["cell"]].tolist()) for r in found], "cell int, n long, radius double, centre array<double>")
    about.write.parquet(f"{path.rstrip('/')}/about")
    return read(spark, path, key)


def read(spark: SparkSession, path: str, key: str = "vec_id") -> Cells:
    about = sorted(spark.read.parquet(f"{path.rstrip('/')}/about").collect(), key=lambda r: r["cell"])
    return Cells(spark, path.rstrip("/"), key, *(np.array([r[c] for r in about]) for c in ("cell", "centre", "radius", "n")))


def _scored(index: Cells, block: np.ndarray, pairs: list[np.ndarray], floor: np.ndarray, k: int, levels, superseded: bool) -> DataFrame | None:
    """(number, key, score) of the best rows of each cell for the queries that look into it; pairs: by cell their numbers."""
    wanted = [int(c) for c, own in zip(index.ids, pairs, strict=True) if len(own)]
    if not wanted:
        return None
    rows = index.rows.where(F.col("cell").isin(wanted))
    if levels is not None:
        rows = rows.where(F.col("access_level").isin(*levels)) if levels else rows.where(F.lit(False))
        rows = rows if superseded else rows.where(F.col("status") == "active")
    own = {int(c): p for c, p in zip(index.ids, pairs, strict=True) if len(p)}
    sent = index.spark.sparkContext.broadcast((block, own, floor))

    def run(it):
        import pyarrow as pa

        queries, own, floor = sent.value
        for batch in it:
            cell = np.asarray(batch.column(2))
            for c in np.unique(cell).tolist():
                at = np.flatnonzero(cell == c)
                part = batch.take(pa.array(at))
                x, keys = matrix(part.column(1)), part.column(0)
                rank = np.argsort(np.argsort(np.asarray(keys.to_pylist()), kind="stable"), kind="stable")
                for lo in range(0, len(own[c]), 512):
                    q = own[c][lo : lo + 512]
                    score = np.floor(queries[q] @ x.T * 1e6 + 0.5) / 1e6
                    number, place, value = [], [], []
                    for i in range(len(q)):
                        good = np.flatnonzero(score[i] >= floor[q[i]] - 2e-6)
                        best = good[np.lexsort((rank[good], -score[i][good]))[:k]]
                        number.append(np.full(len(best), q[i]))
                        place.append(best)
                        value.append(score[i][best])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(number)), keys.take(pa.array(np.concatenate(place))), pa.array(np.concatenate(value))], names=["number", "key", "score"])

    kind = dict(index.rows.dtypes)[index.key]
    return rows.select(index.key, "embedding", "cell").mapInArrow(run, f"number long, key {kind}, score double")


def topk(queries: DataFrame, index: Cells, k: int = 20, levels: tuple[str, ...] | None = None, superseded: bool = False, block_rows: int = 20_000, count: bool = False) -> DataFrame:
    """(question_id, key, score, rank): the k rows of largest inner product, rounded to six places, for each query
    (question_id, vector), exactly. count: (question_id, cells, cells_read, vectors, vectors_read) instead."""
    ship(index.spark)
    kind, out = dict(queries.dtypes)["question_id"], None
    shape = f"question_id {kind}, {index.key} {dict(index.rows.dtypes)[index.key]}, score double, rank int" if len(index.ids) else f"question_id {kind}, {index.key} long, score double, rank int"
    if count:
        shape = f"question_id {kind}, cells long, cells_read long, vectors long, vectors_read long"
    d = index.centres.shape[1] if len(index.ids) else 0
    usable = queries.where(F.col("vector").isNotNull() & (F.size("vector") == d)).select("question_id", F.col("vector").cast("array<double>").alias("vector"))
    for part in blocks_of(usable, block_rows):
        own = part.collect()
        if not own or not d:
            continue
        ids, q = [r["question_id"] for r in own], np.array([r["vector"] for r in own])
        bound = q @ index.centres.T + np.sqrt((q * q).sum(1))[:, None] * index.radius + 1e-9
        # The most promising centres until their cells hold enough rows; twice as many as needed, since some may not be seen.
        order = np.argsort(-(q @ index.centres.T), 1)
        enough = np.cumsum(index.size[order], 1)
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, order, (enough - index.size[order]) < 2 * k, 1)
        floor = np.full(len(q), -np.inf)
        begun = written(_scored(index, q, [np.flatnonzero(first[:, c]) for c in range(len(index.ids))], floor, k, levels, superseded), "near")
        place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "key"))
        for r in begun.withColumn("rank", place).where(F.col("rank") == k).collect():
            floor[r["number"]] = r["score"]
        rest = ~first & (bound >= floor[:, None] - 1e-6)
        names = index.spark.createDataFrame(list(enumerate(ids)), f"number long, question_id {kind}")
        if count:
            seen = first | rest
            rows = [(i, len(index.ids), int(s.sum()), int(index.size.sum()), int(index.size[s].sum())) for i, s in zip(ids, seen, strict=True)]
            new = index.spark.createDataFrame(rows, shape)
        else:
            more = _scored(index, q, [np.flatnonzero(rest[:, c]) for c in range(len(index.ids))], floor, k, levels, superseded)
            found = begun if more is None else begun.unionByName(more)
            best = found.withColumn("rank", place).where(F.col("rank") <= k)
            new = best.join(F.broadcast(names), "number").select("question_id", F.col("key").alias(index.key), "score", "rank")
        out = new if out is None else out.unionByName(new)
    return out if out is not None else index.spark.createDataFrame([], shape)
