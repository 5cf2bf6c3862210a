"""Approximate nearest neighbours by cosine, over shifted Hilbert curves.

Each curve orders the vectors by the Hilbert index of a random, shifted projection of their unit vectors. The keys of all
curves (not the vectors) are range-partitioned and sorted in Spark; there a query's window on each curve becomes a pair of
keys. The queries then pass, with their windows, in blocks of a bounded number over the vectors, which stay where they
are: on every chunk of vectors a query's windows are merged, and what lies in any of them is ranked by the exact measure.

How many rows a window takes on either side is measured, not guessed: for a bounded sample of the queries the nearest
rows are found among all rows, and the window is the smallest one that holds the wanted share of them on some curve. So
the recall holds at any number of rows and for any shape of the data, near-equal vectors in large numbers included; what
changes is the work. Rows of equal keys are always taken together.

Equal vectors are one class, searched once, so copies neither fill windows nor meet in a task; of a class only the
smallest ids can be among a query's nearest. Defined results: vectors that are null, empty, zero, of another length
than most, or that hold null or non-finite components take no part, as query or as candidate; repeated rows (same id
and vector) are one candidate; null ids take no part; other columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.runtime import parallelism, ship, table, written


@dataclass(frozen=True)
class CurveConfig:
    curves: int = 16
    #: Dimensions and bits of a projection; their product is at most 64.
    dims: int = 4
    bits: int = 16
    near: int = 5
    #: The sample of queries on which windows are measured, the share of their nearest rows that these must hold, and
    #: the rows that a window has on either side at least.
    sample: int = 200
    target: float = 0.97
    least: int = 256
    #: Windows are cut on parts of this fraction of their size.
    grain: int = 4
    #: Queries that pass over the vectors at once, and bytes of vectors that are compared at once.
    block_rows: int = 20_000
    chunk_bytes: int = 16 << 20
    seed: int = 5


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """The Hilbert index of each row of unsigned coordinates below 2**bits, as uint64 (Skilling's transform)."""
    x = x.astype(np.uint32).T.copy()
    for b in range(bits - 1, 0, -1):
        q, p = np.uint32(1 << b), np.uint32((1 << b) - 1)
        for i in range(len(x)):
            up = (x[i] & q) != 0
            t = np.where(up, np.uint32(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, t)
            x[i] ^= t
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint32)
    for b in range(bits - 1, 0, -1):
        t ^= np.where((x[-1] >> np.uint32(b)) & 1, np.uint32((1 << b) - 1), np.uint32(0))
    x ^= t
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << np.uint64(1)) | ((c >> np.uint32(b)) & np.uint32(1)).astype(np.uint64)
    return key


def curve_keys(unit: np.ndarray, cfg: CurveConfig) -> np.ndarray:
    """The sort keys of unit vectors, one column for each curve, as signed integers in the order of the indexes."""
    d = unit.shape[1]
    out = np.empty((len(unit), cfg.curves), np.int64)
    for curve in range(cfg.curves):
        g = np.random.default_rng([cfg.seed, curve, d])
        to = np.linalg.qr(g.normal(size=(d, d)))[0][:, : min(cfg.dims, d)]
        shift = g.uniform(-0.25, 0.25, to.shape[1])
        # Projected components of random unit vectors have a deviation of d**-0.5; eight of these fit the grid.
        grid = np.clip(((unit @ to) * math.sqrt(d) / 8 + 0.5 + shift) * (1 << cfg.bits), 0, (1 << cfg.bits) - 1)
        out[:, curve] = (hilbert(grid, cfg.bits) ^ np.uint64(1 << 63)).view(np.int64)
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, the largest component near 1: exact, and squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None]) if len(x) else x


def _matrix(column) -> np.ndarray:
    """An Arrow list column without nulls, all of one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _vectors(column) -> tuple[np.ndarray, np.ndarray]:
    """(scaled vectors, their lengths) in double precision."""
    x = scaled(_matrix(column).astype(np.float64))
    return x, np.sqrt((x * x).sum(1))


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector can be searched, and whose length is the commonest (the smaller of equally common ones)."""
    v = F.col(vector)
    good = vectors.where(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    size = good.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return good.where(F.size(v) == (size["d"] if size else 0))


def _classes(rows: DataFrame, asks, cfg: CurveConfig) -> DataFrame:
    """(cls, embedding, ids, asks, keys): the distinct vectors with the smallest ids of each."""
    # A query never needs more than its `near` and itself of any class.
    least = rows.distinct().withColumn("r", F.expr("row_number() over (partition by embedding order by vec_id)")).where(F.col("r") <= cfg.near + 1)
    ids = least.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    marked = ids.join(rows.where(asks).select("embedding", F.lit(True).alias("asks")).distinct(), "embedding", "left")
    plain = marked.select(F.monotonically_increasing_id().alias("cls"), "embedding", "ids", F.coalesce("asks", F.lit(False)).alias("asks"))

    def run(it):
        import pyarrow as pa

        for whole in it:
            for a in range(0, whole.num_rows, 4096):
                batch = whole.slice(a, 4096)
                x, length = _vectors(batch.column(1))
                keys = curve_keys(x / length[:, None], cfg)
                offsets = np.arange(0, keys.size + 1, cfg.curves, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1)))], names=[*batch.schema.names, "keys"])

    schema = T.StructType([*plain.schema.fields, T.StructField("keys", T.ArrayType(T.LongType()))])
    return written(plain.mapInArrow(run, schema), "classes")


def _chunks(it, cfg: CurveConfig):
    """Arrow batches of about `chunk_bytes` of vectors at most, from smaller and larger ones."""
    import pyarrow as pa

    held, size = [], 0
    for whole in it:
        if not whole.num_rows:
            continue
        row = max(1, 8 * len(whole.column(1).flatten()) // whole.num_rows)
        step = max(1, cfg.chunk_bytes // row)
        for a in range(0, whole.num_rows, step):
            part = whole.slice(a, step)
            if held and size + row * part.num_rows > cfg.chunk_bytes:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(part)
            size += row * part.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _best(score: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest, and of all that are too close to the last of them to be told apart yet."""
    if len(score) <= n:
        return np.arange(len(score))
    return np.flatnonzero(score >= np.partition(score, len(score) - n)[len(score) - n] - 1e-12)


def _exact(x: np.ndarray, length: np.ndarray, q: np.ndarray, q_length: float) -> np.ndarray:
    return (x * q).sum(1) / (length * q_length)


def window_rows(classes: DataFrame, cfg: CurveConfig) -> int:
    """The rows on either side that hold `target` of the nearest rows of the sampled queries on one of the curves."""
    spark = classes.sparkSession
    rows = classes.where("asks").orderBy(F.xxhash64("cls"), "cls").limit(cfg.sample).select("cls", "embedding", "keys").toArrow()
    if not rows.num_rows:
        return cfg.least
    rows = rows.combine_chunks()
    x, length = _vectors(rows.column("embedding").chunk(0))
    keys, own = _matrix(rows.column("keys").chunk(0)), rows.column("cls").to_numpy()
    sent = spark.sparkContext.broadcast((x / length[:, None], own))

    def all_rows(it):
        import pyarrow as pa

        unit, own = sent.value
        for batch in _chunks(it, cfg):
            cls = batch.column(0).to_numpy()
            v, size = _vectors(batch.column(1))
            score = (unit @ v.T) / size
            score[own[:, None] == cls[None]] = -np.inf
            k = min(cfg.near, len(cls))
            at = np.argpartition(-score, k - 1, axis=1)[:, :k]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(own)), k)), pa.array(np.take_along_axis(score, at, 1).reshape(-1)), batch.column(2).take(pa.array(at.reshape(-1)))], names=["q", "score", "keys"])

    found = classes.select("cls", "embedding", "keys").mapInArrow(all_rows, "q long, score double, keys array<long>")
    top = found.withColumn("r", F.expr("row_number() over (partition by q order by score desc, keys)")).where((F.col("r") <= cfg.near) & (F.col("score") > float("-inf"))).select("q", "keys").toArrow()
    if not top.num_rows:
        return cfg.least
    there, q = _matrix(top.column("keys").combine_chunks()), top.column("q").to_numpy()
    ends = spark.sparkContext.broadcast((np.minimum(keys[q], there), np.maximum(keys[q], there)))

    def between(it):
        import pyarrow as pa

        lo, hi = ends.value
        n = np.zeros(lo.shape, np.int64)
        for batch in it:
            if batch.num_rows:
                k = np.sort(_matrix(batch.column(0)), axis=0)
                for c in range(k.shape[1]):
                    n[:, c] += np.searchsorted(k[:, c], hi[:, c]) - np.searchsorted(k[:, c], lo[:, c], side="right")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n.size)), pa.array(n.reshape(-1))], names=["i", "n"])

    counted = classes.select("keys").mapInArrow(between, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(there.size, np.int64)
    n[counted.column("i").to_numpy()] = counted.column("n").to_numpy()
    return max(cfg.least, int(np.quantile(n.reshape(there.shape).min(1), cfg.target, method="higher")) + 1)


def windows(classes: DataFrame, window: int, cfg: CurveConfig) -> DataFrame:
    """(query, lo, hi): for each asking class its window's first and last key on each curve, by curve.

    The sorted keys are cut into parts; a part's place in the whole order is the number of rows before it. A query's
    window is made of whole parts and has `window` rows or more on either side, as far as there are any."""
    grain = max(1, window // cfg.grain)
    spark = classes.sparkSession

    def cut(it):
        import pyarrow as pa

        def part(curve, key, cls, asks):
            return curve, int(key[0]), int(key[-1]), len(key), cls[asks].tolist()

        rest = None
        for batch in it:
            cols = [np.asarray(batch.column(i)) for i in range(3)] + [np.asarray(batch.column(3).to_numpy(zero_copy_only=False), bool)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            out, at = [], 0
            curve = cols[0]
            while at < len(curve):
                end = min(at + grain, int(np.searchsorted(curve, curve[at], side="right")))
                if end == len(curve) and end - at < grain:
                    break
                out.append(part(int(curve[at]), *(x[at:end] for x in cols[1:])))
                at = end
            rest = [x[at:] for x in cols]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds(), strict=True)], names=names)
        if rest is not None and len(rest[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*[part(int(rest[0][0]), *rest[1:])], strict=True), kinds(), strict=True)], names=names)

    def kinds():
        import pyarrow as pa

        return pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())

    names = ["curve", "first", "last", "n", "asking"]
    keys = classes.select("cls", "asks", F.posexplode("keys").alias("curve", "key")).select("curve", "key", "cls", "asks")
    # Equal keys are parted by the class, in another order on each curve.
    tie = F.xxhash64("cls", "curve")
    ranged = keys.repartitionByRange(parallelism(spark), "curve", "key", tie).sortWithinPartitions("curve", "key", tie)
    parts = written(ranged.mapInArrow(cut, "curve int, first long, last long, n long, asking array<long>"), "parts")
    placed = parts.withColumn("at", F.expr("sum(n) over (partition by curve order by first, last, n rows between unbounded preceding and current row) - n"))
    reach = window + grain
    around = placed.withColumn("lo", F.expr(f"min(first) over (partition by curve order by at range between {reach} preceding and current row)")).withColumn("hi", F.expr(f"max(last) over (partition by curve order by at range between current row and {reach} following)"))
    each = around.where("size(asking) > 0").select("curve", "lo", "hi", F.explode("asking").alias("query"))
    by_curve = F.sort_array(F.collect_list(F.struct("curve", "lo", "hi")))
    return each.groupBy("query").agg(by_curve.alias("w")).select("query", F.transform("w", lambda x: x["lo"]).alias("lo"), F.transform("w", lambda x: x["hi"]).alias("hi"))


def _passed(classes: DataFrame, block, cfg: CurveConfig) -> DataFrame:
    """(query, ids, score): of each chunk of classes the best of each query of a block, by the exact measure."""
    sent = classes.sparkSession.sparkContext.broadcast(block)

    def run(it):
        import pyarrow as pa

        query, q, q_length, lo, hi = sent.value
        for batch in _chunks(it, cfg):
            ids = batch.column(3)
            first = ids.flatten().to_numpy()[np.asarray(ids.offsets)[:-1] - ids.offsets[0].as_py()] if len(ids) else np.zeros(0, np.int64)
            x, length = _vectors(batch.column(1))
            keys = _matrix(batch.column(2))
            order = np.argsort(keys, axis=0, kind="stable")
            a, b = (np.empty(lo.shape, np.int64) for _ in range(2))
            for c in range(keys.shape[1]):
                k = keys[order[:, c], c]
                a[:, c], b[:, c] = np.searchsorted(k, lo[:, c]), np.searchsorted(k, hi[:, c], side="right")
            unit = x / length[:, None]
            out: list[tuple] = []
            for i in range(len(query)):
                hit = np.zeros(len(x), bool)
                for c in range(keys.shape[1]):
                    hit[order[a[i, c] : b[i, c], c]] = True
                at = np.flatnonzero(hit)
                if len(at):
                    at = at[_best(unit[at] @ q[i], cfg.near + 1)]
                    score = _exact(x[at], length[at], q[i], q_length[i])
                    best = np.lexsort((first[at], -score))[: cfg.near + 1]
                    out.append((np.full(len(best), query[i]), at[best], score[best]))
            if out:
                who, at, score = (np.concatenate(v) for v in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(who), ids.take(pa.array(at)), pa.array(score)], names=["query", "ids", "score"])

    return classes.select("cls", "embedding", "keys", "ids").mapInArrow(run, "query long, ids array<long>, score double")


def nearest(vectors: DataFrame, asks, cfg: CurveConfig | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows for which `asks` (a condition on vec_id) holds, among all rows
    (vec_id long, embedding array)."""
    cfg = cfg or CurveConfig()
    if cfg.dims * cfg.bits > 64:
        raise ValueError("dims * bits may be 64 at most")
    ship(vectors.sparkSession)
    kind = "array<float>" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    rows = usable(vectors.where("vec_id is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind)), "embedding")
    classes = _classes(rows, asks, cfg)
    bounds = windows(classes, window_rows(classes, cfg), cfg)
    queries = written(classes.where("asks").select(F.col("cls").alias("query"), "embedding").join(bounds, "query"), "queries")
    blocks = max(1, math.ceil(queries.count() / cfg.block_rows))
    found = None
    for b in range(blocks):
        # A block is a bounded part of the stated queries; all classes pass by it.
        rows_ = queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if not rows_.num_rows:
            continue
        q, length = _vectors(rows_.column("embedding").chunk(0))
        block = (rows_.column("query").to_numpy(), q, length, *(_matrix(rows_.column(n).chunk(0)) for n in ("lo", "hi")))
        part = _passed(classes, block, cfg).withColumn("r", F.expr("row_number() over (partition by query order by score desc, ids[0])")).where(F.col("r") <= cfg.near + 1).drop("r")
        part = part if blocks == 1 else written(part, "found")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    top = (
        found.select("query", "score", F.explode("ids").alias("vec_id"))
        .withColumn("r", F.expr("row_number() over (partition by query order by score desc, vec_id)"))
        .where(F.col("r") <= cfg.near + 1)
        .select("query", "score", "vec_id")
    )
    asked = rows.where(asks).select(F.col("vec_id").alias("query_id"), "embedding").distinct().join(classes.where("asks").select(F.col("cls").alias("query"), "embedding"), "embedding").select("query_id", "query")
    return (
        asked.join(top, "query")
        .where("vec_id <> query_id")
        .withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)"))
        .where(F.col("rank") <= cfg.near)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def op1_ann(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector of `embeddings` whose id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
