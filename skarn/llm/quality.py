"""Document quality by attention over passages (multiple-instance learning).

Every passage of a document is encoded; gated attention weighs the passages and the weighted representation gives the
score. Only documents carry labels: the attention weights are learned from them alone, from every passage of a bounded
sample of labelled documents. Scoring has no bound; of a long text only what attention needs is held.

Defined results: null text is an empty text, which is one empty passage and gets a score like any other; repeated rows
come back once for each row; a null doc_id counts as the empty string in the fold rule; labels that are null or
neither 0 nor 1 are not learned; with no label of one class every score is the (smoothed) share of label 1; other
columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm import words
from skarn.runtime import dealt, ship, table, written


@dataclass(frozen=True)
class QualityConfig:
    passage_bytes: int = 512
    buckets: int = 128
    hidden: int = 24
    gate: int = 12
    epochs: int = 40
    #: The sample of labelled documents that is learned from, whole documents in the order of a hash: their number, and
    #: the passages they have together, at most.
    learn_documents: int = 4000
    learn_passages: int = 100_000


_PUNCT = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[10], _CLASS[128:192], _CLASS[192:] = 1, 2, 3, 4, 5, 6, 7
_CLASS[_PUNCT] = 8 + np.arange(len(_PUNCT))
_CLASSES = 8 + len(_PUNCT)
_EXTRA = 6


def blocks(texts: list[bytes], cfg: QualityConfig):
    """For one byte array after the other, the features of its passages and the number of the text of each."""
    for buf, at, which in words.pieces(texts):
        length = np.diff(np.append(at, len(buf)))
        n = np.maximum(1, -(-(length - 1) // cfg.passage_bytes))
        first = np.cumsum(n) - n
        total = int(n.sum())
        size = np.full(total, cfg.passage_bytes)
        size[first + n - 1] = length - (n - 1) * cfg.passage_bytes
        passage = np.repeat(np.arange(total), size)
        kinds = np.bincount(passage * _CLASSES + _CLASS[buf], minlength=total * _CLASSES).reshape(total, _CLASSES)
        low = words.LOWER[buf]
        starts, ends = words.split(low)
        h, of = words.hashes(low, starts, ends), passage[starts]
        held = np.bincount(of, minlength=total)
        bag = np.bincount(of * cfg.buckets + (h % np.uint64(cfg.buckets)).astype(np.int64), minlength=total * cfg.buckets).reshape(total, cfg.buckets)
        same = np.zeros((2, total))
        for d in (1, 2):
            if len(h) > d:
                same[d - 1] = np.bincount(of[d:][(h[d:] == h[:-d]) & (of[d:] == of[:-d])], minlength=total)
        key = np.sort((of.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=total)
        letters = np.bincount(of, weights=ends - starts, minlength=total)
        some = np.maximum(1, held)
        extra = np.stack([same[0] / some, same[1] / some, distinct / some, letters / some / 10, np.log1p(held), np.log1p(size)], 1)
        yield np.concatenate([kinds / size[:, None], bag / some[:, None], extra], 1).astype(np.float32), np.repeat(np.asarray(which), n)


def features(texts: list[bytes], cfg: QualityConfig) -> tuple[np.ndarray, np.ndarray]:
    """One row for each passage, and for each text the number of its passages (1 at least)."""
    rows, owner = [np.zeros((0, _CLASSES + cfg.buckets + _EXTRA), np.float32)], [np.zeros(0, np.int64)]
    for x, of in blocks(texts, cfg):
        rows.append(x)
        owner.append(of)
    return np.concatenate(rows), np.bincount(np.concatenate(owner), minlength=len(texts))


class AttentionMIL:
    """Gated attention over the passages of a bag, learned with Adam."""

    def __init__(self, width: int, cfg: QualityConfig, seed: int = 1):
        g = np.random.default_rng(seed)
        self.mean, self.scale, self.rate = np.zeros(width, np.float32), np.ones(width, np.float32), None
        h, a = cfg.hidden, cfg.gate
        self.p = {"W": g.normal(0, width**-0.5, (width, h)), "b": np.zeros(h), "V": g.normal(0, h**-0.5, (h, a)), "U": g.normal(0, h**-0.5, (h, a)), "w": g.normal(0, a**-0.5, a), "c": g.normal(0, h**-0.5, h), "d": np.zeros(1)}

    def encoded(self, x: np.ndarray):
        """(representations, the two halves of the gate, attention before the softmax) of passages."""
        p = {k: v.astype(np.float32) for k, v in self.p.items()}
        h = np.tanh(((x - self.mean) / self.scale) @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        return h, t, s, (t * s) @ p["w"]

    def pooled(self, h: np.ndarray, e: np.ndarray, count: np.ndarray):
        """(attention, weighted representations, scores) of bags of successive passages."""
        first = np.cumsum(count) - count
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), count))
        alpha = e / np.repeat(np.add.reduceat(e, first), count)
        z = np.add.reduceat(alpha[:, None] * h, first)
        logit = z @ self.p["c"].astype(np.float32) + self.p["d"].astype(np.float32)
        return alpha, z, 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def forward(self, x: np.ndarray, count: np.ndarray):
        h, t, s, e = self.encoded(x)
        return (h, t, s, *self.pooled(h, e, count))

    def score(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        if self.rate is not None:
            return np.full(len(count), self.rate)
        return self.forward(x, count)[-1].astype(np.float64)

    def score_texts(self, texts: list[bytes], cfg: QualityConfig) -> np.ndarray:
        """The scores of whole texts; the features of one byte array are held at a time."""
        if self.rate is not None or not texts:
            return np.full(len(texts), self.rate or 0.0)
        held = []
        for x, of in blocks(texts, cfg):
            h, _, _, e = self.encoded(x)
            held.append((h, e, of))
        h, e, of = (np.concatenate(v) for v in zip(*held, strict=True))
        return self.pooled(h, e, np.bincount(of, minlength=len(texts)))[-1].astype(np.float64)

    def gradients(self, x: np.ndarray, count: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss of some bags."""
        p, first = self.p, np.cumsum(count) - count
        h, t, s, alpha, z, prob = self.forward(x, count)
        dl = ((prob - y) / len(y)).astype(np.float32)
        of = np.repeat(np.arange(len(y)), count)
        dz = dl[:, None] * p["c"]
        da = (dz[of] * h).sum(1)
        de = alpha * (da - np.repeat(np.add.reduceat(alpha * da, first), count))
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        dh = (alpha[:, None] * dz[of] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"c": z.T @ dl, "d": dl.sum()[None], "w": (t * s).T @ de, "V": h.T @ dt, "U": h.T @ ds, "W": ((x - self.mean) / self.scale).T @ dh, "b": dh.sum(0)}

    def fit(self, x: np.ndarray, count: np.ndarray, y: np.ndarray, cfg: QualityConfig, batch: int = 64) -> AttentionMIL:
        if len(np.unique(y)) < 2:
            self.rate = (float(y.sum()) + 1) / (len(y) + 2)
            return self
        self.mean, self.scale = x.mean(0), x.std(0) + np.float32(1e-2)
        first = np.cumsum(count) - count
        g, m, v, step = np.random.default_rng(2), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for epoch in range(cfg.epochs):
            order = g.permutation(len(y))
            for lo in range(0, len(y), batch):
                bags = order[lo : lo + batch]
                n = count[bags]
                at = np.repeat(first[bags] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                p, grad = self.p, self.gradients(x[at], n, y[bags])
                step += 1
                rate = 5e-3 * (1 - 0.9 * epoch / cfg.epochs)
                for k in p:
                    d = grad[k] + 1e-4 * p[k] * (k in "WVU")
                    m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def fold(doc_id, parts: int):
    """crc32 of the id as text, modulo `parts`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def learn(docs: DataFrame, labels: DataFrame, cfg: QualityConfig | None = None, held_out=None) -> AttentionMIL:
    """Fits the model on labels whose id is not held out (a function of the id column, crc32 mod 3 = 1 by default).

    Rows of equal doc_id and text count once for each label."""
    cfg = cfg or QualityConfig()
    held = held_out or (lambda c: fold(c, 3) == 1)
    chosen = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .where(~held(F.col("doc_id")))
        .select("doc_id", F.col("quality").cast("int"))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(cfg.learn_documents)
    )

    def run(it):
        import pyarrow as pa

        for batch, texts in words.batches(it):
            x, n = features(texts, cfg)
            cut = np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), pa.array([x[a : a + k].astype(np.float16).tobytes() for a, k in zip(cut.tolist(), n.tolist(), strict=True)], pa.binary())], names=["doc_id", "quality", "h", "n", "x"])

    ship(docs.sparkSession)
    # The sample is at most learn_documents rows of two numbers, so its broadcast has a fixed bound.
    joined = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", F.xxhash64("text").alias("h"), "text")
    bags = joined.mapInArrow(run, "doc_id long, quality int, h long, n long, x binary").groupBy("doc_id", "quality", "h").agg(F.first("n").alias("n"), F.first("x").alias("x"))
    bags = written(bags, "bags")
    # Repeated ids may have made more of them again. A document that no longer fits is passed over, the next ones may fit.
    picked, left = [], cfg.learn_passages
    for r in bags.select("doc_id", "quality", "h", "n").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "h").limit(cfg.learn_documents).collect():
        if r.n <= left:
            picked.append((r.doc_id, r.quality, r.h))
            left -= r.n
    within = docs.sparkSession.createDataFrame(picked, "doc_id long, quality int, h long")
    rows = sorted(bags.join(F.broadcast(within), ["doc_id", "quality", "h"]).collect(), key=lambda r: (r.doc_id, r.quality, r.h))
    width = _CLASSES + cfg.buckets + _EXTRA
    x = [np.frombuffer(r.x, np.float16).reshape(-1, width).astype(np.float32) for r in rows]
    model = AttentionMIL(width, cfg)
    return model.fit(np.concatenate(x) if x else np.zeros((0, width), np.float32), np.array([len(b) for b in x], np.int64), np.array([r.quality for r in rows], np.int64), cfg)


def scored(docs: DataFrame, model: AttentionMIL, cfg: QualityConfig | None = None, name: str = "score") -> DataFrame:
    """All columns of docs plus the score, in one pass without a shuffle."""
    cfg = cfg or QualityConfig()
    ship(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]

    def run(it):
        import pyarrow as pa

        for batch, texts in words.batches(it, "_t"):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score_texts(texts, cfg))], names=[*names, "score"])

    # Columns go by place, so clashing names do no harm.
    plain = docs.toDF(*names).withColumn("_t", F.col(names[docs.columns.index("text")]).cast("string"))
    schema = plain.drop("_t").withColumn("score", F.lit(0.0)).schema
    return plain.mapInArrow(run, schema).toDF(*docs.columns, name)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Quality score of every whole text of `documents`."""
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = learn(docs, table(spark, sf_dir, "labels"))
    found = scored(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
