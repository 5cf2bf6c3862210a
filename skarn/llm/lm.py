"""Language-model scoring: a causal self-attention model on subword ids, and a word-count base beside it.

The model predicts the class of the next subword from a window of earlier ones and then the subword within its class,
given the class of the one before. Windows overlap: a text is cut into blocks, every block is scored once, attending
causally to itself and to the block before it, many windows at a time under one mask.

All of it is learned from all training documents, whole. Classes come from how often each subword stands beside others
(summed over the corpus in buckets), the second factor and the output layer's start from how often each subword follows
each class: these are counts over every place of every text. For the attention weights every task starts from the same
ones and takes Adam steps over windows of each of its documents, and the tasks' weights are averaged by their numbers of
windows. Every window of every training document takes part, so the steps grow with the corpus and behave alike at
every size. After its first steps, over single windows from all over its texts, a task takes neighbouring windows in
runs, which share the keys and values of their blocks. (A caller may set `every`: then one window in so many of a
document does, spread evenly over the whole text from a place that its content decides, and one of each at least.)

The base adds, over the words of a text and one end, the logarithms of add-one estimates from word counts over all
training documents. Words are told apart by 64-bit hashes. Frequent words, at most `head` of them, are looked up where
the text is; all others are joined, so no table that grows with the corpus is broadcast.

Defined results: null text is an empty text, which is one end; repeated rows come back once for each row; a null doc_id
counts as the empty text in the fold rule; with no training document every count is 0 and subwords are equally likely;
other columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import copy
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm import words
from skarn.llm.subwords import subwords
from skarn.runtime import dealt, ship, table, written


@dataclass(frozen=True)
class LMConfig:
    tokenizer: str | None = None
    vocabulary: int = 49408
    #: This id stands before and after each text; as a prediction it means the end.
    edge: int = 49407
    classes: int = 48
    block: int = 16
    width: int = 8
    #: Ids with an embedding of their own; rarer ones share by remainder.
    own: int = 4096
    shared: int = 512
    embedding: int = 16
    #: Buckets of the neighbours on either side by which ids are put into classes.
    neighbours: int = 24
    #: Passes over all training documents, and of which windows of each one is learned from; 1 takes all of them.
    passes: int = 1
    every: int = 1
    #: Windows of a gradient step, and its rate.
    batch: int = 256
    #: Neighbouring windows that a step takes together, once a task has taken so many steps over single ones.
    run: int = 16
    settled: int = 64
    rate: float = 8e-3
    #: Weight of the within-class distribution beside the counts after a class.
    prior: float = 20.0
    #: Words that are looked up in a broadcast table at most.
    head: int = 500_000
    #: Subwords that a task learns from or scores at once, but for a longer text.
    held: int = 1 << 17
    #: Tasks that add up weights.
    sums: int = 16


_MOST = np.float32(40)


def _by_slot(slot: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """The sum of the rows of x for each slot."""
    # Numbers of two bytes are sorted by counting.
    order = np.argsort(slot.astype(np.uint16) if n <= 1 << 16 else slot, kind="stable")
    ranked = slot.take(order)
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    out = np.zeros((n, x.shape[1]), x.dtype)
    # Two columns are added at once, as a complex one.
    two = np.ascontiguousarray(x).view(np.complex64) if x.dtype == np.float32 and x.shape[1] % 2 == 0 else x
    out.view(two.dtype)[ranked[first]] = np.add.reduceat(two.take(order, 0), first, axis=0)
    return out


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, by a product: numpy's own sum over a short axis is several times slower."""
    return (x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], np.float32)).reshape(*x.shape[:-1], 1)


def _clipped(x: np.ndarray) -> None:
    """To the model's bounds; it is seldom outside, and looking costs less than writing."""
    if x.max(initial=0) > _MOST or x.min(initial=0) < -_MOST:
        np.clip(x, -_MOST, _MOST, out=x)


class AttentionLM:
    """Weights and tables of the model."""

    def __init__(self, cfg: LMConfig, after: np.ndarray, class_of: np.ndarray):
        """after[a, i]: how often id i follows an id of class a; class_of: the classes of all ids."""
        self.cfg, self.class_of = cfg, class_of
        g = np.random.default_rng(3)
        counts = after.sum(0)
        smooth = counts.astype(np.float64) + 0.5
        within = smooth / np.bincount(class_of, smooth, cfg.classes)[class_of]
        follows = np.stack([np.bincount(class_of, row, cfg.classes) for row in after])
        self.within = np.log10((after + cfg.prior * within) / (follows[:, class_of] + cfg.prior)).astype(np.float32)
        rank = np.empty(cfg.vocabulary, np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(cfg.vocabulary)
        self.slot = np.where(rank < cfg.own, rank, cfg.own + np.arange(cfg.vocabulary) % cfg.shared)
        next_ = follows + 0.5 * (follows.sum(0) + 1) / max(1.0, follows.sum() + cfg.classes)
        n, e, d, c = cfg.own + cfg.shared, cfg.embedding, cfg.width, cfg.classes
        w = 2 * cfg.block
        # The output layers start at zero: before any step the model is the class counts alone.
        self.p = {
            "E": g.normal(0, 0.3, (n, e)), "q": g.normal(0, e**-0.5, (e, d)), "k": g.normal(0, e**-0.5, (e, d)), "v": g.normal(0, e**-0.5, (e, d)),
            "o": np.zeros((d, c)), "u": np.zeros((e, c)), "b": np.log(next_ / next_.sum(1, keepdims=True)), "r": -0.05 * np.arange(w),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        at = np.arange(cfg.block)[:, None] + cfg.block - np.arange(w)[None]
        self.distance, self.future = np.clip(at, 0, w - 1), at < 0
        self.adam, self.step = np.zeros((2, sum(v.size for v in self.p.values())), np.float32), 0
        #: Windows that the last pass has learned from.
        self.learned = 0
        self.freeze()

    def freeze(self) -> None:
        """Tables by embedding slot, for scores."""
        p, scale = self.p, np.float32(self.cfg.width**-0.5)
        self.tables = (p["E"] @ p["q"] * scale, p["E"] @ p["k"], p["E"] @ p["v"], p["E"] @ p["u"])
        self.both = np.concatenate(self.tables[1:3], 1)

    def windows(self, texts: list[np.ndarray]):
        """(inputs, targets, first block of a text, blocks by text) of texts; -1 where a text has ended."""
        m = self.cfg.block
        size = np.array([len(t) + 1 for t in texts], np.int64)
        blocks = -(-size // m)
        first = np.cumsum(blocks) - blocks
        inputs, targets = (np.full(int(blocks.sum()) * m, v, np.int32) for v in (self.cfg.edge, -1))
        at = np.repeat(first * m - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        ends = np.cumsum(size) - 1
        flat = np.full(int(size.sum()), self.cfg.edge, np.int32)
        keep = np.ones(len(flat), bool)
        keep[ends] = False
        flat[keep] = np.concatenate(texts) if len(texts) else 0
        targets[at] = flat
        inputs[at[1:]] = flat[:-1]
        inputs[first * m] = self.cfg.edge
        return inputs.reshape(-1, m), targets.reshape(-1, m), first, blocks

    def attend(self, q: np.ndarray, kv: np.ndarray, begins: np.ndarray):
        """Powers, the inverse of their sums and attention outputs of blocks, from the queries of their places and the keys
        and values of these and of the blocks before them (masked where a text begins)."""
        d, m = self.cfg.width, self.cfg.block
        s = np.matmul(q, kv[..., :d].swapaxes(-1, -2))
        s += np.where(self.future, np.float32(-1e4), self.p["r"][self.distance])
        s[begins, :, :m] = -1e4
        # Part of the model: no score counts for more than this, so no power overflows.
        if s.max(initial=0) > _MOST:
            np.minimum(s, _MOST, out=s)
        np.exp(s, out=s)
        inverse = 1 / _sums(s)
        # Outputs are a quarter as wide as the powers: these are left as they are.
        out = np.matmul(s, kv[..., d:])
        out *= inverse
        return s, inverse, out

    def pairs(self, runs: np.ndarray) -> np.ndarray:
        """Of runs of places (n, places, x), each block beside the one before it: (n, blocks - 1, two blocks, x), not copied."""
        m, (n, places, x), (by_run, by_place, by_x) = self.cfg.block, runs.shape, runs.strides
        return np.ndarray((n, places // m - 1, 2 * m, x), runs.dtype, runs, 0, (by_run, m * by_place, by_place, by_x))

    def score(self, texts: list[np.ndarray], most: int = 256) -> np.ndarray:
        """log10 probability of each text, its end included."""
        inputs, targets, first, _ = self.windows(texts)
        begins = np.zeros(len(inputs), bool)
        begins[first] = True
        m, c = self.cfg.block, self.cfg.classes
        # The block before the first one is masked: the text's own stands for it.
        slots, kinds = self.slot.take(np.concatenate([inputs[:1], inputs])), self.class_of.take(inputs)
        total = np.zeros(len(inputs))
        for a in range(0, len(inputs), most):
            y, run, kind = targets[a : a + most], slots[a : a + most + 1].reshape(-1), kinds[a : a + most]
            own = run[m:]
            q, kv = self.tables[0].take(own, 0).reshape(-1, m, self.cfg.width), self.pairs(self.both.take(run, 0)[None])[0]
            _, _, out = self.attend(q, kv, begins[a : a + most])
            logit = out.reshape(-1, self.cfg.width) @ self.p["o"]
            logit += self.tables[3].take(own, 0)
            logit += self.p["b"].take(kind.reshape(-1), 0)
            _clipped(logit)
            there = y >= 0
            safe = np.where(there, y, 0)
            hit = logit.reshape(-1).take(np.arange(0, logit.size, c) + self.class_of.take(safe).reshape(-1)).reshape(y.shape)
            np.exp(logit, out=logit)
            within = self.within.reshape(-1).take(kind * self.cfg.vocabulary + safe)
            each = (hit - np.log(_sums(logit)).reshape(y.shape)) * np.float32(0.4342944819) + within
            total[a : a + most] = np.where(there, each, 0).sum(1, dtype=np.float64)
        return np.add.reduceat(total, first) if len(texts) else np.zeros(0)

    def gradients(self, x: np.ndarray, y: np.ndarray, before: np.ndarray, begins: np.ndarray, most: int = 256) -> dict[str, np.ndarray]:
        """Of the mean loss of the class predictions of some runs of blocks, each with the block before it. They are taken
        about `most` blocks at a time, so that what one operation leaves is still in the cache for the next, and summed up."""
        cfg, p, m, d = self.cfg, self.p, self.cfg.block, self.cfg.width
        flat = lambda a: a.reshape(-1, a.shape[-1])
        # Keys and values come of one product, and so do both parts of the output layer.
        scaled, kv, ou = p["q"] * np.float32(d**-0.5), np.concatenate([p["k"], p["v"]], 1), np.concatenate([p["o"], p["u"]])
        slots, kinds = self.slot.take(np.concatenate([before, x], 1)), self.class_of.take(x)
        there, long = y >= 0, x.shape[1] // m
        goal, each = self.class_of.take(np.where(there, y, 0)), (there / np.float32(max(1, there.sum()))).astype(np.float32)
        begins = begins.reshape(len(x), long)
        g_e, g_b = (np.empty((*a.shape, n), ou.dtype) for a, n in ((slots, cfg.embedding), (x, cfg.classes)))
        g_q, g_kv, g_ou, g_r = (np.zeros_like(a) for a in (scaled, kv, ou, self.distance.astype(ou.dtype)))
        step = max(1, most // long)
        for a in range(0, len(x), step):
            part = slice(a, a + step)
            e = p["E"].take(slots[part], 0)
            n = len(e)
            both = (flat(e) @ kv).reshape(n, -1, 2 * d)
            # Outputs of the attention beside the embeddings of the places themselves.
            last = np.empty((n, long * m, d + cfg.embedding), e.dtype)
            last[..., d:] = e[:, m:]
            cur = e[:, m:].reshape(-1, cfg.embedding)
            q, seen = (cur @ scaled).reshape(n, long, m, d), self.pairs(both)
            s, inverse, out = self.attend(q, seen, begins[part])
            last[..., :d] = out.reshape(n, -1, d)
            dl = np.matmul(flat(last), ou, out=flat(g_b[part]))
            dl += p["b"].take(kinds[part].reshape(-1), 0)
            _clipped(dl)
            np.exp(dl, out=dl)
            w = each[part].reshape(-1, 1)
            dl *= w / _sums(dl)
            dl.reshape(-1)[np.arange(0, dl.size, cfg.classes) + goal[part].reshape(-1)] -= w[:, 0]
            g_ou += flat(last).T @ dl
            d_last = dl @ ou.T
            d_out = d_last[:, :d].reshape(out.shape) * inverse
            ds = np.matmul(d_out, seen[..., d:].swapaxes(-1, -2))
            # The mean of these under the attention is the product of both outputs.
            ds -= _sums(d_out * out)
            ds *= s
            # A block's own keys and values, and those of the block before: each lies in two windows of its run.
            d_kv, d_both = np.empty(seen.shape, both.dtype), np.empty_like(both)
            np.matmul(ds.swapaxes(-1, -2), q, out=d_kv[..., :d])
            np.matmul(s.swapaxes(-1, -2), d_out, out=d_kv[..., d:])
            by = d_both.reshape(n, long + 1, m, -1)
            by[:, :-1] = d_kv[:, :, :m]
            by[:, -1] = 0
            by[:, 1:] += d_kv[:, :, m:]
            dq = np.matmul(ds, seen[..., :d]).reshape(-1, d)
            g_q += cur.T @ dq
            g_kv += flat(e).T @ flat(d_both)
            g_r += ds.reshape(-1, *g_r.shape).sum(0)
            np.matmul(flat(d_both), kv.T, out=flat(g_e[part]))
            dq = dq @ scaled.T
            dq += d_last[:, d:]
            g_e[part, m:] += dq.reshape(n, -1, cfg.embedding)
        grad = {"E": _by_slot(slots.reshape(-1), flat(g_e), len(p["E"])), "q": g_q * np.float32(d**-0.5), "k": g_kv[:, :d], "v": g_kv[:, d:], "o": g_ou[:d], "u": g_ou[d:]}
        grad["b"] = _by_slot(kinds.reshape(-1), flat(g_b), cfg.classes)
        grad["r"] = np.bincount(self.distance[~self.future], g_r[~self.future], 2 * m).astype(np.float32)
        return grad

    def learn(self, texts: list[np.ndarray]) -> int:
        """Adam steps over one block in `every` of some texts, in a fixed random order; the number of blocks."""
        if not texts:
            return 0
        cfg, p = self.cfg, self.p
        inputs, targets, first, blocks = self.windows(texts)
        begins = np.zeros(len(inputs), bool)
        begins[first] = True
        before = np.roll(inputs, 1, axis=0)
        if cfg.every > 1:
            # The first block of a text decides where its series of blocks starts; a shorter text takes part with one of its own.
            start = (inputs[first].astype(np.int64) * np.arange(1, 2 * cfg.block, 2)).sum(1) % np.minimum(cfg.every, blocks)
            chosen = np.flatnonzero((np.arange(len(inputs)) - np.repeat(first, blocks)) % cfg.every == np.repeat(start, blocks))
            inputs, targets, before, begins, run = inputs[chosen], targets[chosen], before[chosen], begins[chosen], 1
        else:
            run = min(cfg.run, cfg.batch) if self.step >= cfg.settled else 1
        total = len(inputs)
        # Runs of neighbours share the keys and values of their blocks; the last one is filled up with blocks of no target.
        # First steps, which move the weights most, take windows from all over the texts.
        more = -total % run
        inputs, targets, begins = (np.concatenate([a, np.full((more, *a.shape[1:]), v, a.dtype)]) for a, v in ((inputs, cfg.edge), (targets, -1), (begins, True)))
        inputs, targets, before, begins = inputs.reshape(-1, run * cfg.block), targets.reshape(-1, run * cfg.block), before[::run], begins.reshape(-1, run)
        order, batch = np.random.default_rng(4).permutation(len(inputs)), max(1, cfg.batch // run)
        # All weights in a row, and views of them by name: a step is a few operations on the whole.
        flat = self.packed().astype(np.float32)
        cut = np.cumsum([v.size for v in p.values()])[:-1]
        for k, v in zip(p, np.split(flat, cut), strict=True):
            p[k] = v.reshape(p[k].shape)
        # The moments are ten and a hundred times Adam's own, which spares two products.
        m1, m2 = self.adam
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            grad = self.gradients(inputs[rows], targets[rows], before[rows], begins[rows])
            g = np.concatenate([grad[k].reshape(-1) for k in p])
            self.step += 1
            # The rate falls with the steps of a task, so that the weights settle.
            rate = np.float32(cfg.rate / (1 + self.step / 1000) * (1 - 0.99**self.step) ** 0.5 / (1 - 0.9**self.step))
            m1 *= np.float32(0.9)
            m1 += g
            m2 *= np.float32(0.99)
            g *= g
            m2 += g
            np.sqrt(m2, out=g)
            g += np.float32(1e-7)
            np.divide(m1, g, out=g)
            g *= rate
            flat -= g
        self.freeze()
        return total

    def fit(self, texts: list[np.ndarray]) -> AttentionLM:
        for _ in range(self.cfg.passes):
            self.learn(texts)
        return self

    def fresh(self) -> AttentionLM:
        """A model of its own weights, with no steps taken."""
        own = copy.copy(self)
        own.p = {k: v.copy() for k, v in self.p.items()}
        own.adam, own.step = np.zeros_like(self.adam), 0
        return own

    def packed(self) -> np.ndarray:
        return np.concatenate([v.reshape(-1) for v in self.p.values()]).astype(np.float64)

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        self.freeze()


def classes(beside: np.ndarray, cfg: LMConfig) -> np.ndarray:
    """A class for every id from the counts of its neighbours' buckets (vocabulary x buckets before and after): ids with
    like neighbours share one (k-means on the roots of the shares); ids that were never seen get the last."""
    n = beside.sum(1)
    out, seen = np.full(cfg.vocabulary, cfg.classes - 1, np.int64), np.flatnonzero(n)
    if not len(seen):
        return out
    x = np.sqrt(beside[seen] / n[seen, None]).astype(np.float32)
    x -= np.sqrt(beside.sum(0) / n.sum()).astype(np.float32)
    x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
    k = min(cfg.classes - 1, len(seen))
    weight = np.sqrt(n[seen]).astype(np.float32)
    centre = x[np.argsort(-n[seen], kind="stable")[:k]].copy()
    for _ in range(12):
        own = np.argmax(x @ centre.T, 1)
        for j in range(k):
            if (own == j).any():
                c = (x[own == j] * weight[own == j, None]).sum(0)
                centre[j] = c / max(1e-9, float(np.linalg.norm(c)))
    out[seen] = np.argmax(x @ centre.T, 1)
    return out


def _ids(column, most: int):
    """Lists of id arrays of about `most` ids together, in the order of an Arrow binary column."""
    held, n = [], 0
    for x in column:
        ids = np.frombuffer(x.as_py() or b"", "<u2")
        if held and n + len(ids) > most:
            yield held
            held, n = [], 0
        held.append(ids)
        n += len(ids) + 1
    if held:
        yield held


def _summed(training: DataFrame, index, size: int, cfg: LMConfig) -> np.ndarray:
    """Counts over all neighbouring ids of all training rows (ids), edges included: index(before, after) gives arrays of
    places below `size`. Each task sends every place at most once."""

    def run(it):
        import pyarrow as pa

        n = np.zeros(size, np.int64)
        for batch in it:
            # Each count costs a pass over all places, so many ids are counted at once.
            for texts in _ids(batch.column(0), 16 * cfg.held):
                begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
                flat, inside = np.full(begin[-1] + 1, cfg.edge, np.int64), np.ones(begin[-1] + 1, bool)
                inside[begin] = False
                flat[inside] = np.concatenate(texts)
                for places in index(flat[:-1], flat[1:]):
                    n += np.bincount(places, minlength=size)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["i", "n"])

    out = np.zeros(size, np.int64)
    got = training.select("ids").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("i").to_numpy()] = got.column("n").to_numpy()
    return out


def learned(tokens: DataFrame, cfg: LMConfig) -> AttentionLM:
    """The model of the token rows (held_out, ids) that are not held out."""
    training, c, v, b = tokens.where("not held_out").select("ids"), cfg.classes, cfg.vocabulary, cfg.neighbours

    bucket = (np.arange(v) * 2654435761 >> 9) % b

    def beside(left, right):
        yield right * (2 * b) + bucket.take(left)
        yield left * (2 * b) + b + bucket.take(right)

    sc = tokens.sparkSession.sparkContext
    class_of = classes(_summed(training, beside, 2 * b * v, cfg).reshape(v, -1), cfg)
    sent = sc.broadcast(class_of)
    after = _summed(training, lambda left, right: [sent.value.take(left) * v + right], c * v, cfg)
    model = AttentionLM(cfg, after.reshape(c, v), class_of)
    for _ in range(cfg.passes):
        model.learned = _round(training, model, cfg)
    return model


def _round(training: DataFrame, model: AttentionLM, cfg: LMConfig) -> int:
    """One pass over all training windows: every task's steps from the model's weights, then their mean. Returns the
    number of windows."""
    sent = training.sparkSession.sparkContext.broadcast(model)

    def steps(it):
        import pyarrow as pa

        own, n = sent.value.fresh(), 0
        for batch in it:
            for texts in _ids(batch.column(0), cfg.held):
                n += own.learn(texts)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([(own.packed() * n).tobytes()], pa.binary())], names=["n", "w"])

    def add(it):
        import pyarrow as pa

        n, total = 0, None
        for batch in it:
            for k, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, total = n + k, np.frombuffer(w) + (0 if total is None else total)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], names=["n", "w"])

    each = training.mapInArrow(steps, "n long, w binary").withColumn("part", F.spark_partition_id())
    # At most `sums` sums reach the driver.
    rows = each.repartition(cfg.sums, "part").select("n", "w").mapInArrow(add, "n long, w binary").collect()
    n = sum(r.n for r in rows)
    if n:
        model.unpack(sum(np.frombuffer(r.w) for r in rows) / n)
    return n


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, c): hash and count of every word of docs (text)."""

    def run(it):
        import pyarrow as pa

        for _, texts in words.batches(it):
            flat = np.concatenate(words.hashed_texts(texts))
            w, c = np.unique(flat, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c)], names=["w", "c"])

    return docs.select("text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def _looked_up(texts: list[bytes], known: np.ndarray, value: np.ndarray, direct: words.Direct):
    """For each text its words, how many are known, and the sum of their values; then the other words' hashes and how
    often each occurs, all in a row, and where each text's begin. direct holds places of known words."""
    found = words.hashed_texts(texts)
    size = np.array([len(f) for f in found], np.int64)
    h = np.concatenate(found)
    at, common = direct.get(h)
    # Only words that are not met at their own place are sorted.
    left = np.flatnonzero(~common)
    w, inverse = np.unique(h.take(left), return_inverse=True)
    place = np.searchsorted(known, w)
    place[place == len(known)] = 0
    hit = known[place] == w if len(known) else np.zeros(len(w), bool)
    direct.put(w[hit], place[hit])
    common[left] = hit[inverse]
    at[left] = place[inverse]
    doc = np.repeat(np.arange(len(texts)), size)
    log = value.take(at[common]) if len(known) else np.zeros(0)
    seen = np.bincount(doc[common], minlength=len(texts))
    sums = np.bincount(doc[common], weights=log, minlength=len(texts)).astype(np.float64)
    inverse = inverse[~hit[inverse]]
    rare = np.sort(doc[~common] * (1 << 32) + inverse)
    new = np.ones(len(rare), bool)
    new[1:] = rare[1:] != rare[:-1]
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(rare)))
    cut = np.searchsorted(rare[first] >> 32, np.arange(len(texts) + 1))
    return size, seen, sums, w[rare[first] & 0xFFFFFFFF].view(np.int64), times.astype(np.int32), cut.astype(np.int32)


def token_table(docs: DataFrame, known, cfg: LMConfig) -> DataFrame:
    """docs (doc_id, held_out, text) with n_tokens, the words looked up in known (hashes, values), the others as arrays
    w and k, the subword ids of two bytes each, and a number uid for each row."""

    def run(it):
        import pyarrow as pa

        subword, direct = subwords(cfg.tokenizer), words.Direct()
        direct.put(known.value[0], np.arange(len(known.value[0])))
        for batch, texts in words.batches(it, most=3 << 20):
            size, seen, sums, w, k, cut = _looked_up(texts, *known.value, direct)
            flat, count = subword(texts)
            flat, ends = flat.astype("<u2"), np.concatenate([[0], np.cumsum(count)])
            ids = pa.array([flat[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (w, k)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(size + 1), pa.array(seen), pa.array(sums), *lists, ids], names=["doc_id", "held_out", "n_tokens", "seen", "sums", "w", "k", "ids"])

    found = docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, seen long, sums double, w array<long>, k array<int>, ids binary")
    # Once written, the numbers stay.
    return written(found.withColumn("uid", F.monotonically_increasing_id()), "tokens")


def model_scores(tokens: DataFrame, model: AttentionLM, cfg: LMConfig) -> DataFrame:
    """The columns of tokens but ids, plus the score."""
    sent = tokens.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in tokens.columns if c != "ids"]

    def run(it):
        import pyarrow as pa

        for batch in it:
            score = [sent.value.score(texts) for texts in _ids(batch.column(len(kept)), cfg.held)]
            if score:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(score))], names=[*kept, "score"])

    schema = tokens.select(*kept).withColumn("score", F.lit(0.0)).schema
    return tokens.select(*kept, "ids").mapInArrow(run, schema)


def scored(docs: DataFrame, held_out, cfg: LMConfig | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, text);
    held_out is a condition on them."""
    cfg = cfg or LMConfig()
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    counts = written(word_counts(rows.where("not held_out")), "counts")
    ends = rows.where("not held_out").count()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = total + ends, distinct + (ends > 0)
    # The lowest count from which at most `head` words are left; counts above the cap are few.
    cap, left, least = 1 << 16, cfg.head, 1 << 62
    for r in counts.groupBy(F.least("c", F.lit(cap)).alias("c")).agg(F.count("*").alias("k")).orderBy(F.desc("c")).collect():
        if r.k > left:
            break
        left, least = left - r.k, r.c
    head = counts.where(F.col("c") >= least).toArrow()
    w = head.column("w").to_numpy().view(np.uint64)
    by = np.argsort(w)
    known = spark.sparkContext.broadcast((w[by], np.log10(head.column("c").to_numpy()[by] + 1.0)))
    tokens = token_table(rows, known, cfg)
    near = model_scores(tokens.select("uid", "doc_id", "held_out", "n_tokens", "seen", "sums", "ids"), learned(tokens, cfg), cfg)
    rare = tokens.where("size(w) > 0").select("uid", F.explode(F.arrays_zip("w", "k")).alias("x")).select("uid", F.col("x.w").alias("w"), F.col("x.k").alias("k"))
    far = rare.join(counts.where(F.col("c") < least), "w").groupBy("uid").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("far"))
    known_words = F.col("seen") + F.coalesce("more", F.lit(0)) + (1 if ends else 0)
    base = F.col("sums") + F.coalesce("far", F.lit(0.0)) + F.lit(float(np.log10(ends + 1))) - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    both = near.join(far, "uid", "left")
    return both.select("doc_id", "held_out", "n_tokens", known_words.cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op7_lm(spark, sf_dir: str) -> DataFrame:
    """Base and model scores of every whole text of `documents`."""
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2)
