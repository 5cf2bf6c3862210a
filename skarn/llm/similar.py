"""Groups of documents whose shingle sets are alike: an exact set-similarity join.

A document is the set of its five-word shingles (64-bit hashes; a shorter text is one shingle). Two documents are linked
if the Jaccard similarity of their sets is `similarity` at least; every link is verified on the sets themselves, and
no pair that reaches the similarity is missed, at any input size.

Candidates come from a prefix filter: with the shingles of all sets in one order, sets of n shingles that are similar
enough share one of their first n - ceil(similarity * n) + 1, and from the first one that they share on enough shingles
must be left in both (the place filter). The order goes by how many documents have a shingle's bucket, rarest first, then
by the hash; the counts only make the prefixes selective, any counts give the same links. Equal sets are one node.

Groups are merged before pairs are formed. In a first round each node is verified against one other: the node, of those
at the head of its prefix shingles, that it shares most of them with, where a shingle is headed by the node with most
shared shingles (in a group of near copies that is the text the others were made from); pairs that the caller proposes
are verified, too. Only pairs that still lie in different components meet in the second round, all of them.

Defined results: null text is an empty text; texts without a word are alike; repeated rows come back once for each row;
other columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm import words
from skarn.llm.components import connected_components
from skarn.runtime import filtered_early, marked, scratch, ship, written


@dataclass(frozen=True)
class SimilarConfig:
    similarity: float = 0.8
    shingle: int = 5
    #: Bits of a shingle's bucket in the counts that order the shingles; any number gives the same links.
    count_bits: int = 20

    def least(self, n: int) -> int:
        """ceil(similarity * n), safe from rounding."""
        return math.ceil(round(self.similarity * n, 6))

    def prefix(self, n: int) -> int:
        return n - self.least(n) + 1 if n else 0


def shingle_sets(texts: list[bytes], cfg: SimilarConfig) -> list[np.ndarray]:
    """For each text its distinct shingle hashes in ascending order."""
    out = []
    for w in words.hashed_texts(texts):
        k = min(cfg.shingle, len(w))
        n = len(w) - k + 1 if k else 0
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + n]
        out.append(np.unique(words.mix(h)))
    return out


def alike(a: np.ndarray, b: np.ndarray, cfg: SimilarConfig) -> bool:
    """Whether two shingle sets (ascending, distinct) have the similarity."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both >= cfg.least(len(a) + len(b) - both)


def digest(s: np.ndarray) -> int:
    """A signed number for a set."""
    import xxhash

    x = xxhash.xxh64_intdigest(s.tobytes(), 11)
    return x - (1 << 64) if x >> 63 else x


def _counts(docs: DataFrame, cfg: SimilarConfig) -> np.ndarray:
    """By bucket of the shingle hashes, how many documents have a shingle of it."""
    shift = np.uint64(64 - cfg.count_bits)

    def run(it):
        import pyarrow as pa

        total = np.zeros(1 << cfg.count_bits, np.int64)
        for _, some in words.batches(it):
            for s in shingle_sets(some, cfg):
                np.add.at(total, (s >> shift).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(1 << cfg.count_bits, np.int64)
    got = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def _keyed(docs: DataFrame, counts, cfg: SimilarConfig) -> DataFrame:
    """(doc_id, row, node, size, skipped, keys): a number for each document's set, the set's size, and its prefix from
    the place `skipped` on; keys are 40 bits of the shingle hashes. Of equal sets in a batch the first has keys."""
    shift = np.uint64(64 - cfg.count_bits)

    def run(it):
        import pyarrow as pa

        for batch, some in words.batches(it):
            sets = shingle_sets(some, cfg)
            node, skipped, first = [digest(s) for s in sets], np.zeros(len(sets), np.int32), []
            met: set[int] = set()
            for i, s in enumerate(sets):
                if node[i] in met:
                    first.append(s[:0])
                    continue
                met.add(node[i])
                f = counts.value[(s >> shift).astype(np.int64)]
                order = np.lexsort((s, f))[: cfg.prefix(len(s))]
                # A bucket of one document holds no shingle that another one has; these stand first.
                skipped[i] = int((f[order] < 2).sum())
                first.append(s[order[skipped[i] :]])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in first])]).astype(np.int32)
            key = (np.concatenate(first) & np.uint64((1 << 40) - 1)).astype(np.int64)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(node, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(skipped), keys], names=["doc_id", "row", "node", "size", "skipped", "keys"])

    return docs.mapInArrow(run, "doc_id long, row long, node long, size int, skipped int, keys array<long>")


def _shared(keyed: DataFrame) -> DataFrame:
    """(key, node, size, place): the prefix shingles that several documents have, and the place of each in its prefix."""
    spark = keyed.sparkSession
    prefix = keyed.where("size(keys) > 0").select("node", "size", "skipped", F.posexplode("keys").alias("place", "key"))
    met = written(prefix.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "met")
    with filtered_early(spark):
        twice = written(prefix.select("key", "node", "size", (F.col("place") + F.col("skipped")).alias("place")).join(marked(met, "key"), "key"), "prefix")
    # Copies in different batches have brought their node's prefix more than once. Two shingles of a set that have the
    # same key count from the place of the first.
    return written(twice.groupBy("key", "node").agg(F.first("size").alias("size"), F.min("place").alias("place")), "shared")


def _texts(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, text) of the nodes of pairs (a, b); nodes (node, row) name a row for each."""
    wanted = written(nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node"), "wanted")
    with filtered_early(docs.sparkSession):
        found = docs.select("row", "text").join(marked(wanted, "row"), "row").select("node", "text")
        # Repeated rows have the same number, and each of them has come along.
        return written(found.dropDuplicates(["node"]), "texts")


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, cfg: SimilarConfig) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have the similarity."""

    def run(it):
        import pyarrow as pa

        held: tuple = (None, None)
        for batch, left in words.batches(it, "left"):
            a, b = (np.asarray(batch.column(i), np.int64) for i in (0, 1))
            right = shingle_sets([(x or "").encode() for x in batch.column(3).to_pylist()], cfg)
            good = np.zeros(len(a), bool)
            for i, node in enumerate(a.tolist()):
                # The pairs of a node come in a row.
                if held[0] != node:
                    held = (node, shingle_sets([left[i]], cfg)[0])
                good[i] = alike(held[1], right[i], cfg)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    texts = _texts(docs, nodes, pairs)
    with_right = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")
    both = with_right.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a").select("a", "b", "left", "right")
    return both.mapInArrow(run, "a long, b long")


def _to_heads(shared: DataFrame, similarity: float) -> DataFrame:
    """(a, b): for each node the one head of its prefix shingles that it shares most of them with."""
    scored = shared.join(shared.groupBy("node").agg(F.count("*").alias("score")), "node")
    heads = scored.groupBy("key").agg(F.max(F.struct("score", "node", "size")).alias("head"))
    each = shared.join(heads, "key").where(f"head.node <> node and least(size, head.size) >= {similarity} * greatest(size, head.size)")
    times = each.groupBy("node", F.col("head.node").alias("other")).agg(F.count("*").alias("times"))
    return times.groupBy("node").agg(F.max(F.struct("times", "other")).alias("x")).select(F.least("node", "x.other").alias("a"), F.greatest("node", "x.other").alias("b")).distinct()


def components(docs: DataFrame, keyed: DataFrame, proposed: DataFrame | None, cfg: SimilarConfig) -> DataFrame:
    """(node, root): the components of verified links, of nodes that have any."""
    s = cfg.similarity - 1e-9
    nodes = keyed.groupBy("node").agg(F.min("row").alias("row"))
    shared = _shared(keyed)
    first = _to_heads(shared, s)
    if proposed is not None:
        of = keyed.select("row", "node").distinct()
        ends = proposed.join(of.toDF("x", "a"), "x").join(of.toDF("y", "b"), "y").where("a <> b")
        first = first.unionByName(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    first = written(first, "first")
    roots = connected_components(_verified(docs, nodes, first, cfg))
    parted = written(shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "parted")
    mixed = parted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    parted = written(parted.join(mixed, "key"), "mixed")
    one, other = (parted.select("key", *(F.col(c).alias(f"{c}_{n}") for c in ("node", "size", "place", "root"))) for n in ("a", "b"))
    # So many shingles two sets of these sizes share at least; from the place of the first one they share, both have them.
    need = f"ceil(round((size_a + size_b) * {cfg.similarity / (1 + cfg.similarity)}, 6))"
    rest = one.join(other, "key").where(f"node_a < node_b and root_a <> root_b and least(size_a, size_b) >= {s} * greatest(size_a, size_b) and least(size_a - place_a, size_b - place_b) >= {need}")
    rest = written(rest.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct().join(first, ["a", "b"], "left_anti"), "rest")
    # What the first round has joined is a star already.
    return connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_verified(docs, nodes, rest, cfg)))


def groups(docs: DataFrame, cfg: SimilarConfig | None = None, proposed: DataFrame | None = None) -> DataFrame:
    """(doc_id, row, root) for every row of docs (doc_id long, row long, text string): one number for each component
    of verified links. Rows of equal doc_id and text have the same row number.

    proposed: (x, y), row numbers of rows that may be alike, for the first round; they change the work and no result."""
    cfg = cfg or SimilarConfig()
    ship(docs.sparkSession)
    with scratch(docs.sparkSession):
        counts = docs.sparkSession.sparkContext.broadcast(_counts(docs, cfg))
        keyed = written(_keyed(docs, counts, cfg), "keyed")
        roots = components(docs, keyed, proposed, cfg)
        return written(keyed.select("doc_id", "row", "node").join(roots, "node", "left").select("doc_id", "row", F.coalesce("root", "node").alias("root")), "groups", keep=True)
