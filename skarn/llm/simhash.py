"""SimHash near-duplicates, linked through BK-trees.

A fingerprint has a bit set where over half of the document's shingle hashes have it. Distinct fingerprints are
dealt to shards by a few of their bits, so that linked ones meet in a shard; in each shard a BK-tree (children keyed
by their integer Hamming distance to the parent) finds all nodes within the radius by following only edges that the
triangle inequality allows. Shards are cut into trees of a bounded number of nodes; every tree goes to the tasks that
search it with the shuffle instead of a broadcast, because all trees together grow with the data.

Defined results: null text is an empty text; texts without a word have fingerprint zero and link like any other;
repeated rows come back once for each row; a null doc_id is kept, and stands in no component_id unless its whole
component has none; other columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm import similar
from skarn.llm.components import connected_components
from skarn.llm.words import batches
from skarn.runtime import dealt, filtered_early, marked, scratch, ship, table, written


@dataclass(frozen=True)
class SimHashConfig:
    shingle: int = 4
    bits: int = 64
    radius: int = 4
    #: Bit sets (as integers); fingerprints that agree in all bits of a set share a shard. None: `exact_masks`.
    masks: tuple[int, ...] | None = None
    #: Nodes of a tree at most; larger shards are cut, and each part's tree is searched with every part.
    tree_nodes: int = 20_000


def exact_masks(bits: int, radius: int, blocks: int = 6) -> tuple[int, ...]:
    """Masks of which any two fingerprints within the radius agree in at least one.

    The bits fall into `blocks` blocks; `radius` differing bits touch at most `radius` of them."""
    if blocks <= radius:
        raise ValueError("exact masks need more blocks than differing bits")
    cut = [round(i * bits / blocks) for i in range(blocks + 1)]
    block = [sum(1 << b for b in range(cut[i], cut[i + 1])) for i in range(blocks)]
    return tuple(sum(block[i] for i in c) for c in combinations(range(blocks), blocks - radius))


def fingerprint(text: bytes, shingle: int, words: int = 1) -> list[int]:
    """The fingerprint as `words` unsigned 64-bit integers (seeds 42, 43, ...)."""
    import xxhash

    parts = text.lower().split()
    if not parts:
        return [0] * words
    flat = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    k = min(shingle, len(parts))
    last = ends[k - 1 :].tolist()
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    out = []
    for seed in range(42, 42 + words):
        set_bits = np.zeros(64, np.int64)
        for a in range(0, len(last), 65536):
            d = b"".join([xxhash.xxh64_digest(flat[s:e], seed) for s, e in zip(first[a : a + 65536], last[a : a + 65536], strict=True)])
            set_bits += np.unpackbits(np.frombuffer(d, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(set_bits * 2 > len(last)).tobytes(), "big"))
    return out


def fingerprints(docs: DataFrame, cfg: SimHashConfig) -> DataFrame:
    """The columns of docs but `text`, plus the fingerprint's words hi and lo as signed longs (hi is 0 for 64 bits)."""
    if cfg.bits not in (64, 128):
        raise ValueError("fingerprints have 64 or 128 bits")
    kept = [c for c in docs.columns if c != "text"]

    def run(it):
        import pyarrow as pa

        for batch, texts in batches(it):
            fp = np.array([fingerprint(t, cfg.shingle, cfg.bits // 64) for t in texts], np.uint64).reshape(len(texts), -1).view(np.int64)
            hi = fp[:, 0] if cfg.bits == 128 else np.zeros(len(texts), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hi), pa.array(fp[:, -1])], names=[*kept, "hi", "lo"])

    ship(docs.sparkSession)
    plain = docs.select(*kept, F.col("text").cast("string"))
    return plain.mapInArrow(run, plain.drop("text").withColumn("hi", F.lit(0).cast("long")).withColumn("lo", F.lit(0).cast("long")).schema)


class BKTree:
    """Nodes are [fingerprint, {distance: node}]."""

    def __init__(self):
        self.root: list | None = None

    def within(self, x: int, radius: int) -> list[int]:
        found, stack = [], [self.root] if self.root else []
        while stack:
            value, children = stack.pop()
            d = (value ^ x).bit_count()
            if d <= radius:
                found.append(value)
            if children:
                if len(children) <= 2 * radius + 1:
                    stack += [node for edge, node in children.items() if -radius <= edge - d <= radius]
                else:
                    stack += [children[e] for e in range(d - radius, d + radius + 1) if e in children]
        return found

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = [x, {}]
            return
        node = self.root
        while d := (node[0] ^ x).bit_count():
            if d not in node[1]:
                node[1][d] = [x, {}]
                return
            node = node[1][d]


def shard_links(members: list[tuple[int, bool, bool]], radius: int) -> list[tuple[int, int]]:
    """Links that span the components of a shard, one fewer than members for each: (fingerprint, its earliest link).

    members: (fingerprint, is in the tree, is a query). Queries search the tree as far as it is built, then join it;
    those of another part of the shard only search, once the tree stands."""
    tree, parent = BKTree(), {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    links = []
    for x, grows, asks in sorted(members, key=lambda m: not m[1]):
        if asks:
            for y in tree.within(x, radius):
                a, b = root(x), root(y)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    links.append((x, y))
        if grows:
            tree.add(x)
    return links


def links(distinct: DataFrame, cfg: SimHashConfig) -> DataFrame:
    """(a, b): node numbers of linked distinct fingerprints (node, hi, lo), enough links to span each component."""
    ship(distinct.sparkSession)
    masks = cfg.masks or exact_masks(cfg.bits, cfg.radius)

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    low = (1 << 64) - 1
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("hi").bitwiseAND(F.lit(signed(m >> 64))), F.col("lo").bitwiseAND(F.lit(signed(m & low)))) for i, m in enumerate(masks)])
    dealt = distinct.select("node", "hi", "lo", F.explode(keys).alias("shard"))
    # Counted in parts, so that no task holds a shard before it is cut.
    size = written(dealt.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    with filtered_early(distinct.sparkSession):
        dealt = written(dealt.join(marked(size, "shard"), "shard"), "dealt")
    # Only shards that a tree may hold are brought together.
    whole = dealt.where(F.col("n") <= cfg.tree_nodes).select("shard", "node", "hi", "lo", F.lit(True).alias("grows"), F.lit(True).alias("asks")).repartition("shard").sortWithinPartitions("shard")
    # A shard over the bound falls into parts by a hash; the tree of each part is searched by that part and by all later ones.
    over = dealt.where(F.col("n") > cfg.tree_nodes).withColumn("parts", F.ceil(F.col("n") / cfg.tree_nodes).cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = over.select("shard", "node", "hi", "lo", "part", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cut = (
        met.select(F.xxhash64("shard", F.least("part", "other"), F.greatest("part", "other")).alias("shard"), "node", "hi", "lo", (F.col("part") <= F.col("other")).alias("grows"), (F.col("part") >= F.col("other")).alias("asks"))
        .repartition("shard")
        .sortWithinPartitions("shard")
    )
    return _in_shards(whole, cfg).unionByName(_in_shards(cut, cfg)).distinct()


def _in_shards(rows: DataFrame, cfg: SimHashConfig) -> DataFrame:
    """rows: (shard, node, hi, lo, grows, asks), the rows of a shard in one partition."""

    def run(it):
        import pyarrow as pa

        held: list[tuple] = []
        now, out = None, []

        def close():
            if len(held) > 1:
                node = {m[0]: m[3] for m in held}
                out.extend((node[x], node[y]) for x, y in shard_links([m[:3] for m in held], cfg.radius))

        for batch in it:
            cols = [c.to_pylist() for c in batch.columns]
            for shard, node, hi, lo, grows, asks in zip(*cols, strict=True):
                if shard != now:
                    close()
                    held, now = [], shard
                held.append(((hi & _LOW) << 64 | lo & _LOW, grows, asks, node))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
                out = []
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


_LOW = (1 << 64) - 1


def _nodes(docs: DataFrame, cfg: SimHashConfig, least: str) -> tuple[DataFrame, DataFrame]:
    """(fingerprints of docs, their distinct ones as nodes with the smallest `least`), both written."""
    prints = written(fingerprints(docs, cfg), "prints")
    node = F.col("lo") if cfg.bits == 64 else F.xxhash64("hi", "lo")
    return prints, written(prints.groupBy("hi", "lo").agg(F.min(least).alias("least")).withColumn("node", node), "distinct")


def duplicate_groups(docs: DataFrame, cfg: SimHashConfig | None = None) -> DataFrame:
    """For every row its columns but `text`, hi, lo, and root and component_id: one number for each component, and the
    smallest doc_id reachable over links of at most `radius` differing bits, its own included. Exact copies are
    collapsed to one node before any search."""
    cfg = cfg or SimHashConfig()
    prints, distinct = _nodes(docs, cfg, "doc_id")
    roots = connected_components(links(distinct.select("node", "hi", "lo"), cfg))
    rooted = distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Written, so that the join has an exchange on either side and a large component can be split.
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = rooted.join(least, "root").select("hi", "lo", "root", "component_id")
    return prints.join(named, ["hi", "lo"])


def linked_rows(docs: DataFrame, cfg: SimHashConfig) -> DataFrame:
    """(x, y): row numbers of docs (row, text) whose fingerprints are linked, enough to span each component of rows."""
    with scratch(docs.sparkSession):
        return written(_linked_rows(docs, cfg), "linked", keep=True)


def _linked_rows(docs: DataFrame, cfg: SimHashConfig) -> DataFrame:
    prints, distinct = _nodes(docs, cfg, "row")
    same = prints.join(distinct, ["hi", "lo"]).where("row <> least").select(F.col("row").alias("x"), F.col("least").alias("y"))
    of = distinct.select("node", "least")
    ends = links(distinct.select("node", "hi", "lo"), cfg).join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b")
    return same.unionByName(ends.select("x", "y")).distinct()


_MICROS = "yyyy-MM-dd\\'T\\'HH:mm:ss.SSSSSS"


def one_of_each(docs: DataFrame, cfg: similar.SimilarConfig | None = None) -> DataFrame:
    """The rows of docs but for all except one of each group of near-duplicates: the one with the smallest doc_id (a
    null one last; of several the one whose doc_id and text have the smallest hash), and of rows that are alike in both
    the one with the smallest hash of all columns.

    SimHash links (fingerprints of the same shingles, searched through BK-trees) propose which documents to compare
    first. Groups are joined by links that are verified on the shingle sets; links beyond the radius are found, too."""
    cfg = cfg or similar.SimilarConfig()
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    doc, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    row = F.xxhash64(doc, text)
    plain = own.select(doc.cast("long").alias("doc_id"), row.alias("row"), text.cast("string").alias("text"))
    with scratch(docs.sparkSession):
        groups = similar.groups(plain, cfg, linked_rows(plain.select("row", "text"), SimHashConfig(shingle=cfg.shingle)))
        stays = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("x")).select(F.col("x.row").alias("row"))
        stays = written(stays, "stays", keep=True)
    again = own.withColumn("row", row).join(stays, "row")
    # Columns go by place, so no name of theirs clashes with the two that are added. Maps have no order and no hash; these
    # are hashed as they are written.
    unhashed = [n for n, t in own.dtypes if "map<" in t or "variant" in t]
    hashed = ", ".join(n for n in names if n not in unhashed)
    if unhashed:
        hashed += f", to_json(struct({', '.join(unhashed)}), map('ignoreNullFields', 'false', 'timestampFormat', '{_MICROS}XXX', 'timestampNTZFormat', '{_MICROS}'))"
    return again.withColumn("copy", F.expr(f"row_number() over (partition by row, {names[docs.columns.index('doc_id')]}, xxhash64({names[docs.columns.index('text')]}) order by xxhash64({hashed}))")).where("copy = 1").select(*names).toDF(*docs.columns)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole text of `documents`."""
    found = duplicate_groups(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("lo")), 16, "0").alias("fingerprint"), "component_id")
