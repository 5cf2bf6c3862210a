"""Document fingerprints from spot signatures.

Common words are anchors: they stand everywhere in running text and hardly in menus, lists and code. An anchor and the
next content words after it (words that are no anchors) are a spot signature; a document's fingerprint is the set of its
signatures, each a 64-bit hash. Likeness is the Jaccard similarity of two sets.

Near copies are found by set length: two sets can only reach a likeness t if the shorter one has t times the length of the
longer one at least, so lengths fall into bands of ratio t and a set meets its own band and the one below. Within a band
sets meet by the signatures of their prefix, rarest first: sets alike enough share one of them. What meets is compared
by merging, which ends once what is left of both cannot reach the likeness any more.

Words are runs of letters and digits, A-Z lower-cased. Defined results: null text is an empty text; a text without a word
has the empty set, and two empty sets have likeness 1; a text with words and without an anchor has one signature, of its
first words; an anchor near the end takes the content words that are left; repeated rows come back once for each row;
null ids are carried and come last in the order of documents; other columns are ignored; an empty table gives an empty
result."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm import words
from skarn.llm.components import connected_components
from skarn.runtime import dealt, parallelism, ship, table, written

# Common words of English, German, French and Spanish.
COMMON = (
    "the of and to in is that it was for on are as with his they be at this have from or had by but not what all were we when there can an your which their if will each about how up out then them she many some so these would other into has her two him see could no than been its who did get may down only",
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde",
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ou mais comme tout nous sa aux leur elle cette ses été fait être deux même aussi ont",
    "el que y los se del las por con no para una su al lo más o pero sus le ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante",
)


@dataclass(frozen=True)
class SpotConfig:
    #: Anchors; None: the common words above.
    anchors: tuple[str, ...] | None = None
    #: Content words in a signature.
    chain: int = 2
    similarity: float = 0.8

    def least(self, n: int) -> int:
        """ceil(similarity * n), safe from rounding."""
        return math.ceil(round(self.similarity * n, 6))


_MIX = np.uint64(0x9E3779B97F4A7C15)


class Spotter:
    """Sets of spot signatures of many texts at once."""

    def __init__(self, cfg: SpotConfig):
        known = cfg.anchors if cfg.anchors is not None else [w for line in COMMON for w in line.split()]
        self.chain = cfg.chain
        self.anchors = np.unique(np.concatenate(words.hashed_texts([w.encode() for w in known], between=words.NOT_ALNUM))) if known else np.zeros(0, np.uint64)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each text its distinct signatures in ascending order."""
        tokens = words.hashed_texts(texts, between=words.NOT_ALNUM)
        size = np.array([len(t) for t in tokens], np.int64)
        flat, owner = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64), np.repeat(np.arange(len(texts)), size)
        at = np.minimum(np.searchsorted(self.anchors, flat), max(len(self.anchors) - 1, 0))
        anchor = self.anchors[at] == flat if len(self.anchors) else np.zeros(len(flat), bool)
        content = np.flatnonzero(~anchor)
        spots = np.flatnonzero(anchor)
        # The first content word after each anchor, and those that follow it in the same text.
        first = np.searchsorted(content, spots)
        h = flat[spots] * _MIX + np.uint64(1)
        length = np.zeros(len(spots), np.int64)
        padded, whose = np.append(content, np.zeros(self.chain, np.int64)), np.append(owner[content], np.full(self.chain, -1))
        for k in range(self.chain):
            own = whose[first + k] == owner[spots]
            h = np.where(own, h * _MIX + flat[padded[first + k]] if len(flat) else h, h)
            length += own
        keep = length > 0
        h, whose = words.mix(h[keep]), owner[spots[keep]]
        # Texts with words and without a signature: their first words.
        bare = np.flatnonzero((np.bincount(whose, minlength=len(texts)) == 0) & (size > 0))
        begin, more = np.cumsum(size) - size, []
        for i in bare.tolist():
            v = np.uint64(0)
            for x in flat[begin[i] : begin[i] + min(size[i], self.chain + 1)]:
                with np.errstate(over="ignore"):
                    v = v * _MIX + x
            more.append(v)
        h = np.concatenate([h, words.mix(np.array(more, np.uint64))])
        whose = np.concatenate([whose, bare])
        order = np.lexsort((h, whose))
        h, whose = h[order], whose[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (whose[1:] != whose[:-1])
        h, whose = h[new], whose[new]
        return np.split(h, np.searchsorted(whose, np.arange(1, len(texts)))) if texts else []


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def alike(a: np.ndarray, b: np.ndarray, cfg: SpotConfig, step: int = 256) -> bool:
    """Whether two ascending sets have the likeness: merged in steps, until what is left cannot reach it any more."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    if len(a) > len(b):
        a, b = b, a
    # With c in both, c / (n + m - c) >= t.
    least = math.ceil(round(cfg.similarity * (len(a) + len(b)) / (1 + cfg.similarity), 6))
    if len(a) < least:
        return False
    both = 0
    for lo in range(0, len(a), step):
        if both + len(a) - lo < least:
            return False
        part = a[lo : lo + step]
        both += int((b[np.minimum(np.searchsorted(b, part), len(b) - 1)] == part).sum())
    return both >= least


def digest(s: np.ndarray) -> str:
    """A fixed-size name of a set: 32 hex digits."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest()


def edited(text: str, after: str) -> str:
    """The text with its last half replaced by as much of the beginning of another one."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, copy, doc_id, text): documents in ranges of their ids, ordered within; each range ends with a copy (copy
    1) of the document that begins the next range, the last one with the first document of all.

    Ranges come from quantiles of the ids. One row for each range goes to the driver; texts are shuffled once."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    last = (1 << 63) - 1
    plain = plain.withColumn("key", F.coalesce("doc_id", F.lit(last)))
    cuts = plain.select(F.col("key").cast("double").alias("k")).approxQuantile("k", [i / buckets for i in range(1, buckets)], 0.2 / buckets) if buckets > 1 else []
    cuts = np.unique(np.array(cuts, np.float64))

    @F.pandas_udf("int")
    def bucket(key):
        import pandas as pd

        return pd.Series(np.searchsorted(cuts, key.to_numpy().astype(np.float64), side="right").astype(np.int32))

    heads = sorted((r["bucket"], r["head"]) for r in plain.select(bucket("key").alias("bucket"), "key").groupBy("bucket").agg(F.min("key").alias("head")).collect())
    first = np.array([h for _, h in heads], np.int64)
    before = np.array([heads[i - 1][0] for i in range(len(heads))], np.int32)

    @F.pandas_udf("array<int>")
    def targets(key):
        import pandas as pd

        k = key.to_numpy()
        own = np.searchsorted(cuts, k.astype(np.float64), side="right").astype(np.int32)
        at = np.minimum(np.searchsorted(first, k), len(first) - 1)
        return pd.Series([[b] if first[i] != x else [b, int(before[i])] for b, i, x in zip(own.tolist(), at.tolist(), k.tolist(), strict=True)])

    # The first target is the own range; a range may border on itself.
    ship(spark)
    each = plain.select("doc_id", "key", "text", F.posexplode(targets("key")).alias("copy", "bucket"))
    return each.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "copy", "key", F.xxhash64("text"), "text")


def compared(docs: DataFrame, cfg: SpotConfig | None = None, buckets: int | None = None) -> DataFrame:
    """Per document its signatures' digest and number, those of its edited text, and the likeness of its set to that of the
    edited text and of the next document."""
    cfg = cfg or SpotConfig()

    def run(it):
        import pyarrow as pa

        spots = Spotter(cfg)
        held = None
        for batch, texts in words.batches(it):
            bucket, copy = (batch.column(i).to_pylist() for i in (0, 1))
            ids, plain = batch.column(2).to_pylist(), [t.decode() for t in texts]
            rows = list(zip(bucket, copy, ids, plain, spots(texts), strict=True))
            if held is not None:
                rows.insert(0, held)
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0] and not a[1]]
            held = rows[-1]
            new = [edited(a[3], b[3]).encode() for a, b in pairs]
            sets = spots(new)
            out = [(a[2], len(a[3]), len(a[4]), hashlib.sha256(t).hexdigest(), digest(a[4]), digest(s), likeness(a[4], s), likeness(a[4], b[4])) for (a, b), t, s in zip(pairs, new, sets, strict=True)]
            kinds = [pa.int64()] * 3 + [pa.string()] * 3 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], names=["doc_id", "n_chars", "n_signatures", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    ordered = with_next(docs, buckets or parallelism(docs.sparkSession)).select("bucket", "copy", "doc_id", "text")
    return ordered.mapInArrow(run, "doc_id long, n_chars long, n_signatures long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def sets(docs: DataFrame, cfg: SpotConfig | None = None) -> DataFrame:
    """(doc_id, signatures): the set of each document as little-endian unsigned 64-bit numbers in ascending order."""
    cfg = cfg or SpotConfig()

    def run(it):
        import pyarrow as pa

        spots = Spotter(cfg)
        for batch, texts in words.batches(it):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.astype("<u8").tobytes() for s in spots(texts)], pa.binary())], names=["doc_id", "signatures"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, signatures binary")


def near_copies(docs: DataFrame, cfg: SpotConfig | None = None) -> DataFrame:
    """(doc_id, class_id, links): for each row the smallest id of the documents that it hangs together with by links of the
    likeness, and the number of other distinct sets that its own is linked with.

    Equal sets are one node, so copies never meet in pairs. Sets of one band meet by prefix signatures only."""
    cfg = cfg or SpotConfig()
    spark = docs.sparkSession
    own = written(sets(docs, cfg).withColumn("node", F.xxhash64("signatures")), "sets")
    nodes = written(own.groupBy("node").agg(F.min("doc_id").alias("least"), F.any_value("signatures").alias("signatures")), "nodes")

    def signed(it):
        import pyarrow as pa

        for batch in it:
            held = [np.frombuffer(x, "<i8") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), [len(x) for x in held])), pa.array(np.concatenate(held) if held else np.zeros(0, np.int64))], names=["node", "signature"])

    ratio = math.log(cfg.similarity)
    every = nodes.select("node", "signatures").mapInArrow(signed, "node long, signature long")
    # A signature of one node alone brings nothing together, but counts for the length of the prefix.
    common = written(every.groupBy("signature").agg(F.count("*").alias("n")), "common")
    length = nodes.select("node", F.expr("octet_length(signatures) div 8").alias("size"))
    ranked = every.join(common, "signature").withColumn("place", F.expr("row_number() over (partition by node order by n, signature)"))
    prefix = ranked.join(length, "node").where(F.col("place") <= F.col("size") - F.ceil(F.round(F.col("size") * cfg.similarity, 6)) + 1).where("n > 1")
    prefix = written(prefix.select("node", "signature", "size", F.floor(F.log("size") / -ratio).cast("int").alias("band")), "prefix")
    upper = prefix.select(F.col("node").alias("a"), "signature", F.col("size").alias("size_a"), "band")
    lower = prefix.select(F.col("node").alias("b"), "signature", F.col("size").alias("size_b"), F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    fits = (F.col("size_b") < F.col("size_a")) | ((F.col("size_b") == F.col("size_a")) & (F.col("b") < F.col("a")))
    met = upper.join(lower, ["band", "signature"]).where(fits & (F.col("size_b") >= F.ceil(F.round(F.col("size_a") * cfg.similarity, 6)))).select("a", "b").distinct()
    text = nodes.select("node", "signatures")
    pairs = met.join(text.select(F.col("node").alias("a"), F.col("signatures").alias("x")), "a").join(text.select(F.col("node").alias("b"), F.col("signatures").alias("y")), "b")

    def verified(it):
        import pyarrow as pa

        for batch in it:
            keep = [alike(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), cfg) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    links = written(pairs.select("a", "b", "x", "y").mapInArrow(verified, "a long, b long"), "links")
    part = connected_components(links)
    count = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    least = nodes.select("node", "least").join(part, "node", "left").withColumn("component", F.coalesce("root", "node"))
    smallest = least.groupBy("component").agg(F.min("least").alias("class_id"))
    return own.select("doc_id", "node").join(least.select("node", "component"), "node").join(smallest, "component").join(count, "node", "left").select("doc_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def op12_spots(spark, sf_dir: str) -> DataFrame:
    """All documents' fingerprints against those of their edited texts and of the next documents."""
    return compared(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")))
