"""Benchmark decontamination with spaced seeds.

A seed is a mask over successive tokens: positions marked 0 do not count, so a replaced token there leaves the hash as
it is. Benchmark and document positions with equal seed hashes are hits; each hit's diagonal is verified by comparing
tokens around it, tolerating substitutions.

The benchmark is the stated query set: it is read in blocks of bounded size, one after the other, each block's seed table
goes to all tasks, and the documents are passed over without a shuffle. Hits are counted as stretches of diagonals, and
equal diagonals of a document and an item are verified once, so repetitive texts cost no more than others.

Tokens are runs of letters and digits with A-Z lower-cased (other characters count as letters). Defined results: null
and empty texts hold nothing; benchmark rows without a token are not searched; items with fewer tokens than the shortest
mask are leaked where all their tokens stand in a row;
repeated rows on either side are treated each on its own; null ids are carried as they are; other columns do no harm;
an empty table gives an empty result (documents) or leaves all documents clean (benchmark)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm import words
from skarn.runtime import dealt, ship, table, written


@dataclass(frozen=True)
class SeedConfig:
    masks: tuple[str, ...] = ("11101011", "1100110101", "1010010111", "110001101001")
    #: A verified stretch has this share of equal tokens and this many tokens at least.
    identity: float = 0.65
    stretch: int = 8
    #: A document leaks an item if verified stretches cover this share of its tokens, and this many if it has them.
    covered: float = 0.5
    covered_tokens: int = 13
    #: Bytes of benchmark text in one block.
    block_bytes: int = 16 << 20


class SeedIndex:
    """The seed hashes of a block of benchmark items."""

    def __init__(self, items: list[tuple], cfg: SeedConfig):
        tokens = words.hashed_texts([(t or "").encode() for _, t in items], between=words.NOT_ALNUM)
        keep = [i for i, t in enumerate(tokens) if len(t)]
        self.ids, self.tokens = [items[i][0] for i in keep], [tokens[i] for i in keep]
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        flat = np.concatenate(self.tokens) if keep else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(keep)), self.size)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        # Items that no mask fits are looked up whole, by the hash of all their tokens.
        shortest = min(map(len, cfg.masks))
        self.masks = (*cfg.masks, *("1" * n for n in sorted(set(self.size[self.size < shortest].tolist()))))
        found = []
        for k, mask in enumerate(self.masks):
            own = self.size[owner]
            at = np.flatnonzero(own == len(mask) if len(mask) < shortest else place + len(mask) <= own)
            at = at[place[at] == 0] if len(mask) < shortest else at
            found.append((seeds(flat, mask, k)[at] if len(at) else np.zeros(0, np.uint64), owner[at], place[at]))
        h, self.owner, self.place = (np.concatenate(x) for x in zip(*found, strict=True))
        # Places of one seed that follow one another in an item are a run: what hits it hits a stretch of diagonals.
        order = np.lexsort((self.place, self.owner, h))
        h, owner, place = h[order], self.owner[order], self.place[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)
        begin = np.flatnonzero(new)
        self.h, self.owner, self.first, self.last = h[begin], owner[begin], place[begin], place[np.append(begin, len(h))[1:] - 1]
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.h >> np.uint64(42)).astype(np.int64)] = True


def seeds(flat: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The seed hash at each position of a token array from which the mask fits."""
    n = len(flat) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            h = h * np.uint64(0x9E3779B97F4A7C15) + flat[j : j + n]
    return words.mix(h + np.uint64(number))


def stretches(same: np.ndarray, least: int, identity: float) -> list[tuple[int, int]]:
    """All disjoint verified stretches (start, end) of a diagonal: the one with the largest sum, where an equal token
    adds 1 - identity and another one takes identity, then the same on the left and on the right of it."""
    total = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - identity, -identity))])
    found, parts = [], [(0, len(same))]
    while parts:
        lo, hi = parts.pop()
        if hi - lo < least:
            continue
        part = total[lo : hi + 1]
        end = int(np.argmax(part - np.minimum.accumulate(part)))
        start = int(np.argmin(part[: end + 1]))
        start, end = lo + start, lo + end
        if end == start:
            continue
        if end - start >= least and same[start:end].mean() >= identity:
            found.append((start, end))
        parts += [(lo, start), (end, hi)]
    return found


#: Numbers held at once for the hits of a document, and bytes for the diagonals that are compared.
HITS, DIAGONALS = 1 << 21, 1 << 24


def verified(doc: np.ndarray, item: np.ndarray, shifts: np.ndarray | list[int], cfg: SeedConfig) -> int:
    """Tokens of the item that lie in verified stretches on any of the diagonals (document place - item place).

    Diagonals with the same equal places are looked at once, and one that could add nothing to what is covered is not, so
    a text of one repeated phrase takes as many steps as it has different diagonals."""
    n, hit, shifts = len(item), np.zeros(len(item), bool), np.asarray(shifts, np.int64)
    least = math.ceil(round(cfg.identity * min(cfg.stretch, n), 6))
    weight = words.mix(np.arange(1, n + 1, dtype=np.uint64))
    # Places outside the document equal no token; at its ends a diagonal is shorter.
    seen: set[int] = set()
    padded = np.concatenate([np.zeros(n, np.uint64), doc, np.zeros(n, np.uint64)])
    inside = np.zeros(len(padded), bool)
    inside[n : n + len(doc)] = True
    step = max(1, DIAGONALS // max(n, 1))
    for lo in range(0, len(shifts), step):
        own = shifts[lo : lo + step] + n
        h, count = np.zeros(len(own), np.uint64), np.zeros(len(own), np.int64)
        for j in range(n):
            same = (padded[own + j] == item[j]) & inside[own + j]
            h += same * weight[j]
            count += same
        # The cut at the document's ends is part of a diagonal.
        left, right = np.maximum(0, n - own), np.minimum(n, len(doc) + n - own)
        h += words.mix((left * (n + 1) + right).astype(np.uint64))
        _, first = np.unique(h, return_index=True)
        first = first[count[first] >= least]
        for k in first[np.argsort(-count[first], kind="stable")].tolist():
            if int(h[k]) in seen:
                continue
            if hit.all():
                return n
            seen.add(int(h[k]))
            a, b, at = int(left[k]), int(right[k]), int(own[k])
            same = padded[at + a : at + b] == item[a:b]
            equal = np.flatnonzero(same)
            if hit[a + equal[0] : a + equal[-1] + 1].all():
                continue
            for start, end in stretches(same, min(cfg.stretch, n), cfg.identity):
                hit[a + start : a + end] = True
    return int(hit.sum())


def _diagonals(doc: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray, n_items: int) -> list[tuple[int, int, np.ndarray]]:
    """(document, item, diagonals) from stretches of diagonals low to high, each counted in a difference array."""
    key = doc * n_items + item
    order = np.argsort(key, kind="stable")
    key, low, high = key[order], low[order], high[order]
    cuts = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        base, top = int(low[a:b].min()), int(high[a:b].max())
        open_ = np.bincount(low[a:b] - base, minlength=top - base + 2) - np.bincount(high[a:b] - base + 1, minlength=top - base + 2)
        out.append((int(key[a]) // n_items, int(key[a]) % n_items, np.flatnonzero(np.cumsum(open_) > 0) + base))
    return out


def leaks(texts: list[bytes], index: SeedIndex, cfg: SeedConfig) -> list[list[tuple[int, int]]]:
    """For each text the items it leaks: (item's place in the block, tokens covered)."""
    tokens = words.hashed_texts(texts, between=words.NOT_ALNUM)
    size = np.array([len(t) for t in tokens], np.int64)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not size.sum() or not len(index.h):
        return out
    flat, first = np.concatenate(tokens), np.cumsum(size) - size
    met: dict[tuple[int, int], list[np.ndarray]] = {}
    for k, mask in enumerate(index.masks):
        h = seeds(flat, mask, k)
        at = np.flatnonzero(index.filter[(h >> np.uint64(42)).astype(np.int64)])
        if not len(at):
            continue
        doc = np.searchsorted(first, at, side="right") - 1
        at, doc = (x[at + len(mask) <= first[doc] + size[doc]] for x in (at, doc))
        lo, hi = np.searchsorted(index.h, h[at]), np.searchsorted(index.h, h[at], side="right")
        if k >= len(cfg.masks):
            # One place of a whole item is enough.
            one = np.unique(np.stack([doc, lo]), axis=1, return_index=True)[1]
            at, doc, lo, hi = (x[one] for x in (at, doc, lo, hi))
        at, doc, lo, n = (x[hi > lo] for x in (at, doc, lo, hi - lo))
        part = np.cumsum(n) // HITS
        for c in np.unique(part).tolist():
            own = part == c
            run = np.repeat(lo[own] - (np.cumsum(n[own]) - n[own]), n[own]) + np.arange(int(n[own].sum()))
            d, p = np.repeat(doc[own], n[own]), np.repeat(at[own] - first[doc[own]], n[own])
            for i, j, shifts in _diagonals(d, index.owner[run], p - index.last[run], p - index.first[run], len(index.size)):
                had = met.setdefault((i, j), [])
                had.append(shifts)
                if len(had) > 16:
                    had[:] = [np.unique(np.concatenate(had))]
    for (d, i), held in met.items():
        n = int(index.size[i])
        covered = verified(tokens[d], index.tokens[i], np.unique(np.concatenate(held)), cfg)
        if covered >= min(n, max(cfg.covered_tokens, math.ceil(cfg.covered * n))):
            out[d].append((i, covered))
    return out


def marked(docs: DataFrame, benchmark: DataFrame, cfg: SeedConfig | None = None, name: str = "leaks") -> DataFrame:
    """All columns of docs plus the leaks: an array of (item_id, item_tokens, covered_tokens), empty for a clean document."""
    import pyarrow as pa

    cfg = cfg or SeedConfig()
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / cfg.block_bytes))
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names).withColumn("leaks", F.expr("cast(array() as array<struct<item_id:bigint,item_tokens:bigint,covered_tokens:bigint>>)"))
    schema = plain.schema
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("item_tokens", pa.int64()), ("covered_tokens", pa.int64())]))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        sent = spark.sparkContext.broadcast(SeedIndex([(r.item_id, r.text) for r in rows], cfg))

        def run(it, sent=sent):
            index = sent.value
            for batch, texts in words.batches(it, "_t"):
                found = leaks(texts, index, cfg)
                had = batch.columns[-2].to_pylist()
                now = [a + [{"item_id": index.ids[i], "item_tokens": int(index.size[i]), "covered_tokens": c} for i, c in x] for a, x in zip(had, found, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(now, kind)], names=[*names, "leaks"])

        plain = plain.withColumn("_t", F.col(names[docs.columns.index("text")]).cast("string")).mapInArrow(run, schema)
        if blocks > 1:
            # A block is done with before the next one is made, so the driver holds one of them.
            plain = written(plain, "decontaminated")
            sent.destroy()
    return plain.toDF(*docs.columns, name)


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """One row for each pair of a document and a benchmark item that it leaks."""
    found = marked(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.item_tokens", "leak.covered_tokens")
