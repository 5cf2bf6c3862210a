"""Removal of byte strings that repeat anywhere in a corpus, by suffix arrays.

Documents are cut into overlapping segments around anchors: the smallest of the hashes of all 32-byte strings in each
window as long as the string searched for. Equal windows have equal anchors, so every repeat lies, whole, in two
segments of one anchor hash; segments whose hash stands alone hold no repeat and go no further. Equal segments (of equal
128-bit hashes) are collapsed to one with its count. The segments of a hash are brought together, and suffix arrays over
them, made by two-stage sorting, with the common prefixes of adjacent suffixes, byte for byte, tell which windows occur at
two places. What is covered is then carried back to every occurrence of its segment; the repeated windows of a segment
overlap, so they cover one range.

An anchor hash with more distinct segments than an array may hold (a passage that very many documents share in different
surroundings) is never brought together: each window of its segments is counted by its own 128-bit hash, and only counts
meet. Text in a row of equal segments (a run of one byte) is one row with its first and last place.

Defined results: null text is an empty text; documents are treated as bytes and matches never cross them; repeated rows
are repeats of each other and lose all bytes that a long enough string covers; null ids are carried; other columns are
ignored; an empty table gives an empty result."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm import words
from skarn.llm.suffixes import common_prefixes, suffix_array
from skarn.runtime import dealt, filtered_early, marked, scratch, ship, table, written


@dataclass(frozen=True)
class DedupConfig:
    length: int = 200
    gram: int = 32
    #: Bytes of segments in one suffix array, but for the segments of one hash, which are `hot` at most; more of them are
    #: decided window by window.
    array_bytes: int = 1 << 20
    hot: int = 4096
    #: Bytes of a document that are hashed at once.
    chunk: int = 1 << 21


def _window_least(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w successive values: running minima of blocks from both sides."""
    n = len(x)
    pad = -n % w
    full = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(full, axis=1).reshape(-1)
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def _digest(data) -> tuple[int, int]:
    """A 128-bit hash as two signed numbers."""
    import xxhash

    return struct.unpack("<qq", xxhash.xxh3_128_digest(data, 9))


def anchors(text: bytes, cfg: DedupConfig) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, place, and the ends of the segment seen from there) of each anchor, in order, some at a time.

    An anchor's segment holds the windows of which it is the anchor; these lie in a row, and each window has one."""
    n, w, reach = len(text), cfg.length - cfg.gram + 1, cfg.length - cfg.gram
    held: tuple | None = None
    for a in range(0, max(0, n - cfg.length + 1), cfg.chunk):
        b = min(a + cfg.chunk, n - cfg.length + 1)
        lo, hi = max(0, a - reach), min(n, b + cfg.length)
        buf = np.frombuffer(text, np.uint8, hi - lo, lo)
        up, down = words._powers(len(buf) + 1)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(words._VALUE[buf] * up[:-1], out=total[1:])
        size = b - a + w - 1
        h = words.mix((total[a - lo + cfg.gram : a - lo + cfg.gram + size] - total[a - lo : a - lo + size]) * down[a - lo : a - lo + size])
        low = np.uint64((1 << 24) - 1)
        # The place makes all values differ, so that of equal hashes the leftmost counts.
        p = (_window_least((h & ~low) | np.arange(size, dtype=np.uint64), w) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        s, e = a + first, a + np.append(first[1:], len(p)) - 1 + cfg.length
        p = p[first]
        now = h[p], a + p, s - a - p, e - a - p
        if held is not None:
            if held[1][-1] == now[1][0]:
                # The last anchor of the chunk before has windows in this one, too.
                now[2][0] = held[2][-1]
                held = tuple(x[:-1] for x in held)
            if len(held[0]):
                yield held
        held = now
    if held is not None:
        yield held


def _segments(text: bytes, cfg: DedupConfig) -> Iterator[list[np.ndarray]]:
    """(h, s1, s2, at, to, a, b, n): the anchors with the hashes of their segments; successive equal segments are one row,
    from the first place to the last."""
    view = memoryview(text)
    for h, at, a, b in anchors(text, cfg):
        rel = (-a).tolist()
        s = np.array([_digest(view[x + lo : x + hi]) for x, lo, hi in zip(at.tolist(), a.tolist(), b.tolist(), strict=True)], np.int64).reshape(-1, 2)
        # The anchor's place in its segment belongs to it.
        s[:, 0] += np.asarray(rel, np.int64)
        h = h.view(np.int64)
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1]).any(1)
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(h)))
        yield [h[first], s[first, 0], s[first, 1], at[first], at[first + n - 1], a[first], b[first], n]


_FOUND = "uid long, h long, s1 long, s2 long, at long, to long, a int, b int, n long"
_COLUMNS = ["uid", "h", "s1", "s2", "at", "to", "a", "b", "n"]


def all_anchors(docs: DataFrame, cfg: DedupConfig) -> DataFrame:
    """(uid, h, s1, s2, at, to, a, b, n) for docs (uid, text)."""

    def run(it):
        import pyarrow as pa

        def out(held, uids):
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            uid = np.repeat(np.asarray(uids, np.int64), [len(x[0]) for x in held])
            kinds = [pa.int64()] * 6 + [pa.int32()] * 2 + [pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((uid, *cols), kinds, strict=True)], names=_COLUMNS)

        for batch, texts in words.batches(it):
            held, uids, rows = [], [], 0
            for uid, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                for found in _segments(text, cfg):
                    held.append(found)
                    uids.append(uid)
                    rows += len(found[0])
                    if rows > 200_000:
                        yield out(held, uids)
                        held, uids, rows = [], [], 0
            if rows:
                yield out(held, uids)

    return docs.mapInArrow(run, _FOUND)


def _summed(found: DataFrame) -> DataFrame:
    """Of equal segments in a batch one row is left, with their count, so that copies do not travel."""

    def run(it):
        import pyarrow as pa

        for batch in it:
            if batch.num_rows:
                h, s1, s2, n = (np.asarray(batch.column(i), np.int64) for i in (1, 2, 3, 8))
                order = np.lexsort((s2, s1, h))
                new = np.ones(len(order), bool)
                new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (h, s1, s2)], axis=0)
                first = np.flatnonzero(new)
                left = batch.take(pa.array(order[first]))
                yield pa.RecordBatch.from_arrays([*left.columns[:-1], pa.array(np.add.reduceat(n[order], first))], names=_COLUMNS)

    return found.select(*_COLUMNS).mapInArrow(run, _FOUND)


def with_shared_core(text: np.ndarray, begin: np.ndarray, end: np.ndarray, rel: np.ndarray, group: np.ndarray, cfg: DedupConfig, parts: int = 8) -> np.ndarray:
    """Which segments (text[begin:end], anchor at begin + rel) may hold a window that another of their group holds.

    Windows that begin between two places before the anchor have a core in common; a window that two segments hold
    lies around a core that both hold. So segments none of whose cores is met twice hold no repeat."""
    up, down = words._powers(len(text) + 1)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(words._VALUE[text] * up[:-1], out=total[1:])
    keep = np.zeros(len(begin), bool)
    cuts = np.linspace(0, cfg.length - cfg.gram, parts + 1).astype(np.int64)
    at = begin + rel
    for near, far in zip(cuts, cuts[1:], strict=False):
        s, e = at - near, at + cfg.length - far
        own = np.flatnonzero((s >= begin) & (e <= end))
        core = words.mix((total[e[own]] - total[s[own]]) * down[s[own]]) ^ group[own]
        order = np.argsort(core)
        same = core[order[1:]] == core[order[:-1]]
        keep[own[order[1:][same]]] = True
        keep[own[order[:-1][same]]] = True
    return keep


def repeated_starts(text: np.ndarray, begin: np.ndarray, end: np.ndarray, n: np.ndarray, doc: np.ndarray, start: np.ndarray, cfg: DedupConfig) -> tuple[np.ndarray, np.ndarray]:
    """(segment, place in it) of all repeated windows of segments text[begin:end], which lie in a row.

    n: how often the segment occurs; doc and start: a document where it does, and the place there."""
    of = np.repeat(np.arange(len(begin)), end - begin)
    place = np.arange(len(text)) - begin[of]
    whole = end[of] - begin[of] - place >= cfg.length
    order = suffix_array(text, cfg.length)
    order = order[whole[order]]
    repeated = np.zeros(len(text), bool)
    if len(order):
        same = common_prefixes(text, order, cfg.length)
        cut = np.concatenate([[0], np.flatnonzero(~same) + 1])
        # Segments of one document may overlap: a window counts once for each place in its document.
        source = (np.unique(doc, return_inverse=True)[1][of[order]] << 40) | (start[of[order]] + place[order])
        many = np.minimum.reduceat(source, cut) != np.maximum.reduceat(source, cut)
        repeated[order[np.repeat(many, np.diff(np.append(cut, len(order))))]] = True
    repeated |= whole & (n[of] > 1)
    at = np.flatnonzero(repeated)
    return of[at], place[at]


def _covered(segments: DataFrame, cfg: DedupConfig) -> DataFrame:
    """(h, s1, s2, a, b): covered ranges, from the anchor, of segments (h, s1, s2, n, uid, start, rel, bytes), sorted by
    h, s1 and s2 and all of an h in a partition."""

    def solved(rows):
        import pyarrow as pa

        h, s1, s2, n, uid, start, rel = (np.asarray(rows.column(i), np.int64) for i in range(7))
        held = rows.column(7)
        offset = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
        text = np.frombuffer(held.buffers()[2], np.uint8)[offset[0] : offset[-1]]
        begin, end = offset[:-1] - offset[0], offset[1:] - offset[0]
        # Rows that are repeated in the table may have brought their segments twice.
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
        keep = np.flatnonzero(once & (n > 1))
        one = np.flatnonzero(once)
        keep = np.union1d(keep, one[with_shared_core(text, begin[one], end[one], rel[one], h[one].view(np.uint64), cfg)])
        if not len(keep):
            return None
        size = (end - begin)[keep]
        to = np.cumsum(size) - size
        small = text[np.repeat(begin[keep] - to, size) + np.arange(int(size.sum()))]
        of, place = repeated_starts(small, to, to + size, n[keep], uid[keep], start[keep], cfg)
        if not len(of):
            return None
        # The windows of a segment begin in reach of each other, so what they cover is one range.
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        last = np.append(first[1:], len(of)) - 1
        own = keep[of[first]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h[own], s1[own], s2[own], place[first] - rel[own], place[last] + cfg.length - rel[own])], names=["h", "s1", "s2", "a", "b"])

    def run(it):
        import pyarrow as pa

        rest = None
        for batch in it:
            batch = batch.set_column(7, "bytes", batch.column(7).cast(pa.large_binary()))
            rows = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()
            if not rows:
                continue
            rows = rows[0]
            h = np.asarray(rows.column(0), np.int64)
            offset = np.frombuffer(rows.column(7).buffers()[1], np.int64)[rows.column(7).offset :]
            edge = np.flatnonzero(h[1:] != h[:-1]) + 1
            at = 0
            for e in edge.tolist():
                if offset[e] - offset[at] >= cfg.array_bytes:
                    if (out := solved(rows.slice(at, e - at))) is not None:
                        yield out
                    at = e
            rest = rows.slice(at)
        if rest is not None and rest.num_rows and (out := solved(rest)) is not None:
            yield out

    return segments.mapInArrow(run, "h long, s1 long, s2 long, a long, b long")


def _cut(shared: DataFrame, docs: DataFrame, each, schema: str) -> DataFrame:
    """`each` of the segments (h, s1, s2, n, uid, at, a, b) of shared with their bytes: rows for Arrow, of this schema."""
    # A document's segments are cut out of its text together; there are never more of them than its length allows.
    wanted = written(shared.groupBy("uid").agg(F.collect_list(F.struct("h", "s1", "s2", "n", "at", "a", "b")).alias("rows")), "wanted")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(it):
        import pyarrow as pa

        kinds = [pa.binary() if x.endswith("binary") else pa.int64() for x in schema.split(", ")]
        last = None
        for batch, texts in words.batches(it):
            out: list[tuple] = []
            for uid, rows, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                # Repeated rows have one uid and come in a row; one of them is enough.
                if uid == last:
                    continue
                last = uid
                for r in rows:
                    out.extend(each(uid, r, text))
                    if len(out) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    with filtered_early(docs.sparkSession):
        texts = docs.select("uid", "text").join(marked(wanted, "uid"), "uid").select("uid", "rows", "text")
        return written(texts.mapInArrow(run, schema), "cut")


def _in_arrays(shared: DataFrame, docs: DataFrame, cfg: DedupConfig) -> DataFrame:
    def each(uid, r, text):
        lo = r["at"] + r["a"]
        yield r["h"], r["s1"], r["s2"], min(r["n"], 2), uid, lo, -r["a"], text[lo : r["at"] + r["b"]]

    parts = _cut(shared, docs, each, "h long, s1 long, s2 long, n long, uid long, start long, rel long, bytes binary")
    return _covered(parts.repartition("h").sortWithinPartitions("h", "s1", "s2"), cfg)


def _by_window(shared: DataFrame, docs: DataFrame, cfg: DedupConfig) -> DataFrame:
    """(h, s1, s2, a, b): covered ranges of segments whose hash has too many to be brought together."""

    def each(uid, r, text):
        view = memoryview(text)
        for x in range(r["a"], r["b"] - cfg.length + 1):
            lo = r["at"] + x
            yield r["h"], r["s1"], r["s2"], x, min(r["n"], 2), *_digest(view[lo : lo + cfg.length])

    rows = _cut(shared, docs, each, "h long, s1 long, s2 long, x long, n long, w1 long, w2 long")
    # A segment may have come with several of its places' documents; each of its windows counts once.
    once = rows.groupBy("h", "s1", "s2", "x").agg(F.max("n").alias("n"), F.first("w1").alias("w1"), F.first("w2").alias("w2"))
    many = once.groupBy("w1", "w2").agg(F.sum("n").alias("n")).where("n > 1").select("w1", "w2")
    hit = once.join(many, ["w1", "w2"])
    return hit.groupBy("h", "s1", "s2").agg(F.min("x").alias("a"), (F.max("x") + cfg.length).alias("b"))


def deduplicated(docs: DataFrame, cfg: DedupConfig | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs (doc_id, text)."""
    cfg = cfg or DedupConfig()
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("uid", F.xxhash64("doc_id", "text"))
    with scratch(spark):
        found = written(all_anchors(docs.select("uid", "text"), cfg), "anchors")
        met = written(found.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "met")
        with filtered_early(spark):
            near = written(found.join(marked(met, "h"), "h").select(*_COLUMNS), "near")
        kinds = _summed(near).groupBy("h", "s1", "s2").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("uid", "at", "a", "b")))
        kinds = written(kinds, "kinds")
        shared = written(kinds.join(kinds.groupBy("h").agg(F.count("*").alias("kinds")), "h"), "shared")
        # A hash with a single segment, which occurs more than once: all of it repeats, and there is nothing to compare.
        alone = shared.where("kinds = 1").select("h", "s1", "s2", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
        covered = alone.unionByName(_in_arrays(shared.where(f"kinds > 1 and kinds <= {cfg.hot}"), docs, cfg)).unionByName(_by_window(shared.where(f"kinds > {cfg.hot}"), docs, cfg))
        covered = written(covered, "covered")
        spans = near.select("uid", "h", "s1", "s2", "at", "to").join(covered, ["h", "s1", "s2"]).select("uid", F.struct((F.col("at") + F.col("a")).alias("a"), (F.col("to") + F.col("b")).alias("b")).alias("r"))
        ranges = written(spans.groupBy("uid").agg(F.collect_set("r").alias("ranges")), "ranges", keep=True)

    def removed(it):
        import pyarrow as pa

        for batch, texts in words.batches(it):
            out = []
            for doc, ranges, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                kept, at, gone, spans = hashlib.sha256(), 0, 0, 0
                for a, b in sorted((r["a"], r["b"]) for r in ranges or ()):
                    if a > at or not spans:
                        spans += 1
                        kept.update(text[at:a])
                        gone += b - a
                        at = b
                    elif b > at:
                        gone += b - at
                        at = b
                kept.update(text[at:])
                out.append((doc, len(text), gone, spans, kept.hexdigest()))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.join(ranges, "uid", "left").select("doc_id", "ranges", "text").mapInArrow(removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every whole text of `documents` without the bytes that a 200-byte string covers which starts twice."""
    return deduplicated(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")))
