"""Alignment of two tokenizers' tokens over the bytes of a text.

Every byte of a text gets a label: no token ends after it, one of the first tokenizer's does, one of the second's, or
both do. A regular expression scans the labels and takes each span up to the next `both`; the ends counted in a span say
which tokens stand in its group. Two tokens are linked if their byte ranges overlap: each label other than `none` ends
one such overlap.

Both tokenizers end a token before a single space or line break between two characters that are not white space (the
second one's vocabulary is searched for pieces that would run across it; if there is one, there is no cut). So a text is
cut there into units, each distinct unit is labelled once, and a document is put together from its units.

How many documents hold a pair of ids linked is counted over all of them: texts are taken in chunks of bounded size, a
chunk's distinct pairs are counted where it is read, sums go by pair, and the chunk's own part of the sums comes back to
its documents. Nothing is broadcast, and no row is made for each document and pair.

Defined results: null and empty texts, and texts of which a tokenizer keeps other bytes (a literal U+2581 becomes a
space), have no tokens: counts are 0 and the groups are empty; repeated rows come back once for each row and are
documents of their own in the counts; null ids are carried; other columns are ignored; an empty table gives an empty
result. A unit is held in one task, and so is a text."""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm import words
from skarn.runtime import dealt, ship, table, written


@dataclass(frozen=True)
class AlignConfig:
    #: A byte-level BPE file of the `tokenizers` library; None: byte_bpe_50k.json.
    first: str | None = None
    #: A `sentencepiece` model; None: piece_bpe_32k.model.
    second: str | None = None
    #: Bytes of text in a chunk; a longer text is one of its own.
    chunk_bytes: int = 4 << 20
    #: Units that a task keeps at hand.
    kept_units: int = 400_000


#: Labels of a byte.
NONE, FIRST, SECOND, BOTH = "-", "a", "b", "x"
_SPAN = re.compile(f"[^{BOTH}]*{BOTH}")


_MARKS = np.frombuffer((NONE + FIRST + SECOND + BOTH).encode(), np.uint8)


def labels(first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    """The labels of n bytes (0 to 3, in the order above) from the ends of both tokenizers' tokens (exclusive offsets)."""
    at = np.zeros(n, np.uint8)
    at[first - 1] = 1
    at[second - 1] |= 2
    return at


def grouped(at: np.ndarray) -> list[tuple[int, int]]:
    """For each span up to a `both` label: (tokens of the first, tokens of the second tokenizer)."""
    spans = _SPAN.findall(_MARKS[at[at > 0]].tobytes().decode())
    known = {s: (s.count(FIRST) + 1, s.count(SECOND) + 1) for s in set(spans)}
    return [known[s] for s in spans]


def linked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first's and of the second's token for each two whose byte ranges overlap."""
    ends = at[at > 0]
    a, b = np.cumsum(ends != 2), np.cumsum(ends != 1)
    return a - (ends != 2), b - (ends != 1)


def _byte_level() -> dict[str, int]:
    """Characters of byte-level vocabularies to bytes: printable ones stand for themselves, others follow from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers: ids and byte lengths of a unit."""

    def __init__(self, first: str | None = None, second: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first or public_tokenizers.path("byte_bpe_50k.json"))
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=second or public_tokenizers.path("piece_bpe_32k.model"))
        chars = _byte_level()
        self.first_bytes = [b""] * self.first.get_vocab_size()
        for t, i in self.first.get_vocab().items():
            self.first_bytes[i] = bytes(chars[c] for c in t) if all(c in chars for c in t) else t.encode()
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.second_bytes = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.blank = self.second.piece_to_id("▁")
        # A cut before a character is safe if no piece has it behind another one.
        cuts = "".join(c for c in " \n" if not any(x == c and y != c for p in pieces for y, x in zip(p.replace("▁", " "), p.replace("▁", " ")[1:], strict=False)))
        self.first_size, self.second_size = (np.array([len(x) for x in t], np.int64) for t in (self.first_bytes, self.second_bytes))
        self.first_name, self.second_name = ([str(i) for i in range(len(t))] for t in (self.first_bytes, self.second_bytes))
        # White space by any of the libraries' rules; U+180E and U+200B are so by some.
        solid = "[^\\s\\x1c-\\x1f\\x85\\xa0\\u180e\\u200b\\ufeff]"
        self.cut = re.compile(f"(?<={solid})(?=[{cuts}]{solid})") if cuts else None
        self.regular = re.compile(f"[{cuts}]{solid}(?s:.*{solid})?\\Z" if cuts else "(?!)")

    def units(self, text: str) -> list[str]:
        """The units of a space and the text."""
        return self.cut.split(" " + text) if self.cut else [" " + text]

    def _ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both tokenizers; the second one adds the space that a text begins with, or one that is taken off."""
        a = [x.ids for x in self.first.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.second.encode([u[1:] if u[0] == " " else u for u in texts], num_threads=1)
        return a, [y if u[0] == " " or y[:1] != [self.blank] else y[1:] for u, y in zip(texts, b, strict=True)]

    def encode(self, units: list[str], block: int = 256) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
        """For each tokenizer: (ids of all units in a row, number of ids of each).

        Units with solid ends are joined, since a cut stands between any two of them, and go to the tokenizers in blocks;
        those that begin with a line break stand together."""
        sort = [2 if not self.regular.match(u) else 0 if u[0] == " " else 1 for u in units]
        texts, which = [], []
        for k in (0, 1):
            own = [i for i, s in enumerate(sort) if s == k]
            for j in range(0, len(own), block):
                which.append(own[j : j + block])
                texts.append("".join([units[i] for i in which[-1]]))
        for i, s in enumerate(sort):
            if s == 2:
                which.append([i])
                texts.append(units[i])
        order = np.array([i for w in which for i in w], np.int64)
        size = np.array([len(units[i].encode()) for i in order.tolist()], np.int64)
        first = np.cumsum([0, *map(len, which)])
        out = []
        for ids, length in zip(self._ids(texts), (self.first_size, self.second_size), strict=True):
            flat, count = [], np.zeros(len(units), np.int64)
            for k, own in enumerate(ids):
                own = np.array(own, np.int64)
                if len(which[k]) > 1:
                    at = np.cumsum(length[own])
                    ends = np.cumsum(size[first[k] : first[k + 1]])
                    cut = np.minimum(np.searchsorted(at, ends), len(own) - 1)
                    if not len(at) or (at[cut] != ends).any():  # bytes are lost in one of them
                        single = [self._ids([units[i]])[len(out)][0] for i in which[k]]
                        count[first[k] : first[k + 1]] = [len(x) for x in single]
                        own = np.array([i for x in single for i in x], np.int64)
                    else:
                        count[first[k] : first[k + 1]] = np.diff(np.concatenate([[-1], cut]))
                else:
                    count[first[k]] = len(own)
                flat.append(own)
            all_ = np.concatenate(flat)
            start = np.empty(len(units), np.int64)
            sized = np.empty(len(units), np.int64)
            start[order], sized[order] = np.cumsum(count) - count, count
            out.append((all_[repeats(start, sized)], sized))
        return tuple(out)


def repeats(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start[i], start[i] + 1, ... (size[i] of them), for each i in a row."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Units:
    """What is known of each distinct unit, in flat arrays; forgotten when there are too many."""

    def __init__(self, pair: Pair, most: int):
        self.pair, self.most = pair, most
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        self.stats = np.zeros((0, 5), np.int64)
        self.links = np.zeros(0, np.int64)

    def learn(self, units: list[str]) -> None:
        """Adds the units that are not known. If there are too many all others are forgotten first."""
        new = [u for u in units if u not in self.at]
        if self.at and len(self.at) + len(new) > self.most:
            self._forget()
            new = units
        if not new:
            return
        pair, base = self.pair, len(self.links)
        (a, n), (b, m) = pair.encode(new)
        raw = [u.encode() for u in new]
        size = np.array([len(x) for x in raw], np.int64)
        good = np.ones(len(new), bool)
        for ids, count, table_ in ((a, n, pair.first_bytes), (b, m, pair.second_bytes)):
            tokens = [table_[i] for i in ids.tolist()]
            if b"".join(tokens) != b"".join(raw):
                ends = np.cumsum(count).tolist()
                good &= np.array([b"".join(tokens[e - c : e]) == x for e, c, x in zip(ends, count.tolist(), raw, strict=True)])
        keep = np.flatnonzero(good)
        a, b = a[repeats((np.cumsum(n) - n)[keep], n[keep])], b[repeats((np.cumsum(m) - m)[keep], m[keep])]
        ends = np.cumsum(size[keep])
        marks = labels(np.cumsum(pair.first_size[a]), np.cumsum(pair.second_size[b]), int(size[keep].sum()))
        # Both tokenizers end at a unit's end, so groups and links of all units come in a row.
        groups, left, right = [], [pair.first_name[i] for i in a.tolist()], [pair.second_name[i] for i in b.tolist()]
        i = j = 0
        for x, y in grouped(marks):
            groups.append(f"{left[i]}|{right[j]}" if x == y == 1 else f"{','.join(left[i : i + x])}|{','.join(right[j : j + y])}")
            i, j = i + x, j + y
        upto = np.concatenate([[0], np.cumsum(marks == 3)])[ends] if len(keep) else ends
        meet = np.concatenate([[0], np.cumsum(marks > 0)])[ends] if len(keep) else ends
        x, y = linked(marks)
        stats = np.zeros((len(new), 5), np.int64)
        stats[:, 0] = -1
        n_groups, n_links = np.diff(np.concatenate([[0], upto])), np.diff(np.concatenate([[0], meet]))
        stats[keep] = np.stack([n[keep], m[keep], n_groups, base + meet - n_links, n_links], 1)
        text = [""] * len(new)
        for k, lo, hi in zip(keep.tolist(), (upto - n_groups).tolist(), upto.tolist(), strict=True):
            text[k] = ";".join(groups[lo:hi])
        self.at.update(zip(new, range(len(self.groups), len(self.groups) + len(new)), strict=True))
        self.groups += text
        self.stats = np.concatenate([self.stats, stats])
        self.links = np.concatenate([self.links, (a[x] << 32) | b[y]])


_HELD: dict[tuple, Units] = {}


def _units(cfg: AlignConfig) -> Units:
    """One for each Python worker."""
    key = (cfg.first, cfg.second, cfg.kept_units)
    if key not in _HELD:
        _HELD[key] = Units(Pair(cfg.first, cfg.second), cfg.kept_units)
    return _HELD[key]


def aligned(texts: list[str], known: Units) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """(rows (n_a, n_b, n_groups, n_links, groups), the chunk's distinct pairs, and rows (document, pair's place, times))."""
    cut = [known.pair.units(t) if t else [] for t in texts]
    known.learn(list(dict.fromkeys(u for us in cut for u in us)))
    at = known.at
    ids = [[at[u] for u in us] for us in cut]
    out, rows = [], []
    for d, own in enumerate(ids):
        s = known.stats[own] if own else known.stats[:0]
        if not own or (s[:, 0] < 0).any():
            out.append((0, 0, 0, 0, ""))
            continue
        out.append((*(int(x) for x in s[:, (0, 1, 2, 4)].sum(0)), ";".join([known.groups[i] for i in own])))
        unit, times = np.unique(np.array(own), return_counts=True)
        place = repeats(known.stats[unit, 3], known.stats[unit, 4])
        rows.append((d, known.links[place], np.repeat(times, known.stats[unit, 4])))
    if not rows:
        return out, np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    doc = np.repeat([d for d, *_ in rows], [len(x) for _, x, _ in rows])
    pairs, place = np.unique(np.concatenate([x for _, x, _ in rows]), return_inverse=True)
    times = np.concatenate([x for *_, x in rows])
    key, first = np.unique(doc * len(pairs) + place, return_inverse=True)
    total = np.bincount(first, times, len(key)).astype(np.int64)
    return out, pairs, np.stack([key // len(pairs), key % len(pairs), total], 1)


#: One row for each document, and one for each chunk, which alone has `pairs` and `docs`.
_CUT = "chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, place array<int>, times array<int>, pairs array<bigint>, docs array<int>"


def chunks(docs: DataFrame, cfg: AlignConfig, digest: bool) -> DataFrame:
    """Texts aligned, each document with the places of its pairs in its chunk's list; digest: groups hashed, not whole."""

    def run(it):
        import pyarrow as pa
        from pyspark import TaskContext

        known, part = _units(cfg), TaskContext.get().partitionId() << 40
        names = [f.split()[0] for f in _CUT.split(", ")]
        lists = pa.list_(pa.int32())
        for k, (batch, texts) in enumerate(words.batches(it, most=cfg.chunk_bytes)):
            found, pairs, held = aligned([t.decode() for t in texts], known)
            n = len(found)
            cut = np.searchsorted(held[:, 0], np.arange(n + 1)).astype(np.int32)
            place, times = (pa.ListArray.from_arrays(pa.array(cut), pa.array(held[:, j], pa.int32())) for j in (1, 2))
            said = [(hashlib.sha256(x[4].encode()).hexdigest() if digest else x[4]) if x[0] else "" for x in found]
            none = [pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, lists)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part + k)), batch.column(0), *(pa.array([x[j] for x in found], pa.int64()) for j in range(4)), pa.array(said, pa.string()), place, times, *none], names=names)
            if len(pairs):
                own = [pa.array([pairs], pa.list_(pa.int64())), pa.array([np.bincount(held[:, 1], minlength=len(pairs)).astype(np.int32)], lists)]
                yield pa.RecordBatch.from_arrays([pa.array([part + k]), *(pa.nulls(1, pa.int64()) for _ in range(5)), pa.nulls(1, pa.string()), pa.nulls(1, lists), pa.nulls(1, lists), *own], names=names)

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _CUT)


def links(docs: DataFrame, cfg: AlignConfig | None = None, digest: bool = False) -> DataFrame:
    """Per document its tokens, groups (or their digest), links, and how common the linked pairs are in the corpus."""
    cfg = cfg or AlignConfig()
    cut = written(chunks(docs, cfg, digest), "aligned")
    own = cut.where("pairs is not null").select("chunk", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "x")).select("chunk", "at", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    total = own.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("pair", 32))
    # A first id's pairs are at most as many as the second vocabulary has entries.
    most = total.groupBy("a").agg(F.max("n").alias("most"))
    judged = total.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    looked = own.join(judged, "pair").select("chunk", "at", "n", "best")
    rows = cut.where("pairs is null").drop("pairs", "docs").withColumn("part", F.col("chunk") + 0).drop("chunk")

    def run(left, right):
        import pyarrow as pa

        at, n, best = (np.asarray(right.column(c)) for c in ("at", "n", "best"))
        order = np.argsort(at)
        n, best = n[order], best[order].astype(bool)
        place, times = (left.column(c).combine_chunks() for c in ("place", "times"))
        size = np.diff(np.asarray(place.offsets)) if len(place) else np.zeros(0, np.int64)
        owner, p, t = np.repeat(np.arange(len(size)), size), np.asarray(place.flatten()), np.asarray(times.flatten(), np.int64)
        # Sums of whole numbers, exact below 2^53.
        sums = [np.bincount(owner, w, len(size)).astype(np.int64) for w in ((t * best[p], t * n[p]) if len(p) else (np.zeros(0), np.zeros(0)))]
        return pa.table({**{c: left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}, "n_best": sums[0], "count_sum": sums[1], "groups": left.column("groups")})

    return rows.groupBy("part").cogroup(looked.groupBy("chunk")).applyInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def op11_align(spark, sf_dir: str) -> DataFrame:
    """All documents aligned, with their groups as a digest."""
    found = links(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")
