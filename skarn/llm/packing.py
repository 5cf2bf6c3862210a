"""Best-two-fit packing of tokenized documents into sequences.

Tokens: each document's ids, then id 0; documents longer than a sequence are cut into pieces of the full length, the
last of which may be shorter. Only lengths matter for the packing, and there are at most `length` of them, so the
whole corpus is planned exactly, on the driver, from a histogram: a bin is filled greedily with the longest pieces
that fit, then its smallest piece is exchanged for two unpacked ones that together fit the widened gap more tightly;
the same bin is used as often as the counts allow. The pieces then take their places in the plan by their rank among
those of the same length, which is counted in parts, so no length (a third of the corpus may share one) meets in a task.

Defined results: null text is an empty text, which is the one token 0; repeated rows are packed each; a null doc_id is
carried; other columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.subwords import subwords
from skarn.llm.words import batches
from skarn.runtime import dealt, parallelism, ship, table, written


@dataclass(frozen=True)
class PackConfig:
    length: int = 2048
    #: A file of a public tokenizer; None: word_bpe_49k.json.
    tokenizer: str | None = None
    end_id: int = 0
    #: Units (about words) whose ids a task keeps at hand.
    kept_words: int = 1_000_000


def pieces(docs: DataFrame, cfg: PackConfig) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for every piece of every row."""

    def run(it):
        import pyarrow as pa

        ids, step = subwords(cfg.tokenizer, cfg.kept_words), cfg.length
        for batch, texts in batches(it, most=3 << 20):
            flat, count = ids(texts)
            out: list[tuple] = []
            at = 0
            for doc, n in zip(batch.column(0).to_pylist(), count.tolist(), strict=True):
                data = np.append(flat[at : at + n], np.uint32(cfg.end_id)).astype("<u4")
                at += n
                out.extend((doc, i, lo, len(data[lo : lo + step]), zlib.crc32(data[lo : lo + step])) for i, lo in enumerate(range(0, n + 1, step)))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: np.ndarray, length: int) -> list[tuple[dict[int, int], int]]:
    """Bins for counts[l] pieces of each length l: ({length: copies}, times), the longest remaining piece first."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    lengths = np.arange(length + 1)
    out: list[tuple[dict[int, int], int]] = []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return out
        room, held = length, {}
        while room:
            fit = there[: np.searchsorted(there, room, side="right")]
            if not len(fit):
                break
            big = int(fit[-1])
            free = int(left[big]) - held.get(big, 0)
            if not free:
                there = there[there != big]
                continue
            n = min(room // big, free)
            held[big] = held.get(big, 0) + n
            room -= n * big
        if room:
            # best[g]: the longest unpacked piece of at most g tokens.
            now = left.copy()
            for k, n in held.items():
                now[k] -= n
            small = min(held)
            gap = room + small
            best = np.maximum.accumulate(np.where(now > 0, lengths, 0))
            a = np.flatnonzero(now[: gap + 1])
            b = best[gap - a]
            same = b == a
            if same.any():
                # The same length twice needs two pieces of it; else the next shorter one.
                lower = np.concatenate([[0], best[:-1]])
                b = np.where(same & (now[a] < 2), lower[a], b)
            total = np.where(b > 0, a + b, 0)
            if len(a) and int(total.max()) > small:
                i = int(np.argmax(total))
                held[small] -= 1
                for k in (int(a[i]), int(b[i])):
                    held[k] = held.get(k, 0) + 1
                held = {k: n for k, n in held.items() if n}
        times = min(int(left[k]) // n for k, n in held.items())
        for k, n in held.items():
            left[k] -= n * times
        out.append((held, times))


def places(plan_: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, copies in a bin, first sequence, offset of the first copy), by length and rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for held, times in plan_:
        offset = 0
        for k in sorted(held, reverse=True):
            rows.append((k, rank.get(k, 0), held[k], sequence, offset))
            rank[k] = rank.get(k, 0) + held[k] * times
            offset += k * held[k]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def packed(docs: DataFrame, cfg: PackConfig | None = None) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    cfg = cfg or PackConfig()
    spark = docs.sparkSession
    parts = parallelism(spark)
    cut = written(pieces(docs, cfg).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32"), F.lit(parts)).cast("int")), "pieces")
    # At most `length` rows for each part; their prefix sums say at which rank a part's pieces of a length begin.
    sizes = written(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "sizes")
    counts = np.zeros(cfg.length + 1, np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    sent = spark.sparkContext.broadcast(places(plan(counts, cfg.length)))
    begun = sizes.select("length", "part", F.expr("sum(n) over (partition by length order by part) - n").alias("begun"))
    ranked = (
        # The table of begun ranks grows with the number of parts: never broadcast, and the window uses the same exchange.
        cut.join(begun.hint("merge"), ["length", "part"])
        .withColumn("rank", F.expr("begun + row_number() over (partition by part, length order by doc_id, piece, ids_crc32) - 1"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    )

    def run(it):
        import pyarrow as pa

        rows = sent.value
        key = (rows[:, 0] << 40) | rows[:, 1]
        for batch in it:
            length, rank = (np.asarray(batch.column(i), np.int64) for i in (3, 5))
            own = rows[np.searchsorted(key, (length << 40) | rank, side="right") - 1]
            j = rank - own[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(own[:, 3] + j // own[:, 2]), pa.array(own[:, 4] + j % own[:, 2] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, cut and packed into sequences of at most 2048 tokens."""
    return packed(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")))
