"""Phrases and proximity from stored positions.

A phrase stands in a text at the start of a word, its right edge open. All its runs of letters and digits but the last are
then whole words of the text, one right after the other, and the last one begins the word after them. So the positions
of these words, met rarest first, give all texts that may hold it; only these are looked at. A phrase that is one open
word and begins with a letter stands in just the texts with a word that begins so: no text is looked at for it.

The window of a question in a text is the shortest stretch of words that holds all of its words that the text has."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.functions.text import contains_normalized, normalize, phrase_words
from skarn.operators.segments import IN_BITS, Snapshot, blocks_of, of_words
from skarn.runtime import ship, written

#: Words stand at most so many places apart in a text; a text's place and a position are one number.
_PLACES = 32


def occurrences(docs: np.ndarray, tfs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A word's occurrences in a shard, each as (place of the text, position) in one ascending number."""
    return (np.repeat(docs.astype(np.int64), tfs) << _PLACES) | at


def following(words: list[str], held: dict[str, np.ndarray]) -> np.ndarray:
    """Occurrences of the first word at which the words follow one another, ascending; held: occurrences by word."""
    order = sorted(range(len(words)), key=lambda i: len(held[words[i]]))
    found = held[words[order[0]]] - order[0]
    for i in order[1:]:
        other = held[words[i]] - i
        at = np.minimum(np.searchsorted(other, found), len(other) - 1)
        found = found[other[at] == found]
        if not len(found):
            break
    return found


def window(lists: list[np.ndarray], ordered: bool = False) -> int:
    """Words in the shortest stretch that holds a position of every list; in the order of the lists if asked. 0: none."""
    if not lists:
        return 0
    if ordered:
        start = end = lists[0]
        for x in lists[1:]:
            at = np.searchsorted(x, end, side="right")
            keep = at < len(x)
            start, end = start[keep], x[at[keep]]
    else:
        start = np.sort(np.concatenate(lists))
        end = start
        for x in lists:
            at = np.searchsorted(x, start)
            keep = at < len(x)
            start, end = start[keep], np.maximum(end[keep], x[at[keep]])
    return int((end - start).min()) + 1 if len(start) else 0


def _lists(table):
    docs, tfs, at = (table.column(c).combine_chunks() for c in ("docs", "tfs", "at"))
    cuts = [np.asarray(x.offsets) for x in (docs, at)]
    d, t, a = (np.asarray(x.values) for x in (docs, tfs, at))
    for i, term in enumerate(table.column("term").to_pylist()):
        lo, hi = cuts[0][i], cuts[0][i + 1]
        yield term, d[lo:hi], t[lo:hi], a[cuts[1][i] : cuts[1][i + 1]]


def beginning(begin: str, terms: list[str]) -> range:
    """Which of some sorted terms begin so."""
    lo = bisect_left(terms, begin)
    return range(lo, bisect_left(terms, True, lo, key=lambda t: not t.startswith(begin)))


def _looking(sent):
    """A function over a shard's rows: in which of its texts the words of each phrase follow one another, and a word that
    begins as its open one comes next."""

    def run(table):
        import pyarrow as pa

        rows = sorted(_lists(table), key=lambda x: x[0])
        terms, own = [x[0] for x in rows], {x[0]: x[1:] for x in rows}
        held: dict[str, np.ndarray] = {}

        def at(term):
            if term not in held:
                held[term] = occurrences(*own[term])
            return held[term]

        def found(words, begin):
            if any(w not in own for w in words):
                return np.zeros(0, np.int64)
            starts = following(words, {w: at(w) for w in words}) if words else None
            if begin is None or (starts is not None and not len(starts)):
                return np.zeros(0, np.int64) if starts is None else np.unique(starts >> _PLACES)
            next_ = [terms[i] for i in beginning(begin, terms)]
            if starts is None:
                return np.unique(np.concatenate([np.zeros(0, np.int64), *(own[t][0] for t in next_)]))
            # Open words may be many, and are looked up among the few starts, not the reverse.
            hit = np.zeros(len(starts), bool)
            for t in next_:
                other = occurrences(*own[t]) - len(words)
                i = np.minimum(np.searchsorted(starts, other), len(starts) - 1)
                hit[i[starts[i] == other]] = True
            return np.unique(starts[hit] >> _PLACES)

        places = [found(*x) for x in sent.value]
        n = [len(x) for x in places]
        place = np.concatenate(places) if places else np.zeros(0, np.int64)
        return pa.table({"number": np.repeat(np.arange(len(n)), n).astype(np.int64), "shard": np.full(len(place), table.column("shard")[0].as_py() if table.num_rows else 0, np.int32), "place": place.astype(np.int32)})

    return run


def _of_words(places: DataFrame, words: set[str], begins: set[str]) -> DataFrame:
    """The rows of these words and of all that begin as one of `begins`."""
    if not begins:
        return of_words(places, sorted(words))
    spark = places.sparkSession
    cuts = F.array(*(F.substring("term", 1, n) for n in sorted({len(b) for b in begins})))
    terms = places.select("term").distinct().select("term", F.explode(F.array_distinct(cuts)).alias("begin"))
    terms = terms.join(F.broadcast(spark.createDataFrame([(b,) for b in begins], "begin string")), "begin", "left_semi").select("term")
    # Once they are written, words are known to be few: no one then shuffles the places to join them.
    terms = written(terms.unionByName(spark.createDataFrame([(w,) for w in words], "term string")).distinct(), "terms")
    return places.join(terms, "term", "left_semi")


def candidates(index: Snapshot, phrases: DataFrame, block_rows: int = 20_000) -> DataFrame:
    """(phrase_id, shard, place, sure) of all texts that may hold a phrase (phrase_id, phrase), by positions alone; sure:
    they do hold it.

    Phrases go in blocks of bounded size. One without a letter or digit may stand in any text."""
    ship(index.spark)
    out = None
    runs = phrases.where("phrase is not null").select("phrase_id", normalize(F.col("phrase")).alias("p"), phrase_words(F.col("phrase")).alias("runs"))
    # Where the phrase ends in a letter or digit, its last run may go on.
    open_ = F.col("p").rlike(r"[\p{L}\p{N}]$") & (F.size("runs") > 0)
    cut = runs.select(
        "phrase_id", "runs", F.when(open_, F.slice("runs", 1, F.size("runs") - 1)).otherwise(F.col("runs")).alias("whole"), F.when(open_, F.element_at("runs", -1)).alias("begin"),
        # A number that comes after a digit and a point is none of its own, which only the text tells.
        (open_ & (F.get("runs", 0) == F.col("p")) & ~F.col("p").rlike(r"^\p{Nd}")).alias("sure"),
    )
    places = index.table("places").select("shard", "term", "docs", "tfs", "at")
    for block in blocks_of(cut.where("size(runs) > 0"), block_rows, "phrase_id"):
        asked = block.select("phrase_id", "whole", "begin", "sure").collect()
        if not asked:
            continue
        rows = _of_words(places, {w for r in asked for w in r["whole"]}, {r["begin"] for r in asked if r["begin"] is not None})
        sent = index.spark.sparkContext.broadcast([(r["whole"], r["begin"]) for r in asked])
        hits = rows.groupBy("shard").applyInArrow(_looking(sent), "number long, shard int, place int")
        names = index.spark.createDataFrame([(i, r["phrase_id"], r["sure"]) for i, r in enumerate(asked)], f"number long, phrase_id {dict(phrases.dtypes)['phrase_id']}, sure boolean")
        part = hits.join(F.broadcast(names), "number").select("phrase_id", "shard", "place", "sure")
        out = part if out is None else out.unionByName(part)
    bare = cut.where("size(runs) = 0").select("phrase_id").crossJoin(index.table("docs").select("shard", "place")).withColumn("sure", F.lit(False))
    return bare if out is None else out.unionByName(bare)


def holding(index: Snapshot, phrases: DataFrame, *columns: str) -> DataFrame:
    """(phrase_id, key, columns) of the texts that hold a phrase (phrase_id, phrase) at the start of a word. Texts are
    moved and normalized where they may hold one that positions do not settle, once for all phrases, and nowhere else."""
    found = written(candidates(index, phrases), "may_hold")
    names = list(dict.fromkeys((index.key, *columns)))
    sure = found.where("sure").drop("sure").join(index.docs.select("shard", "place", *names), ["shard", "place"]).select("phrase_id", *names)
    sought = phrases.select("phrase_id", normalize(F.col("phrase")).alias("sought"))
    unsure = found.where("not sure").join(sought, "phrase_id").groupBy("shard", "place").agg(F.collect_list(F.struct("phrase_id", "sought")).alias("_asked"))
    # A few kilobytes for each shard keep all other texts from being shuffled.
    bits = found.where("not sure").groupBy("shard").agg(F.expr("bitmap_construct_agg(bitmap_bit_position(cast(place + 1 as bigint)))").alias("bits"))
    texts = index.docs.select("shard", "place", F.struct(*names).alias("_own"), F.coalesce("text", F.lit("")).alias("_text")).join(F.broadcast(bits), "shard").where(F.expr(IN_BITS)).drop("bits")
    both = texts.join(unsure, ["shard", "place"]).select("_own", normalize(F.col("_text")).alias("_held"), "_asked").select("_own", "_held", F.explode("_asked").alias("_one"))
    held = both.where(contains_normalized(F.col("_held"), F.col("_one.sought"))).select("_one.phrase_id", *(F.col("_own")[n].alias(n) for n in names))
    return sure.unionByName(held)


def proximity(index: Snapshot, questions: DataFrame, hits: DataFrame) -> DataFrame:
    """hits (question_id, key, ...) with what a reranker by proximity needs: `words` of the question, how many the text has
    (`held`), and the words in the shortest stretch with all of those, in any order (`window`) and in the question's
    (`in_order`; 0 if there is none)."""
    ship(index.spark)
    asked = questions.select("question_id", F.array_distinct(phrase_words(F.col("text"))).alias("sought"))
    at = hits.select("question_id", index.key).join(index.docs.select("shard", "place", index.key), index.key).join(asked, "question_id")
    terms = at.select(F.col("shard").alias("s"), F.explode("sought").alias("t")).distinct()
    rows = index.table("places").join(terms, (F.col("shard") == F.col("s")) & (F.col("term") == F.col("t"))).select("shard", "term", "docs", "tfs", "at")
    numbered = at.select(F.col("question_id").cast("string").alias("q"), F.col(index.key).cast("string").alias("k"), (F.col("shard") + 0).alias("own"), "place", "sought")

    def run(left, right):
        import pyarrow as pa

        held = {}
        for term, docs, tfs, places in _lists(right):
            ends = np.cumsum(tfs)
            held[term] = (docs, ends - tfs, ends, places)
        out = []
        for q, k, place, sought in zip(*(left.column(c).to_pylist() for c in ("q", "k", "place", "sought")), strict=True):
            lists = []
            for w in sought:
                docs, a, b, places = held.get(w, (np.zeros(0, np.int32),) * 4)
                i = int(np.searchsorted(docs, place))
                if i < len(docs) and docs[i] == place:
                    lists.append(places[a[i] : b[i]])
            out.append((q, k, len(sought), len(lists), window(lists), window(lists, True)))
        kinds = [pa.string(), pa.string(), *[pa.int32()] * 4]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["q", "k", "words", "held", "window", "in_order"])

    # A shard without any of the words has no row on the right.
    found = numbered.groupBy("own").cogroup(rows.groupBy("shard")).applyInArrow(run, "q string, k string, words int, held int, window int, in_order int")
    return hits.join(found, (F.col("question_id").cast("string") == F.col("q")) & (F.col(index.key).cast("string") == F.col("k"))).drop("q", "k")


def proximity_score(words, held, window_, in_order):
    """From 0 to 1: the share of the question's words that a text has, less where they stand apart, a little more where they
    stand in the question's order."""
    near = F.when(window_ > 0, held / window_).otherwise(F.lit(0.0))
    order = F.when(in_order > 0, held / in_order).otherwise(F.lit(0.0))
    return F.when(words > 0, held / words * (0.6 + 0.3 * near + 0.1 * order)).otherwise(F.lit(0.0))
