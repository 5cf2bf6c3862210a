"""The stored search index, in segments: what a sync adds is one segment, and readers hold a snapshot.

A segment holds documents in shards of a few thousand; a shard is searched by one task. The first three of its tables are
written in one pass, so that a text is shuffled and cut into words once. Its tables:

* `docs`: shard, place in the shard (by key), the columns that were given, and the distinct search words of the text;
* `postings` (shard, term, docs, tfs, weights, most): a search word's places, counts, weights and largest weight;
* `places` (shard, term, docs, tfs, at): the same for the words of phrases, with their positions;
* `terms` (term, df), what the segment adds to how many documents have a word, and takes away with what it deletes;
* `bits` (shard, access_level, status, gone, bits): bitmaps of places by labels, and of places in older segments' shards
  that are deleted.

A manifest names the segments of a version. A new version is written aside and put in place by a rename that fails if
another writer was first, so a reader sees all of a sync or nothing, and a crash leaves the old version as it was. Files
of segments are never changed; `merged` writes the small ones anew as one.

Defined results: of rows with one key, one stays; null keys are dropped; null text is an empty text; an empty frame adds an
empty segment."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from skarn.functions.text import phrase_words, query_tokens, search_tokens
from skarn.runtime import concurrent_writers, parallelism, scratch, ship, written
from skarn.settings import DEFAULT, Settings

#: A bitmap has 32,768 places; shards are dealt by a hash, so their average stays well below.
SHARD_DOCS, SHARD_BYTES, LEAST_DOCS = 16_384, 64 << 20, 512
#: Words of a search that are pushed into the scan as values; more are joined.
PUSHED = 200
TABLES = ("docs", "postings", "places", "terms", "bits")
#: Those that one pass writes, each as a column of its own beside `kind`, with what the last two hold.
TOGETHER = {
    "docs": None,
    "postings": "shard int, term string, docs array<int>, tfs array<int>, weights array<double>, most double",
    "places": "shard int, term string, docs array<int>, tfs array<int>, at array<int>",
}
#: Whether a place is in a bitmap; in none if that is null.
IN_BITS = "coalesce(shiftright(cast(conv(hex(substring(bits, cast(place div 8 as int) + 1, 1)), 16, 10) as int), cast(place % 8 as int)) & 1, 0) = 1"


class Conflict(RuntimeError):
    """Another writer put a version in place first."""


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, f"{path}/manifest")
    return sorted(n for n in (st.getPath().getName() for st in fs.listStatus(at)) if n.startswith("v") and not n.endswith(".new")) if fs.exists(at) else []


def _load(spark: SparkSession, path: str, version: str | None = None) -> dict:
    names = _versions(spark, path)
    if not names:
        return {"version": 0, "segments": [], "next_shard": 0}
    fs, at = _fs(spark, f"{path}/manifest/{version or names[-1]}")
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _swap(spark: SparkSession, path: str, manifest: dict) -> None:
    """Puts the next version in place; fails if there is one by now."""
    name = f"{path}/manifest/v{manifest['version']:08d}"
    fs, at = _fs(spark, name)
    _, aside = _fs(spark, f"{name}.{uuid.uuid4().hex}.new")
    fs.mkdirs(at.getParent())
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if fs.exists(at) or not fs.rename(aside, at):
        fs.delete(aside, False)
        raise Conflict(f"{name} is there already")


@dataclass(frozen=True)
class Snapshot:
    """What a reader holds: the tables of one version's segments. Later versions do not show in it."""

    spark: SparkSession
    path: str
    version: int
    segments: tuple[dict, ...]
    key: str

    @property
    def size(self) -> int:
        return sum(s["docs"] - s["gone"] for s in self.segments)

    def table(self, name: str) -> DataFrame:
        return _table(self.spark, [f"{self.path}/{s['id']}" for s in self.segments], name)

    @property
    def bits(self) -> DataFrame:
        return self.table("bits")

    @property
    def docs(self) -> DataFrame:
        """The documents that are not deleted."""
        docs = self.table("docs")
        if not any(s["gone"] for s in self.segments):
            return docs
        gone = self.bits.where("gone").groupBy("shard").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
        return docs.join(gone, "shard", "left").where(~F.expr(IN_BITS)).drop("bits")

    @property
    def rarity(self) -> DataFrame:
        """(term, df, idf) over all documents that are not deleted; never negative."""
        df = self.table("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return df.withColumn("idf", F.log(1 + (F.lit(self.size) - F.col("df") + 0.5) / (F.col("df") + 0.5)))

    @property
    def postings(self) -> DataFrame:
        """(key, term, tf, weight), one row for each document and search word."""
        each = self.table("postings").select("shard", "term", F.explode(F.arrays_zip("docs", "tfs", "weights")).alias("x"))
        rows = each.select("shard", F.col("x.docs").alias("place"), "term", F.col("x.tfs").cast("long").alias("tf"), F.col("x.weights").alias("weight"))
        # Spark takes a list of postings for one, and would broadcast them all.
        return rows.hint("merge").join(self.docs.select("shard", "place", self.key), ["shard", "place"]).drop("shard", "place")


def _table(spark: SparkSession, segments: list[str], name: str) -> DataFrame:
    if name not in TOGETHER:
        return spark.read.parquet(*(f"{x}/{name}" for x in segments))
    return spark.read.parquet(*(f"{x}/rows/kind={name}" for x in segments)).select(f"{name}.*")


def read(spark: SparkSession, path: str, version: int | None = None) -> Snapshot | None:
    """The newest snapshot, or an older one; None where nothing is indexed."""
    path = path.rstrip("/")
    m = _load(spark, path, version and f"v{version:08d}")
    return Snapshot(spark, path, m["version"], tuple(m["segments"]), m["key"]) if m["segments"] else None


def _inverted(s: Settings):
    """A function over Arrow batches (shard, place, found, said, docs), in order: the rows of `TOGETHER`, each shard's
    documents and then its inverted indexes of both kinds of words."""
    import pyarrow as pa

    ints, numbers = pa.list_(pa.int32()), pa.list_(pa.float64())
    lists = {
        "postings": pa.struct([("shard", pa.int32()), ("term", pa.string()), ("docs", ints), ("tfs", ints), ("weights", numbers), ("most", pa.float64())]),
        "places": pa.struct([("shard", pa.int32()), ("term", pa.string()), ("docs", ints), ("tfs", ints), ("at", ints)]),
    }

    def one_kind(name: str, x, docs):
        """Rows of one kind; docs: the type of documents."""
        types = {"docs": docs, **lists}
        cols = [x if n == name else pa.nulls(len(x), t) for n, t in types.items()]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(x), pa.string()), *cols], names=["kind", *types])

    def made(shard: int, parts: list, weigh: bool):
        words = pa.chunked_array([p.column(2 if weigh else 3) for p in parts]).combine_chunks()
        if isinstance(words, pa.ChunkedArray):
            words = pa.concat_arrays(words.chunks)
        place = np.concatenate([np.asarray(p.column(1)) for p in parts])
        size = np.diff(np.asarray(words.offsets))
        found = words.flatten().dictionary_encode()
        if isinstance(found, pa.ChunkedArray):
            found = found.combine_chunks()
        code = np.asarray(found.indices)
        if not len(code):
            return None
        doc = np.repeat(np.arange(len(place)), size)
        at = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
        order = np.argsort(code, kind="stable")
        code, doc, at = code[order], doc[order], at[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        tf = np.diff(np.append(begin, len(code)))
        word, own = code[begin], doc[begin]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        cut = pa.array(np.append(first, len(word)).astype(np.int32))
        listed = lambda x: pa.ListArray.from_arrays(cut, x)
        cols = {"shard": pa.array(np.full(len(first), shard, np.int32)), "term": found.dictionary.take(pa.array(word[first])), "docs": listed(pa.array(place[own].astype(np.int32))), "tfs": listed(pa.array(tf.astype(np.int32)))}
        if weigh:
            # Rounded as SQL does: halves go up.
            # The product is that of decimals, as in SQL: tf * 2.2 in doubles is too large for some tf.
            w = np.floor(tf * round((s.bm25_k1 + 1) * 1e6) / 1e6 / (tf + s.bm25_k1 * (1 - s.bm25_b + s.bm25_b * size[own] / s.bm25_average)) * 1e4 + 0.5) / 1e4
            cols |= {"weights": listed(pa.array(w)), "most": pa.array(np.maximum.reduceat(w, first))}
        else:
            cols["at"] = pa.ListArray.from_arrays(pa.array(np.append(begin[first], len(code)).astype(np.int32)), pa.array(at.astype(np.int32)))
        kind = lists["postings" if weigh else "places"]
        return pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(cols.values(), kind, strict=True)], fields=list(kind))

    def inverted(shard: int, parts: list, docs):
        for name in lists:
            if (x := made(shard, parts, name == "postings")) is not None:
                yield one_kind(name, x, docs)

    def run(it):
        held, shard, docs = [], None, None
        for batch in it:
            docs = batch.column(4).type
            ids = np.asarray(batch.column(0))
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and int(ids[a]) != shard:
                    yield from inverted(shard, held, docs)
                    held = []
                shard, own = int(ids[a]), batch.slice(a, b - a)
                yield one_kind("docs", own.column(4), docs)
                # The texts are not needed any more.
                held.append(own.select([0, 1, 2, 3]))
        if held:
            yield from inverted(shard, held, docs)

    return run


def add(spark: SparkSession, path: str, rows: DataFrame, gone: DataFrame | None = None, key: str = "doc_id", s: Settings = DEFAULT, replacing: tuple[str, ...] = ()) -> Snapshot:
    """Writes rows (key, text, and more) as one segment that also deletes `gone` (shard, place), and puts the new version in
    place. replacing: segments that go with it.

    Labels (access_level, status) are taken where there are any; without them a row is seen by everyone."""
    ship(spark)
    path = path.rstrip("/")
    now = _load(spark, path)
    base, name = now["next_shard"], f"segment-{uuid.uuid4().hex[:12]}"
    at = f"{path}/{name}"
    n, size = rows.where(F.col(key).isNotNull()).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()
    shards = max(1, -(-n // SHARD_DOCS), -(-size // SHARD_BYTES), min(parallelism(spark), -(-n // LEAST_DOCS)))
    for c in ("access_level", "status"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    with scratch(spark):
        part = rows.where(F.col(key).isNotNull()).withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")).repartitionById(shards, "shard")
        # Both windows go by the partition and the order that are there: texts are moved once.
        once = part.withColumn("copy", F.row_number().over(Window.partitionBy("shard", key).orderBy(key))).where("copy = 1").drop("copy")
        cut = once.withColumn("place", (F.row_number().over(Window.partitionBy("shard").orderBy(key)) - 1).cast("int")).withColumn("shard", F.col("shard") + base)
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        cut = cut.withColumns({"found": search_tokens(text, s), "said": phrase_words(text)})
        own = [c for c in rows.columns if c not in ("shard", "place", "words", "found", "said")]
        cut = cut.select("shard", "place", "found", "said", F.struct(*own, "shard", "place", F.array_distinct("found").alias("words")).alias("docs"))
        shape = StructType([StructField("kind", StringType()), StructField("docs", cut.schema["docs"].dataType), *(StructField(n, StructType.fromDDL(d)) for n, d in TOGETHER.items() if d)])
        with concurrent_writers(spark):
            cut.mapInArrow(_inverted(s), shape).write.partitionBy("kind").parquet(f"{at}/rows")
        for kind in TOGETHER:
            fs, there = _fs(spark, f"{at}/rows/kind={kind}")
            if not fs.exists(there):
                spark.createDataFrame([], shape).drop("kind").write.parquet(f"{at}/rows/kind={kind}")
        now_written = lambda kind: _table(spark, [at], kind)
        labels = now_written("docs").groupBy("shard", "access_level", "status").agg(F.expr("bitmap_construct_agg(bitmap_bit_position(cast(place + 1 as bigint)))").alias("bits")).withColumn("gone", F.lit(False))
        df = now_written("postings").groupBy("term").agg(F.sum(F.size("docs")).cast("long").alias("df"))
        lost = 0
        if gone is not None:
            gone = written(gone.select("shard", "place").distinct(), "gone")
            lost = gone.count()
        if lost:
            old = Snapshot(spark, path, now["version"], tuple(now["segments"]), now["key"])
            labels = labels.unionByName(gone.groupBy("shard").agg(F.expr("bitmap_construct_agg(bitmap_bit_position(cast(place + 1 as bigint)))").alias("bits")).select("shard", F.lit(None).cast("string").alias("access_level"), F.lit(None).cast("string").alias("status"), F.lit(True).alias("gone"), "bits"))
            less = old.table("docs").join(gone, ["shard", "place"], "left_semi").select(F.explode("words").alias("term")).groupBy("term").agg((-F.count("*")).alias("df"))
            df = df.unionByName(less)
        labels.select("shard", "access_level", "status", "gone", "bits").write.parquet(f"{at}/bits")
        df.write.parquet(f"{at}/terms")
        count = now_written("docs").count()
    kept = [x for x in now["segments"] if x["id"] not in replacing]
    manifest = {"version": now["version"] + 1, "key": key, "next_shard": base + shards, "segments": [*kept, {"id": name, "docs": count, "gone": lost, "shards": shards}]}
    _swap(spark, path, manifest)
    return Snapshot(spark, path, manifest["version"], tuple(manifest["segments"]), key)


def write(texts: DataFrame, path: str, s: Settings = DEFAULT, key: str = "doc_id") -> Snapshot:
    """A new index of texts (key, text, and more) at the path, which must be free."""
    if _versions(texts.sparkSession, path.rstrip("/")):
        raise Conflict(f"an index stands at {path}")
    return add(texts.sparkSession, path, texts, key=key, s=s)


def merged(spark: SparkSession, path: str, most_docs: int = 1_000_000, at_least: int = 4, s: Settings = DEFAULT) -> Snapshot:
    """Writes small segments anew as one, without what is deleted, once there are so many of them.

    Segments that delete from others stay as they are unless all they delete from goes, too; so all or none of an index with
    deletions is merged. Files of the old segments stay for readers of older versions; `forget` removes them."""
    snap = read(spark, path)
    small = [x for x in snap.segments if x["docs"] <= most_docs]
    if any(x["gone"] for x in snap.segments) and len(small) < len(snap.segments):
        return snap
    if len(small) < at_least:
        return snap
    part = Snapshot(spark, snap.path, snap.version, tuple(small), snap.key)
    return add(spark, path, part.docs.drop("shard", "place", "words"), key=snap.key, s=s, replacing=tuple(x["id"] for x in small))


def forget(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes all versions but the newest ones, and segments that none of those names; returns how many segments went."""
    path = path.rstrip("/")
    names = _versions(spark, path)
    used = {x["id"] for v in names[-keep:] for x in _load(spark, path, v)["segments"]}
    for v in names[:-keep]:
        fs, at = _fs(spark, f"{path}/manifest/{v}")
        fs.delete(at, False)
    fs, at = _fs(spark, path)
    gone = [st.getPath() for st in fs.listStatus(at) if st.getPath().getName().startswith("segment-") and st.getPath().getName() not in used]
    for p in gone:
        fs.delete(p, True)
    return len(gone)


def _asked(index: Snapshot, questions: DataFrame, tokens) -> list[tuple]:
    """(question number, term, idf, df) of a block of questions, rarest first: the block is bounded, so are its words."""
    rows = questions.select("number", F.explode(tokens).alias("term")).join(index.rarity, "term")
    return sorted((r["number"], r["df"], r["term"], r["idf"]) for r in rows.collect())


def of_words(table: DataFrame, words: list[str]) -> DataFrame:
    """The rows of these words: values in the scan, or a join with a bounded table of them."""
    if len(words) <= PUSHED:
        return table.where(F.col("term").isin(words))
    return table.join(F.broadcast(table.sparkSession.createDataFrame([(w,) for w in words], "term string")), "term", "left_semi")


def seen(bits, size: int, levels, superseded: bool) -> np.ndarray:
    """Which places of a shard may be seen: bitmaps of the labels or-ed, deleted places taken out."""
    may, gone = np.zeros(size, bool), np.zeros(size, bool)
    for level, status, lost, x in zip(*(bits.column(c).to_pylist() for c in ("access_level", "status", "gone", "bits")), strict=True):
        own = np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")[:size].astype(bool)
        if lost:
            gone |= own
        elif levels is None or (level in levels and (superseded or status == "active")):
            may |= own
    return may & ~gone


#: The floor comes from words that stand in so many times k documents together.
RARE = 40
#: Postings in a block, for counting what a search reads.
BLOCK = 16


def shard_topk(words: dict, asked: list[list], floor: np.ndarray, may: np.ndarray, k: int) -> tuple[list[tuple], np.ndarray]:
    """((question, place, score) of the k best places of a shard, (blocks there, blocks read) by question).

    words: term -> (places, weights, largest weight); asked: by question (term, idf); floor: scores that k documents
    reach for sure. A question's words are taken in the order of what they can add. Once those left cannot lift a document to
    the floor (the better of the given one and the k-th best here), only documents that could still reach it are
    looked up in them, one word after the other. So all that reach the floor have their whole score."""
    out, blocks = [], np.zeros((len(asked), 2), np.int64)
    score = np.zeros(len(may))
    for q, own in enumerate(asked):
        terms = [(idf * words[t][2], idf, *words[t]) for t, idf in own if t in words]
        if not terms:
            continue
        terms.sort(key=lambda x: -x[0])
        blocks[q, 0] = sum(-(-len(x[2]) // BLOCK) for x in terms)
        score[:] = 0
        left, least, full = sum(x[0] for x in terms), floor[q], len(terms)
        after = np.cumsum([0, *(-(-len(x[2]) // BLOCK) for x in terms)])
        held = None
        for i, (most, idf, docs, weights, _) in enumerate(terms):
            if left < least - 1e-6:
                held = np.flatnonzero(may & (score > 0) & (score + left >= least - 1e-6))
                # Looking documents up pays once they are few for the blocks that are left.
                if 2 * len(held) * (len(terms) - i) < after[-1] - after[i]:
                    full = i
                    break
            score[docs] += idf * weights
            blocks[q, 1] += after[i + 1] - after[i]
            left -= most
            if i < 2 or i % 4 == 3:
                least = max(least, kth(score[may], k))
        if full == len(terms):
            held = np.flatnonzero(may & (score > 0) & (score >= least - 1e-6))
        for most, idf, docs, weights, _ in terms[full:]:
            at = np.minimum(np.searchsorted(docs, held), len(docs) - 1)
            hit = docs[at] == held
            score[held[hit]] += idf * weights[at[hit]]
            blocks[q, 1] += len(np.unique(at // BLOCK))
            left -= most
            least = max(least, kth(score[held], k))
            held = held[score[held] + left >= least - 1e-6]
        value = np.floor(score[held] * 1e6 + 0.5) / 1e6
        best = np.lexsort((held, -value))[:k]
        best = best[value[best] >= floor[q] - 2e-6]
        out += [(q, int(p), float(v)) for p, v in zip(held[best], value[best], strict=True)]
    return out, blocks


def kth(x: np.ndarray, k: int) -> float:
    return float(np.partition(x, -k)[-k]) if len(x) >= k else 0.0


def _scored(index: Snapshot, asked: list[list], floor: np.ndarray, k: int, levels, superseded: bool, count: bool) -> DataFrame:
    """(number, shard, place, score) of every shard's best; with `count`, (number, shard, there, read)."""
    spark = index.spark
    post = of_words(index.table("postings"), sorted({t for own in asked for t, _ in own})).select("shard", "term", "docs", "weights", "most")
    bits = index.bits.withColumn("own", F.col("shard") + 0).drop("shard")
    sent = spark.sparkContext.broadcast((asked, floor))

    def run(left, right):
        import pyarrow as pa

        asked, floor = sent.value
        names = ("number", "shard", "place", "score") if not count else ("number", "shard", "there", "read")
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64()) if not count else (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        shard = left.column("shard")[0].as_py()
        docs, weights = (left.column(c).combine_chunks() for c in ("docs", "weights"))
        cut, d, w = np.asarray(docs.offsets), np.asarray(docs.values), np.asarray(weights.values)
        size = int(d[cut[0] : cut[-1]].max()) + 1
        words = {t: (d[a:b], w[a:b], m) for t, a, b, m in zip(left.column("term").to_pylist(), cut[:-1].tolist(), cut[1:].tolist(), left.column("most").to_pylist(), strict=True)}
        found, blocks = shard_topk(words, asked, floor, seen(right, size, levels, superseded), k)
        rows = [(q, shard, p, v) for q, p, v in found] if not count else [(q, shard, *x) for q, x in enumerate(blocks.tolist())]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    shape = "number long, shard int, place int, score double" if not count else "number long, shard int, there long, read long"
    return post.groupBy("shard").cogroup(bits.groupBy("own")).applyInArrow(run, shape)


def blocks_of(questions: DataFrame, rows: int, key: str = "question_id") -> list[DataFrame]:
    """The frame in parts of about so many rows."""
    n = questions.count()
    parts = max(1, -(-n // rows))
    return [questions if parts == 1 else questions.where(F.pmod(F.xxhash64(key), F.lit(parts)) == b) for b in range(parts)]


def sparse_topk(questions: DataFrame, index: Snapshot, k: int = DEFAULT.prefetch, levels: tuple[str, ...] | None = None, superseded: bool = False, s: Settings = DEFAULT, block_rows: int = 20_000, count: bool = False) -> DataFrame:
    """(question_id, key, score, rank): the k best documents for each question (question_id, text) that `levels` may see.

    Questions go in blocks of bounded size. First their rarest words alone give each a score that k documents reach;
    then shards are searched with that floor, and return only what reaches it. No document table is read but for the keys
    of hits. count: (question_id, there, read) instead, the blocks of its words' postings and those that were needed."""
    ship(index.spark)
    found = None
    for block in blocks_of(questions, block_rows):
        own = block.select("question_id", "text").collect()
        ids = {i: r["question_id"] for i, r in enumerate(own)}
        numbered = index.spark.createDataFrame([(i, r["text"]) for i, r in enumerate(own)], "number long, text string")
        asked: list[list] = [[] for _ in ids]
        rare: list[list] = [[] for _ in ids]
        upto = np.zeros(len(ids), np.int64)
        for q, df, term, idf in _asked(index, numbered, query_tokens(F.col("text"), s)):
            asked[q].append((term, idf))
            if upto[q] < RARE * k:
                rare[q].append((term, idf))
                upto[q] += df
        floor = np.zeros(len(ids))
        # k rows for each shard and question at most come together before the k-th best of all is taken.
        first = _scored(index, rare, floor, k, levels, superseded, False)
        ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score")))).where(F.col("rank") == k)
        for r in ranked.select("number", "score").collect():
            floor[r["number"]] = r["score"]
        hits = _scored(index, asked, floor, k, levels, superseded, count)
        names = index.spark.createDataFrame(list(ids.items()), f"number long, question_id {dict(questions.dtypes)['question_id']}")
        if count:
            part = hits.groupBy("number").agg(F.sum("there").alias("there"), F.sum("read").alias("read"))
            part = part.join(F.broadcast(names), "number").drop("number")
        else:
            named = hits.join(F.broadcast(names), "number").join(index.table("docs").select("shard", "place", index.key), ["shard", "place"])
            rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), index.key))
            part = named.withColumn("rank", rank).where(F.col("rank") <= k).select("question_id", index.key, "score", "rank")
            # Once they are written, hits are known to be few: no one then shuffles the texts to join them.
            part = written(part, "hits")
        found = part if found is None else found.unionByName(part)
    return found
