"""The index in segments: snapshots, deletions, merging, and search with bounds against plain scores."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.operators import index, search, segments
from skarn.operators.catalog import SCHEMA
from skarn.sources import files

DATA = "/root/testdata/sf0.001"


def docs(spark):
    n = F.col("doc_id")
    level, status = F.when(n % 3 == 0, "restricted").otherwise("internal"), F.when(n % 7 == 0, "superseded").otherwise("active")
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source", level.alias("access_level"), status.alias("status"))


def asked(spark):
    short = F.array_join(F.slice(F.split("text", " "), 1, 4), " ")
    b = spark.read.parquet(f"{DATA}/benchmark.parquet")
    return b.select(F.col("item_id").alias("question_id"), "text").unionByName(b.select((F.col("item_id") + 1000).alias("question_id"), short.alias("text"))).unionByName(spark.createDataFrame([(-1, ""), (-2, None), (-3, "qqqq")], "question_id long, text string"))


def rows(df):
    return sorted(tuple(r) for r in df.select("question_id", "doc_id", "score", "rank").collect())


def plain(spark, questions, of, n, levels=None):
    """Scores of every posting, without bounds."""
    post = search.postings(of.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    allowed = None if levels is None else search.visible(of, levels)
    return rows(search.sparse_topk(questions, search.weights(post), search.idf(post, n), 20, allowed))


def test_bounded_search_gives_plain_scores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "LEAST_DOCS", 40)
    d = docs(spark)
    built = segments.write(d, str(tmp_path / "ix"))
    assert built.size == d.count() and built.segments[0]["shards"] > 1
    for levels in (None, ("internal",), ("internal", "restricted"), ()):
        assert rows(segments.sparse_topk(asked(spark), built, 20, levels)) == plain(spark, asked(spark), d, built.size, levels)
    monkeypatch.setattr(segments, "PUSHED", 0)
    assert rows(segments.sparse_topk(asked(spark), built, 20, block_rows=7)) == plain(spark, asked(spark), d, built.size)
    read = segments.sparse_topk(asked(spark), built, 20, count=True).agg(F.sum("there").alias("a"), F.sum("read").alias("b")).first()
    assert 0 < read.b <= read.a


def test_one_shard_against_all_scores():
    rng = np.random.default_rng(4)
    for n, k in ((400, 5), (3000, 20), (50, 60)):
        words, asked = {}, []
        for t in range(40):
            size = int(n * rng.random() ** 3) + 1
            own = np.sort(rng.choice(n, size, replace=False))
            w = np.round(rng.random(size) * 2.2 + 0.01, 4)
            words[t] = (own, w, w.max())
        asked = [[(int(t), float(np.log(n / len(words[t][0]) + 1))) for t in rng.choice(40, m, replace=False)] for m in (1, 3, 12, 35)] + [[(99, 1.0)]]
        may = rng.random(n) < 0.8
        found, blocks = segments.shard_topk(words, asked, np.zeros(len(asked)), may, k)
        for q, own in enumerate(asked):
            score = np.zeros(n)
            for t, idf in own:
                if t in words:
                    score[words[t][0]] += idf * words[t][1]
            best = [(q, int(p), round(float(score[p]), 6)) for p in np.lexsort((np.arange(n), -np.round(score, 6))) if may[p] and score[p] > 0][:k]
            assert [(a, b, round(c, 6)) for a, b, c in found if a == q] == best
        assert (blocks[:, 1] <= blocks[:, 0]).all()


def test_common_words_are_only_looked_up():
    """One rare word decides; of a word that all documents have, only the blocks of its documents are read."""
    n = 10_000
    words = {"rare": (np.arange(0, n, 500), np.full(20, 2.0), 2.0), "common": (np.arange(n), np.linspace(0.5, 1, n), 1.0)}
    found, blocks = segments.shard_topk(words, [[("rare", 6.0), ("common", 0.1)]], np.zeros(1), np.ones(n, bool), 5)
    assert [p for _, p, _ in found] == [9500, 9000, 8500, 8000, 7500] and blocks[0, 1] < blocks[0, 0] / 10


def test_three_syncs_give_what_is_built_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "LEAST_DOCS", 40)
    path, labels = str(tmp_path / "ix"), spark.createDataFrame([], SCHEMA)
    base = docs(spark).select("source", "doc_id", "text")

    def state(k):
        now = base.where("source <> 'src0'") if k > 1 else base
        return now.withColumn("text", F.when(F.col("source") == f"src{k}", F.concat("text", F.lit(" added words"))).otherwise(F.col("text")))

    def synced(k):
        now = state(k)
        listed = now.groupBy("source").agg(F.sum(F.xxhash64("doc_id", "text").cast("decimal(38,0)")).cast("string").alias("file_hash"))
        build = lambda changed: now.join(changed.select("source"), "source").select("source", F.col("doc_id").cast("int").alias("chunk_index"), "text", "doc_id")
        return index.sync(spark, listed, labels, path, build).groupBy("action").count().collect()

    synced(1)
    first = segments.read(spark, path)
    before = {r["path"]: r["at"] for r in first.table("postings").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("at")).distinct().collect()}
    old = sorted(map(tuple, first.docs.select("doc_id", "text").collect()))
    synced(2)
    assert {r["action"]: r["count"] for r in synced(3)}["index"] == 2
    last = segments.read(spark, path)
    # Files of unchanged documents are as they were; the reader from before sees its own rows.
    after = {r["path"]: r["at"] for r in last.table("postings").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("at")).distinct().collect()}
    assert before.items() <= after.items() and len(last.segments) == 3
    assert sorted(map(tuple, first.docs.select("doc_id", "text").collect())) == old
    whole = segments.write(state(3), str(tmp_path / "whole"))
    assert last.size == whole.size
    assert sorted(map(tuple, last.rarity.collect())) == sorted(map(tuple, whole.rarity.collect()))
    name = last.docs.select("point_id", "doc_id")
    post = lambda s: sorted(map(tuple, s.select("doc_id", "term", "tf", "weight").collect()))
    assert post(last.postings.join(name, "point_id")) == post(whole.postings)
    hits = segments.sparse_topk(asked(spark), last, 20).join(name, "point_id")
    score = lambda df: sorted((r["question_id"], r["rank"], r["score"]) for r in df.collect())
    assert score(hits) == score(segments.sparse_topk(asked(spark), whole, 20))
    assert segments.read(spark, path, 1).size == first.size
    # Merged, and the rest forgotten.
    one = segments.merged(spark, path, at_least=2)
    assert len(one.segments) == 1 and sorted(map(tuple, one.rarity.collect())) == sorted(map(tuple, whole.rarity.collect()))
    assert segments.forget(spark, path, keep=1) == 3 and segments.read(spark, path).docs.count() == whole.size


def test_a_second_writer_is_refused(spark, tmp_path):
    path, one = str(tmp_path / "ix"), spark.createDataFrame([(1, "a text of words")], "doc_id long, text string")
    segments.write(one, path)
    with pytest.raises(segments.Conflict):
        segments.write(one, path)
    now = segments._load(spark, path)
    segments.add(spark, path, one)
    with pytest.raises(segments.Conflict):
        segments._swap(spark, path, {**now, "version": 2})
    assert segments.read(spark, path).version == 2


def test_defined_results(spark, tmp_path):
    rows_ = [(1, "alpha beta", 7), (1, "alpha beta", 7), (None, "alpha", 7), (2, None, 7), (3, "", 7), (4, "alpha " * 5000, 7)]
    ix = segments.write(spark.createDataFrame(rows_, "doc_id long, text string, shards int"), str(tmp_path / "ix"))
    assert ix.size == 4
    got = segments.sparse_topk(spark.createDataFrame([("q", "alpha")], "question_id string, text string"), ix).collect()
    assert [(r["question_id"], r["doc_id"]) for r in got] == [("q", 4), ("q", 1)]
    empty = segments.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"))
    assert empty.size == 0 and empty.docs.count() == 0
    assert segments.sparse_topk(spark.createDataFrame([("q", "alpha")], "question_id string, text string"), empty).count() == 0
    assert segments.sparse_topk(spark.createDataFrame([], "question_id string, text string"), ix).count() == 0


def test_a_batch_of_log_rows_counts_once(spark, tmp_path):
    from skarn.operators.logs import SCHEMA as LOG

    path = str(tmp_path / "log")
    frame = lambda i: spark.createDataFrame([], LOG).unionByName(spark.range(i, i + 3).select(F.timestamp_seconds(1_700_000_000 + F.col("id") * 2_000_000).cast("timestamp_ntz").alias("time")), allowMissingColumns=True)
    assert files.append_log(frame(0), path, "a") and not files.append_log(frame(0), path, "a")
    # A writer that dies before its marker stands: its rows are there, and do not count.
    frame(0).withColumns({"month": F.date_format("time", "yyyy-MM"), "_attempt": F.lit("dead")}).write.mode("append").partitionBy("month").json(path)
    assert files.read_log(spark, path).count() == 3
    assert files.append_log(frame(3), path) and files.read_log(spark, path).count() == 6


def test_texts_are_moved_once(spark, tmp_path):
    """What a new segment shuffles stays below the size of its texts and keys, however many tables it writes."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 5000, 200))) for i in range(2000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    moved = lambda: spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = moved()
    ix = segments.write(d, str(tmp_path / "ix"))
    assert moved() - before < 1.5 * sum(len(t) for _, t in rows) and ix.size == 2000 and ix.docs.count() == 2000


def test_hits_are_known_to_be_few(spark, tmp_path):
    d = docs(spark)
    hits = segments.sparse_topk(asked(spark), segments.write(d, str(tmp_path / "ix")), 5)
    assert int(str(hits._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1_000_000
    assert hits.count() > 0


def test_postings_are_never_broadcast(spark, tmp_path):
    """Spark takes a list for one row, so postings of any number look small to it."""
    from skarn.plans.engine_queries import segmented_index

    for df in (segmented_index(spark, DATA), segments.write(docs(spark), str(tmp_path / "ix")).postings):
        above, exploded = [], False
        for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
            at = len(line) - len(line.lstrip(" :+-"))
            above = [x for x in above if x[0] < at] + [(at, line[at:])]
            if "Generate explode" in line:
                exploded = True
                assert not any("Broadcast" in x and "Exchange" in x for _, x in above)
        assert exploded and df.count() > 0


def test_weights_are_those_of_decimals(spark, tmp_path):
    """Three times in 2,596 words a weight is 0.15625 less a hair in SQL, where tf * 2.2 is a decimal; in doubles it is a half."""
    d = spark.createDataFrame([(1, "once " * 3 + "other " * 2593)], "doc_id long, text string")
    want = duckdb.sql("select round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * 2596 / 60.0)), 4) from (select 3::bigint as tf)").fetchall()[0][0]
    stored = segments.write(d, str(tmp_path / "ix")).postings.select("term", "weight")
    for found in (stored, search.weights(search.postings(d)).select("term", "weight")):
        assert {r["term"]: r["weight"] for r in found.collect()}["once"] == want == 0.1562
