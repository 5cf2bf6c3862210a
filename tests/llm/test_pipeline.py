"""The pipeline's stages, each on its own input, against plain versions."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from skarn.llm import pii
from skarn.llm.subwords import subwords
from skarn.runtime import table, written

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, DATA, "documents"), {}
    for name, f in cp.STAGES:
        after = written(f(spark, docs, DATA), name)
        out[name] = (docs, after)
        docs = after
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert dict(after.dtypes) == dict(before.dtypes)


def test_quality_stage(stages):
    before, after = map(rows, stages["quality_classifier"])
    label = dict(duckdb.sql(f"select doc_id, quality from '{DATA}/labels.parquet'").fetchall())
    good, bad = [d for d in before if label.get(d) == 1], [d for d in before if label.get(d) == 0]
    assert sum(d in after for d in good) >= 0.97 * len(good) and sum(d in after for d in bad) <= 0.1 * len(bad)
    assert all(after[d] == before[d] for d in after)


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_duplicate_stage(stages):
    """The documents kept are those of brute force: of each component of links at 0.8 or more, the smallest id."""
    before, after = map(rows, stages["simhash_near_dedup"])
    sets, where, least = {d: shingles(r.text) for d, r in before.items()}, {}, {d: d for d in before}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)

    def root(d):
        while least[d] != d:
            d = least[d]
        return d

    linked = 0
    for d in before:
        for e in {e for x in sets[d] for e in where[x] if e > d}:
            if 5 * len(sets[d] & sets[e]) >= 4 * len(sets[d] | sets[e]):
                linked += 1
                a, b = root(d), root(e)
                least[max(a, b)] = min(a, b)
    assert linked and set(after) == {d for d in before if root(d) == d}


def test_decontamination_stage(stages):
    before, after = map(rows, stages["benchmark_decontamination"])
    items = [t.lower() for (t,) in duckdb.sql(f"select text from '{DATA}/benchmark.parquet'").fetchall()]
    holds = {d for d, r in before.items() if any(t in r.text.lower() for t in items)}
    assert holds and set(before) - set(after) == holds


def test_personal_data_stage(stages):
    before, after = map(rows, stages["pii"])
    assert set(before) == set(after)
    changed = 0
    for d, r in before.items():
        base, added = pii.find(r.text, pii.model())
        assert after[d].text == pii.redacted(r.text, base + added) and after[d].n_chars == len(after[d].text)
        changed += bool(base)
        assert not pii.base_spans(after[d].text)
    assert changed


def test_packing_stage(stages):
    before, after = stages["best_fit_packing"]
    n = {r.doc_id: len(subwords().tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.collect()}
    got = after.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == n
    full = after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= 2048 for r in full) and len(full) <= 1.01 * (-(-sum(n.values()) // 2048)) + 1


def test_run_is_its_stages(spark, stages):
    import __spark_entry__ as e

    assert e.queries()["pipeline"](spark, DATA).count() == stages["best_fit_packing"][1].count()
    assert [n for n, _ in cp.STAGES] == list(stages)


def test_no_column_name_clashes_with_the_stages_own(spark, tmp_path):
    names = ["_row", "_copy", "row", "copy", "c0", "c1", "root", "node", "size", "x", "_t", "leaks", "score"]
    docs = spark.createDataFrame([(i, f"{i} some words of a text that stands here alone " * (i + 1), *range(70, 70 + len(names))) for i in range(4)], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    kept = cp.near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(map(tuple, docs.collect()))
    same = docs.unionByName(docs.withColumn("_row", F.lit(1).cast("long")))
    ones = [sorted(map(tuple, cp.near_duplicates(spark, x, str(tmp_path)).collect())) for x in (same, same.repartition(3))]
    assert len(ones[0]) == 4 and ones[0] == ones[1]


def test_stages_on_awkward_tables(spark, tmp_path):
    """Nulls, empty and repeated rows, clashing names, empty tables: every stage keeps its columns and does not fail."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, score double, leaks string, pii string, root long, row long, hi string, part int, quality string, added_0 long, Added_1 string, _corpus_pipeline_new int"
    extra = (0.5, "l", "p", 1, 2, "h", 3, "q", 4, "a", 5)
    good = "The leave is twenty days and the form is here. " * 8
    rows = [(1, good, "en", "s", 9, *extra), (1, good, "en", "s", 9, *extra), (None, good + "mail a.b@c.de", "en", "s", 9, *extra), (None, None, None, None, None, *extra), (3, "", "en", "s", 0, *extra), (4, "x " * 200000, "en", "s", 0, *extra), (5, "call +1 (555) 123-4567", None, "s", None, *extra)]
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None), (1, ""), (1, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    full = spark.createDataFrame(rows, kind)
    for docs in (full, full.where("false")):
        n = docs.count()
        for name, f in cp.STAGES[:-1]:
            out = written(f(spark, docs, str(tmp_path)), name)
            assert out.dtypes == docs.dtypes and out.count() <= n
            docs = out
        assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()
    kept = written(cp.near_duplicates(spark, full, str(tmp_path)), "kept")
    assert kept.where("doc_id = 1").count() == 1
    clean = {r.text for r in cp.personal_data(spark, full, str(tmp_path)).collect()}
    assert "call <PHONE>" in clean and good + "mail <EMAIL>" in clean and None in clean
