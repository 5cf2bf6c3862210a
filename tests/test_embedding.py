"""The learned embedder against numpy's decomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.operators import embedding, segments
from skarn.runtime import written


@pytest.fixture(scope="module")
def learned(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("lsa")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    ix = segments.write(docs, str(path / "ix"))
    return ix, embedding.learn(ix, str(path / "model"), size=48, passes=4)


def dense(ix):
    rows = ix.postings.join(ix.rarity.select("term", "idf"), "term").select("doc_id", "term", (F.col("idf") * F.col("weight")).alias("v")).collect()
    docs, terms = ({x: i for i, x in enumerate(sorted({r[k] for r in rows}))} for k in ("doc_id", "term"))
    a = np.zeros((len(docs), len(terms)))
    for r in rows:
        a[docs[r["doc_id"]], terms[r["term"]]] = r["v"]
    return a, docs, terms


def test_singular_values_and_vectors(spark, learned):
    ix, model = learned
    a, docs, terms = dense(ix)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(model.values[:12], s[:12], rtol=5e-3) and (np.diff(model.values) <= 1e-9).all()
    v = np.zeros((len(terms), 48))
    for r in model.words.collect():
        v[terms[r["term"]]] = r["v"]
    assert np.allclose(v.T @ v, np.eye(48), atol=1e-6)
    # The leading directions are numpy's, up to sign and turns among close values.
    assert np.linalg.norm(vt[:6] @ v[:, :12]) ** 2 > 5.9
    x = a @ v
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for r in model.documents.collect():
        assert np.allclose(r["embedding"], x[docs[r["doc_id"]]], atol=1e-9)


def test_questions_are_folded_in(spark, learned):
    ix, model = learned
    a, _, terms = dense(ix)
    some = list(terms)[:2]
    asked = spark.createDataFrame([(1, " ".join(some)), (2, "qqqqq")], "question_id int, text string")
    got = {r["question_id"]: r["vector"] for r in model.questions(asked).collect()}
    assert got[2] is None and np.isclose(np.linalg.norm(got[1]), 1)
    for blank in ("", "  ", None):
        with pytest.raises(ValueError, match="blank"):
            model.questions(spark.createDataFrame([(1, blank)], "question_id int, text string"))


def test_deleted_documents_have_no_vector(spark, tmp_path):
    path = str(tmp_path / "ix")
    ix = segments.write(spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, "")], "doc_id long, text string"), path)
    ix = segments.add(spark, path, spark.createDataFrame([(4, "gamma delta")], "doc_id long, text string"), ix.docs.where("doc_id = 1").select("shard", "place"))
    model = embedding.learn(ix, str(tmp_path / "model"), size=3, passes=2)
    assert {r["doc_id"] for r in model.documents.collect()} == {2, 4}


def test_postings_are_not_shuffled_by_passes(spark, learned):
    # A group of shards reads its own bucket; only the words' vectors are exchanged.
    ix, _ = learned
    with embedding._by_group(ix, 2) as post:
        words = ix.rarity.select("term", "idf").limit(5)
        plan = embedding._times(post, written(post.select("grp", "term").distinct(), "pairs"), words, 8)._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.index("FlatMapCoGroupsInArrow") :].split("Exchange")[0]
        assert "skarn_weights" in below and "Bucketed: true" in below
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("skarn_weights")]
