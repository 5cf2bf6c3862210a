"""The vector index against all inner products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.operators import search, vectors


def rows(df, key="vec_id"):
    return sorted((r["question_id"], r["rank"], r[key], r["score"]) for r in df.collect())


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 4
    x = centres[rng.integers(12, size=900)] + rng.normal(size=(900, 16)) * 0.3
    x[:300] = x[0]  # a third of all rows is one vector
    data = [(i, v.tolist(), ("internal", "restricted")[i % 3 == 0], ("active", "superseded")[i % 5 == 0]) for i, v in enumerate(x)]
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, access_level string, status string").repartition(4)


def test_equal_to_all_inner_products(spark, clustered, tmp_path):
    ix = vectors.write(clustered, str(tmp_path / "ix"))
    assert ix.size.sum() == 900 and len(ix.ids) > 5
    asked = clustered.where("vec_id % 17 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    for levels in (None, ("internal",), ("internal", "restricted"), ()):
        seen = clustered if levels is None else search.visible(clustered, levels)
        assert rows(vectors.topk(asked, ix, 20, levels)) == rows(search.dense_topk(asked, seen.select("vec_id", "embedding"), 20))
    assert rows(vectors.topk(asked, ix, 7, block_rows=10)) == rows(search.dense_topk(asked, clustered, 7))
    share = vectors.topk(asked, ix, 5, count=True).agg(F.sum("cells_read") / F.sum("cells")).first()[0]
    assert share < 0.5
    far = spark.createDataFrame([(1, [0.0] * 16), (2, None), (3, [1.0])], "question_id long, vector array<double>")
    assert {r["question_id"] for r in vectors.topk(far, ix, 5).collect()} == {1}


def test_few_rows_and_rows_that_take_no_part(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, []), (None, [1.0, 1.0])]
    ix = vectors.write(spark.createDataFrame(data, "vec_id long, embedding array<double>"), str(tmp_path / "few"))
    asked = spark.createDataFrame([("a", [1.0, 0.0])], "question_id string, vector array<double>")
    assert rows(vectors.topk(asked, ix, 20)) == [("a", 1, 1, 1.0), ("a", 2, 2, 0.5)]
    none = vectors.write(spark.createDataFrame([], "vec_id long, embedding array<double>"), str(tmp_path / "none"))
    assert vectors.topk(asked, none, 20).count() == 0
