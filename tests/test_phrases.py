"""Phrases and windows from positions, against the texts themselves."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from skarn.functions.text import contains_phrase
from skarn.operators import phrases, segments


def test_phrases_against_every_text(spark, tmp_path, monkeypatch):
    r = random.Random(7)
    parts = ["the", "leave", "is", "20", "20.5", "days", "İstanbul", "don't", "IŞIK", "*bold*", "wo*rd", "a-b", "x/y", "`code`", ",", ".", "’s", "—", "days", "20"]
    text = lambda n: "".join(r.choice(parts) + r.choice((" ", " ", "  ", "\n", "", ", ")) for _ in range(n))
    rows = [(i, text(r.randint(0, 25))) for i in range(150)] + [(900, None), (901, "")]
    sought = []
    for i in range(200):
        t = r.choice(rows[:150])[1]
        a = r.randint(0, max(len(t) - 1, 0))
        sought.append((i, t[a : a + r.randint(1, 25)]))
    sought += [(500, ""), (501, None), (502, " . "), (503, "da"), (504, "no such thing"), (505, "20"), (506, "20 days"), (507, "—")]
    ix = segments.write(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "ix"))
    asked = spark.createDataFrame(sought, "phrase_id int, phrase string")
    texts = ix.docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    want = sorted(map(tuple, asked.crossJoin(texts).where(contains_phrase(F.col("text"), F.col("phrase"))).select("phrase_id", "doc_id").collect()))
    assert len(want) > 300
    assert sorted(map(tuple, phrases.holding(ix, asked).collect())) == want
    assert phrases.candidates(ix, spark.createDataFrame([(1, "leave, 20 days x")], "phrase_id int, phrase string")).count() < 40
    monkeypatch.setattr(segments, "PUSHED", 0)
    assert sorted((a, b) for a, b, _ in phrases.holding(ix, asked, "text").collect()) == want


def test_positions_settle_open_words(spark, tmp_path):
    rows = [(i, "leave early" if i % 3 else "leaves, leave-taking and 3.20 days") for i in range(60)]
    ix = segments.write(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "ix"))
    asked = spark.createDataFrame([(1, "lea"), (2, "leave ea"), (3, "20"), (4, "leave tak"), (5, "zz")], "phrase_id int, phrase string")
    found = phrases.candidates(ix, asked).groupBy("phrase_id", "sure").count().collect()
    # The open word after the first one narrows the texts; a lone one settles them, unless it is a number.
    assert sorted(map(tuple, found)) == [(1, True, 60), (2, False, 40), (3, False, 20), (4, False, 20)]
    assert sorted((r[0], r[1]) for r in phrases.holding(ix, asked).groupBy("phrase_id").count().collect()) == [(1, 60), (2, 40)]


def test_windows_against_all_choices():
    r = random.Random(8)
    for _ in range(300):
        lists = [sorted(r.sample(range(25), r.randint(1, 4))) for _ in range(r.randint(1, 4))]
        every = list(itertools.product(*lists))
        some = [max(c) - min(c) + 1 for c in every]
        right = [c[-1] - c[0] + 1 for c in every if all(a < b for a, b in itertools.pairwise(c))]
        arrays = [np.array(x) for x in lists]
        assert phrases.window(arrays) == min(some) and phrases.window(arrays, True) == min(right, default=0)
    assert phrases.window([]) == 0


def test_proximity_of_hits(spark, tmp_path):
    rows = [(1, "annual leave is twenty days"), (2, "leave early. It is annual"), (3, "nothing here"), (4, "days annual x x x leave annual")]
    ix = segments.write(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "ix"))
    asked = spark.createDataFrame([("q", "annual leave"), ("r", "")], "question_id string, text string")
    hits = spark.createDataFrame([("q", i) for i in range(1, 5)] + [("r", 1)], "question_id string, doc_id long")
    got = {(x["question_id"], x["doc_id"]): (x["words"], x["held"], x["window"], x["in_order"]) for x in phrases.proximity(ix, asked, hits).collect()}
    assert got == {("q", 1): (2, 2, 2, 2), ("q", 2): (2, 2, 5, 0), ("q", 3): (2, 0, 0, 0), ("q", 4): (2, 2, 2, 5), ("r", 1): (0, 0, 0, 0)}
