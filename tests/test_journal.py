"""Paid calls: once a prompt, and paced over all tasks."""

import os
import time

import pytest
from pyspark.sql import functions as F

from skarn.operators import answer as A


def prompts(spark, n, copies=3):
    return spark.range(n * copies).select(F.concat(F.lit("about "), (F.col("id") % n).cast("string")).alias("prompt"), F.lit(False).alias("local_only")).repartition(5)


def counted(folder, fail=None):
    """A provider that leaves a file for each call; it dies, with its task, at one prompt."""

    def call(messages):
        text = messages[0]["content"]
        if text == fail and not os.path.exists(f"{folder}/mended"):
            raise SystemExit("the executor is gone")
        with open(f"{folder}/{text.replace(' ', '-')}-{time.time():.6f}", "w"):
            return text.upper()

    return [A.Provider("cloud", call)]


def calls(folder):
    return sorted(f for f in os.listdir(folder) if f.startswith("about"))


def test_a_prompt_is_paid_for_once(spark, tmp_path):
    book, seen = f"file://{tmp_path}/journal", tmp_path / "calls"
    seen.mkdir()
    with pytest.raises(Exception):  # noqa: B017  the task dies half-way
        A.generated(prompts(spark, 30), counted(str(seen), fail="about 17"), journal=book, lanes=2).collect()
    before = calls(seen)
    assert 0 < len(before) < 30
    (seen / "mended").touch()
    for _ in range(2):
        rows = A.generated(prompts(spark, 30), counted(str(seen), fail="about 17"), journal=book, lanes=2).collect()
        assert len(rows) == 90 and {r["reply"] for r in rows} == {f"ABOUT {i}" for i in range(30)}
    assert len(calls(seen)) == 30 and len({c.rsplit("-", 1)[0] for c in calls(seen)}) == 30


def test_one_rate_over_all_tasks(spark, tmp_path):
    A.generated(prompts(spark, 24), counted(str(tmp_path)), calls_per_second=12, lanes=4).collect()
    at = sorted(float(c.rsplit("-", 1)[1]) for c in calls(tmp_path))
    assert len(at) == 24
    # In no second are there more calls than the rate and one for each lane.
    assert all(sum(t <= x < t + 1 for x in at) <= 12 + 4 for t in at)


def test_all_wait_when_one_is_told_to(tmp_path):
    book = A.Journal(str(tmp_path / "j"))
    book.hold(0.3)
    pace, began = A.Pace(0.0, book), time.time()
    pace.wait()
    assert time.time() - began > 0.25
    book.hold(0.0)
    assert book.get("none") is None


def test_errors_are_asked_again_and_nulls_are_not_sent(spark, tmp_path):
    book = f"file://{tmp_path}/journal"
    rows = spark.createDataFrame([(1, "x", True), (2, None, False), (3, "x", None)], "id int, prompt string, local_only boolean")

    def busy(messages):
        raise A.Unavailable("busy")

    got = {r["id"]: r for r in A.generated(rows, [A.Provider("cloud", busy)], attempts=1, journal=book).collect()}
    assert got[1]["error"] == "NoProvider: no local provider" and "busy" in got[3]["error"] and got[2]["error"] is None and got[2]["passed"] == []
    got = {r["id"]: r for r in A.generated(rows, [A.Provider("cloud", lambda m: "yes")], journal=book).collect()}
    assert got[1]["reply"] is None and got[3]["reply"] == "yes"
