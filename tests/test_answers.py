"""Answering, question sets, users and the command line."""

import pytest
from pyspark.sql import functions as F

from skarn.operators import answer as A
from skarn.operators import catalog
from skarn.sources import config as C

GOOD = '''
not_found_phrases = ["yok"]
[[question]]
id = 1
type = "lookup"
role = "employee"
question = "How many days?"
expected = "20"
sources = ["a.pdf"]
evidence = ["20 days", ["x", "y"]]
[[question]]
id = 2
type = "unanswerable"
role = "intern"
question = "Why?"
expected = "-"
answerable = false
'''


def hits(spark):
    kind = "question_id int, rank int, source string, text string, heading_path string, page_start int, page_end int, access_level string, status string, effective_date date, replaced_by string, ocr boolean"
    rows = [(1, 1, "a.pdf", "[a.pdf > L]\nLeave is 20 days.", "L", 1, 2, "internal", "active", None, None, False), (1, 2, "b.pdf", "[b.pdf]\nOld: 18 days.", "", None, None, "restricted", "superseded", None, "a.pdf", True)]
    return spark.createDataFrame(rows, kind)


def test_prompt_and_answer(spark):
    asked = spark.createDataFrame([(1, "How many days of leave?"), (2, "Why?")], "question_id int, question string")
    got = {r.question_id: r for r in A.answered(A.with_sources(asked, hits(spark))).collect()}
    assert got[1].prompt == "Sources:\n\n[1] a.pdf > L (p. 1-2)\nLeave is 20 days.\n\n[2] b.pdf (SUPERSEDED by a.pdf, read by OCR, may hold errors)\nOld: 18 days.\n\nQuestion: How many days of leave?"
    assert (got[1].answer, got[1].route, got[1].citations.numbers, got[1].unverified) == ("Leave is 20 days. [1]", "local", [1], [])
    assert (got[2].answer, got[2].prompt, got[2].route) == (None, None, "none")


def test_wrong_numbers_are_reported(spark):
    asked = A.with_sources(spark.createDataFrame([(1, "How many?")], "question_id int, question string"), hits(spark))
    (r,) = A.answered(asked, lambda q, s: F.lit("It is 18 days [1].")).collect()
    assert [(u.fact, u.cited, u.found_in) for u in r.unverified] == [("18", [1], [2])]


def test_standalone(spark):
    turns = spark.createDataFrame([(["a?", "b?"], "and then?"), ([], "first?")], "history array<string>, question string")
    assert [r.searched_as for r in A.standalone(turns, lambda p: F.concat(F.lit("Question: "), F.upper(F.substring_index(p, "\n\n", -1)))).collect()] == ["AND THEN?", "first?"]
    assert A.standalone(turns, lambda p: F.lit("")).first().searched_as == "and then?"


def test_fallback():
    def fails(_):
        raise A.Unavailable("busy")

    def rejects(_):
        raise ValueError("bad request")

    one, two, home = A.Provider("one", fails), A.Provider("two", lambda m: " ok "), A.Provider("home", lambda m: "local", True)
    assert A.generate([], [one, two]) == A.Reply("ok", "two", ("one: busy",))
    assert A.generate([], [A.Provider("empty", lambda m: "  "), two]).provider == "two"
    assert A.generate([], [two, home], local_only=True).provider == "home"
    with pytest.raises(A.NoProvider):
        A.generate([], [two], local_only=True)
    with pytest.raises(ValueError):
        A.generate([], [A.Provider("r", rejects), two])
    waits, calls = [], iter([A.Unavailable(), A.Unavailable(), "done"])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert A.with_retries(call, sleep=waits.append) == "done" and waits == [1.0, 2.0]
    with pytest.raises(A.Unavailable):
        A.with_retries(lambda: fails(None), sleep=waits.append)


def test_question_set(spark):
    q = C.questions(spark, GOOD)
    rows = {r.question_id: r for r in q.collect()}
    assert rows[1].evidence == [["20 days"], ["x", "y"]] and rows[2].any_of == ["yok"] and rows[1].any_of == []
    chunks = spark.createDataFrame([("a.pdf", "It is 20 DAYS")], "source string, text string")
    assert {(r.question_id, r.problem, r.blocking) for r in C.against_index(q, chunks).collect()} == {(1, "no chunk holds x / y", True)}
    assert {r.problem for r in C.against_index(q, chunks.where("false")).collect()} == {"a.pdf is not indexed", "no chunk holds 20 days", "no chunk holds x / y"}


@pytest.mark.parametrize(
    "old, new",
    [("id = 2", "id = 1"), ("id = 1", 'id = "1"'), ('role = "intern"', 'role = "boss"'), ("answerable = false", 'answerable = "no"'), ('sources = ["a.pdf"]', ""), ("answerable = false", "answerable = false\nsources = ['a']"),
     ("answerable = false", "off_topic = true\nsources = ['a']"), ('expected = "-"', 'expected = " "'), ('expected = "-"', ""), ("evidence =", "evidense ="), ('["x", "y"]', "[]"), ("[[question]]", "[question]"), ('not_found_phrases = ["yok"]', "not_found = 1")],
)
def test_broken_question_sets(spark, old, new):
    with pytest.raises(C.ConfigError):
        C.questions(spark, GOOD.replace(old, new, 1) if old != "[[question]]" else GOOD.replace(old, new))


def test_users(tmp_path):
    path = str(tmp_path / "users.toml")
    assert C.load_users(path) == {}
    users = {n: {"username": n, "name": "Ünal", "role": r, "password": C.hash_password("long enough")} for n, r in (("ann", "hr_admin"), ("bob", "employee"))}
    C.save_users(users, path)
    assert C.load_users(path) == users
    assert C.authenticated(path, " ANN ", "long enough")["name"] == "Ünal"
    assert C.authenticated(path, "ann", "wrong password") is None and C.authenticated(path, "eve", "long enough") is None
    assert C.admins_left(users, "ann") == 0 and C.admins_left(users, "bob") == 1
    with pytest.raises(C.ConfigError):
        C.hash_password("short")
    (tmp_path / "users.toml").write_text('[[user]]\nusername = "x"\n')
    with pytest.raises(C.ConfigError):
        C.load_users(path)


def test_catalog_file(spark, tmp_path):
    path = tmp_path / "catalog.toml"
    path.write_text(catalog.entry_text("a.pdf", "internal"))
    C.add_catalog_entry(spark, str(path), catalog.entry_text("b.pdf", "restricted"))
    before = path.read_text()
    with pytest.raises(catalog.CatalogError):
        C.add_catalog_entry(spark, str(path), catalog.entry_text("b.pdf", "internal"))
    assert path.read_text() == before and "b.pdf" in before


def test_command_line(capsys):
    from skarn.__main__ import main

    main(["list"])
    assert "bm25_topk" in capsys.readouterr().out.split()
