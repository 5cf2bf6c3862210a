"""Column functions against fixed cases."""

import pytest
from pyspark.sql import functions as F

from skarn.functions import citations as C
from skarn.functions import text as T


def value(spark, make, *args):
    names = [f"x{i}" for i in range(len(args))]
    df = spark.createDataFrame([tuple(args)], ", ".join(f"{n} {'int' if isinstance(a, int) else 'double' if isinstance(a, float) else 'string'}" for n, a in zip(names, args, strict=True)))
    return df.select(make(*map(F.col, names)).alias("v")).first().v


@pytest.mark.parametrize(
    "text, has, lacks",
    [
        ("VPN-ERR-204", {"vpnerr204", "vpn", "err", "204"}, set()),
        ("VPN-ERR204", {"vpnerr204", "vpn", "err", "204"}, set()),
        ("vpn err 204", {"vpn", "err", "204"}, {"vpnerr204"}),
        ("Murat Kaya'nın", {"murat", "kaya"}, {"nin", "nın"}),
        ("Murat Kayaalp", {"murat", "kayaa"}, {"kaya"}),
        ("180.000 TL", {"180000", "tl"}, {"000", "180"}),
        ("a 7 b", {"7"}, {"a", "b"}),
    ],
)
def test_search_tokens(spark, text, has, lacks):
    found = set(value(spark, T.search_tokens, text))
    assert has <= found and not lacks & found


def test_spellings_meet(spark):
    forms = [value(spark, T.search_tokens, t) for t in ("Yöneticilere", "yöneticiler", "YÖNETİCİ")]
    assert forms[0] == forms[1] == forms[2]
    assert value(spark, T.search_tokens, "musteri listesi") == value(spark, T.search_tokens, "Müşteri Listesi")


@pytest.mark.parametrize(
    "text, phrase, yes",
    [("22 gündür", "22 gün", True), ("M-1011", "11", False), ("01.11.2024", "11", False), ("Saat 11 olur", "11", True), ("**Kalın** `kod`", "kalın kod", True), ("İzin I", "izin ı", True), ("a.b", ".b", True), ("x \\E y", "\\E", True), ("aşkın", "kın", False)],
)
def test_contains_phrase(spark, text, phrase, yes):
    assert value(spark, T.contains_phrase, text, phrase) is yes


@pytest.mark.parametrize("x, decimals, said", [(1234.5, 2, "1.234,50"), (-50000.0, 0, "-50.000")])
def test_grouped_number(spark, x, decimals, said):
    assert value(spark, lambda c: T.grouped_number(c, decimals), x) == said


def test_small_functions(spark):
    assert value(spark, T.percent, 0.15) == "%15"
    assert value(spark, lambda c: T.percent(c, 1), 0.085) == "%8,5"
    assert value(spark, T.round_down, 0.0347) == pytest.approx(0.03)
    assert value(spark, T.sigmoid, 0.0) == 0.5
    assert value(spark, T.line_key, "  Page 12 of 30 ") == "page # of #"
    assert value(spark, T.is_page_number, "Sayfa 3 / 10") is True
    assert value(spark, T.is_page_number, "page three") is False
    assert value(spark, T.chunk_content, "[a > b]\ntext\nmore") == "text\nmore"


@pytest.mark.parametrize("raw, clean", [("<think>x</think>Answer", "Answer"), ("a <THINK>b\nc</THINK> d", "a  d"), ("Answer <think>open", "Answer"), ("plain", "plain")])
def test_without_thoughts(spark, raw, clean):
    assert value(spark, T.without_thoughts, raw) == clean


def test_rewritten(spark):
    assert value(spark, T.rewritten, "\n Question: \"What now?\"\nmore", "q") == "What now?"
    assert value(spark, T.rewritten, "   ", "old question") == "old question"
    assert value(spark, T.rewritten, "x" * 300, "q") == "q"


def test_verdict(spark):
    assert tuple(value(spark, T.verdict, '```json\n{"verdict": " Correct ", "reason": "fine"}\n```')) == ("correct", "fine")
    assert value(spark, T.verdict, '{"verdict": "maybe"}') is None
    assert value(spark, T.verdict, "no braces") is None


@pytest.mark.parametrize(
    "text, numbers, invalid, lost",
    [
        ("a [2] b [1][3]", [2, 1, 3], [], False),
        ("[1, 3] [1-3] [9]", [1, 3, 2], [9], False),
        ("[2–4]", [2, 3, 4], [], False),
        ("[1-2000] [3-1]", [1, 3], [2000], False),
        ("none [NOT FOUND]", [], [], True),
        ("[0] [x]", [], [0], False),
    ],
)
def test_citations(spark, text, numbers, invalid, lost):
    c = value(spark, lambda t: C.citations(t, F.lit(5)), text)
    assert (c.numbers, c.invalid, c.not_found) == (numbers, invalid, lost)


def test_facts(spark):
    assert set(value(spark, lambda t: C.fact_keys(t, True), "VPN-ERR-301 on 31.08.2028 at 08:00")) >= {"code:vpnerr301", "301", "31", "8", "2028", "800", "31082028"}
    assert value(spark, C.fact_keys, "08:00-20:00 and 0,5") == ["800", "2000", "5"]


def test_unverified_needs_a_citation(spark):
    row = spark.createDataFrame([("99 [1]. And 98.", "q", ["has 98"]), ("99.", "q", ["x"]), ("99 [1]", "99?", ["x"]), ("99 [1]", "q", [])], "a string, q string, s array<string>")
    found = [[(u.fact, u.cited) for u in r.u] for r in row.select(C.unverified(F.col("a"), F.col("s"), F.col("q")).alias("u")).collect()]
    assert found == [[("99", [1])], [], [], []]


def test_excerpts(spark):
    text = "Nothing here. The leave is 20 days! Other.\n| leave | days | many |"
    assert value(spark, C.best_piece, text, "how many days of leave") == "leave | days | many"
    assert value(spark, C.best_piece, "", "x") == ""
    assert value(spark, lambda c: C.shortened(c, 12), "one two  three four") == "one two …"
    assert value(spark, lambda c: C.shortened(c, 40), " one  two ") == "one two"


def test_long_runs_without_a_mark_take_one_pass(spark):
    import time

    began = time.perf_counter()
    text = F.concat(F.repeat(F.lit("ab"), 200_000), F.lit(" x-1"))
    assert spark.range(1).select(C.fact_keys(text).alias("k")).first()["k"] == ["code:x1"]
    assert time.perf_counter() - began < 20


def test_white_space_of_all_kinds(spark):
    texts = [(" a\u2003 b\t", "a b"), ("\u3000x  y", "x y"), ("\n\na \x85 b", "a b"), ("\u200b z", "\u200b z"), ("a\u00a0b", "a b"), ("", ""), ("*a`b*", "ab")]
    rows = spark.createDataFrame(texts, "t string, said string").select(T.normalize(F.col("t")).alias("n"), "said", T.stripped(F.concat(F.lit("\u2009\n"), "said", F.lit(" \r\u1680"))).alias("s")).collect()
    assert all(r.n == r.said and r.s == r.said for r in rows)
