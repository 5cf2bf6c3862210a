"""Alignment of two tokenizers against overlaps found token by token."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from skarn.llm import align

TEXTS = [
    "Plain words, and numbers 1234567 in a row.", "Plain words, and numbers 1234567 in a row.", "zwei  Leerzeichen\n\nund\tTab ", "\nline at once\nand another\r\nend", " leading", "x", "", None,
    "naïve 日本語 İstanbul 🙂🙃 é", "a▁b has the mark", "<|endoftext|> and <s> </s> <0x41> are plain", "nbsp here  wide ᠎ odd ​ zero", "\x00\x01 control \x1c x", " ", "\n", "word " * 50, "don't we'll I'M", "é combined",
]


@pytest.fixture(scope="module")
def pair():
    return align.Pair()


def tokens(pair, text):
    """(ids, bytes) of both tokenizers for the whole text, or none."""
    if not text:
        return None
    a, b = pair.first.encode(" " + text, add_special_tokens=False).ids, pair.second.encode(text)
    x, y = [pair.first_bytes[i] for i in a], [pair.second_bytes[i] for i in b]
    whole = (" " + text).encode()
    return (a, x, b, y) if b"".join(x) == whole == b"".join(y) else None


def plain(pair, texts):
    """Rows by comparing every token with every other one."""
    held = []
    for t in texts:
        found = tokens(pair, t)
        if found is None:
            held.append((0, 0, [], []))
            continue
        a, x, b, y = found
        ea, eb = np.cumsum([0, *map(len, x)]).tolist(), np.cumsum([0, *map(len, y)]).tolist()
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if max(ea[i], eb[j]) < min(ea[i + 1], eb[j + 1])]
        ends = sorted(set(ea[1:]) & set(eb[1:]))
        groups, at = [], 0
        for e in ends:
            groups.append(f"{','.join(str(a[i]) for i in range(len(a)) if at < ea[i + 1] <= e)}|{','.join(str(b[j]) for j in range(len(b)) if at < eb[j + 1] <= e)}")
            at = e
        held.append((len(a), len(b), groups, links))
    count = Counter(p for *_, links in held for p in set(links))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    return [(na, nb, len(g), len(x), sum(count[p] == best[p[0]] for p in x), sum(count[p] for p in x), ";".join(g)) for na, nb, g, x in held]


@pytest.mark.parametrize("cfg", [align.AlignConfig(), align.AlignConfig(chunk_bytes=60, kept_units=5)])
def test_rows_against_all_pairs_of_tokens(spark, pair, cfg):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, chunk string").repartition(3)
    got = sorted(tuple(r) for r in align.links(docs, cfg).collect())
    assert got == [(i, *row) for i, row in enumerate(plain(pair, TEXTS))]
    said = {r["doc_id"]: r["groups"] for r in align.links(docs, cfg, digest=True).collect()}
    assert said == {r[0]: hashlib.sha256(r[-1].encode()).hexdigest() if r[1] else "" for r in got}


def test_units_are_the_whole_texts_ids(spark, pair):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + [t for t in TEXTS if t]
    for t in texts:
        (a, _), (b, _) = pair.encode(pair.units(t))
        assert a.tolist() == pair.first.encode(" " + t, add_special_tokens=False).ids and b.tolist() == pair.second.encode(t)


def test_a_long_text_without_a_cut(pair):
    known = align.Units(pair, 10)
    t = "ab" * 100_000
    rows, pairs, held = align.aligned([t, t], known)
    assert rows[0] == rows[1] and rows[0][0] > 0 and held[:, 2].sum() == 2 * rows[0][3]


def test_defined_results(spark):
    assert align.links(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = align.links(spark.createDataFrame([(None, "same words"), (1, "same words"), (1, "same words"), (2, None)], "doc_id long, text string"), digest=True).collect()
    assert len(rows) == 4 and {r["count_sum"] for r in rows if r["n_a"]} == {3 * rows[0]["n_links"] if rows[0]["n_a"] else 3 * max(r["n_links"] for r in rows)}
    assert [r["groups"] for r in rows if r["doc_id"] == 2] == [""]
