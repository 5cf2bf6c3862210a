"""Spot signatures against a plain walk over the words."""

import hashlib
import random
import re

import pytest

from skarn.llm import spots

CFG = spots.SpotConfig()
ANCHORS = {w for line in spots.COMMON for w in line.split()}


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def plain(text, anchors=ANCHORS, chain=2):
    """The set of signatures, as tuples of words."""
    w = [x for x in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower(text or "")) if x]
    out = set()
    for i, x in enumerate(w):
        if x in anchors:
            after = [y for y in w[i + 1 :] if y not in anchors][:chain]
            if after:
                out.add((x, *after))
    return out or ({tuple(w[: chain + 1])} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def texts(n, seed=1):
    r = random.Random(seed)
    words = ["the", "of", "der", "la", *(f"w{i}" for i in range(30))]
    out = []
    for _ in range(n):
        if out and r.random() < 0.5:
            t = r.choice(out).split()
            for _ in range(r.choice((0, 1, 3))):
                if t:
                    t[r.randrange(len(t))] = r.choice(words)
            out.append(" ".join(t))
        else:
            out.append(" ".join(r.choice(words) + r.choice(("", "", ".", ",")) for _ in range(r.choice((0, 1, 2, 5, 40, 80)))))
    return out


def test_sets_against_a_plain_walk(spark):
    t = [*texts(300), "", "the", "The OF la", "x", "x y z u", "日本語", "the\n\nend", "a" * 100 + " the " + "b" * 100, *(r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect())]
    found = spots.Spotter(CFG)([x.encode() for x in t])
    want = [plain(x) for x in t]
    assert [len(s) for s in found] == [len(s) for s in want]
    for i in range(0, len(t) - 1):
        assert spots.likeness(found[i], found[i + 1]) == pytest.approx(jaccard(want[i], want[i + 1]))
        assert spots.alike(found[i], found[i + 1], CFG, 3) == (jaccard(want[i], want[i + 1]) >= 0.8)
    assert [len(s) for s in spots.Spotter(spots.SpotConfig(anchors=()))(["a b c d".encode(), b""])] == [1, 0]


@pytest.mark.parametrize("buckets", [1, 5, 40])
def test_compared_with_the_edited_text_and_the_next(spark, buckets):
    t = texts(60, 2)
    rows = [(3 * i, x, 0) for i, x in enumerate(t)] + [(None, "the last of all", 0), (10, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket int").repartition(4)
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    got = {(r["doc_id"], r["n_chars"], r["edited_sha256"]): r for r in spots.compared(docs, buckets=buckets).collect()}
    assert len(got) == len(rows)
    prints = {}
    for (i, own, _), (_, after, _) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        own, after = own or "", after or ""
        half = len(own) // 2
        new = own[: len(own) - half] + after[:half]
        r = got[i, len(own), hashlib.sha256(new.encode()).hexdigest()]
        assert r["near_edited"] == pytest.approx(jaccard(plain(own), plain(new))) and r["near_next"] == pytest.approx(jaccard(plain(own), plain(after)))
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (plain(own) == plain(new)) and r["n_signatures"] == len(plain(own))
        assert prints.setdefault(frozenset(plain(own)), r["fingerprint"]) == r["fingerprint"]


def test_near_copies_against_all_pairs(spark):
    t = texts(150, 3)
    rows = [(i, x, 1) for i, x in enumerate(t)] + [(7000, t[5], 1), (None, None, 1)]
    sets = [plain(x) for _, x, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    distinct = {frozenset(s) for s in sets}
    want = sorted((str(rows[i][0]), str(rows[find(i)][0]), sum(jaccard(sets[i], s) >= 0.8 for s in distinct) - 1) for i in range(len(rows)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    assert sorted((str(r[0]), str(r[1]), r[2]) for r in spots.near_copies(docs).collect()) == want


def test_defined_results(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spots.compared(none).count() == 0 and spots.near_copies(none).count() == 0
    one = spots.compared(spark.createDataFrame([(4, "the cat sat")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
