"""Long repetitive texts: bounded time and memory, and the results of a plain walk."""

import random
import resource
import time

import numpy as np
import pytest

from skarn.llm import decontaminate

R = random.Random(3)
WORDS = [f"w{i}" for i in range(8)]


def text(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def plain_verified(doc, item, shifts, cfg):
    """All diagonals one by one."""
    hit = np.zeros(len(item), bool)
    for s in shifts.tolist():
        lo, hi = max(0, -s), min(len(item), len(doc) - s)
        for a, b in decontaminate.stretches(doc[lo + s : hi + s] == item[lo:hi], min(cfg.stretch, len(item)), cfg.identity):
            hit[lo + a : lo + b] = True
    return int(hit.sum())


def test_diagonals_one_by_one():
    cfg = decontaminate.SeedConfig()
    for _ in range(150):
        doc, item = ([R.randrange(3) for _ in range(R.randint(1, 60))] for _ in range(2))
        doc, item = np.array(doc, np.uint64), np.array(item, np.uint64)
        shifts = np.array(sorted(R.sample(range(-len(item) + 1, len(doc)), R.randint(1, len(item) + len(doc) - 1))))
        assert decontaminate.verified(doc, item, shifts, cfg) == plain_verified(doc, item, shifts, cfg)


@pytest.mark.parametrize("item", ["la " * 200, "la " * 100 + text(100), "la lo " * 100, "la la lo " * 70])
def test_a_megabyte_of_one_phrase(item):
    index = decontaminate.SeedIndex([(1, item)], decontaminate.SeedConfig())
    began, before = time.monotonic(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for doc in ("la " * 333_000, "la lo " * 166_000, "la la lo " * 111_000):
        decontaminate.leaks([doc.encode()], index, decontaminate.SeedConfig())
    assert time.monotonic() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
    assert decontaminate.leaks([("x " * 1000 + item).encode()], index, decontaminate.SeedConfig()) == [[(0, len(item.split()))]]


def test_blocks_give_the_same(spark):
    docs = spark.createDataFrame([(i, text(20) + " " + t) for i, t in enumerate(["", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "a b c d e f g h i j k l m n o p q"])], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (8, "a b c d e f g h i j k l m n o p q"), (9, None)], "item_id long, text string")
    rows = [sorted((r["doc_id"], [x["item_id"] for x in r["leaks"]]) for r in decontaminate.marked(docs, bench, cfg).collect()) for cfg in (None, decontaminate.SeedConfig(block_bytes=40))]
    assert rows[0] == rows[1] == [(0, []), (1, [7]), (2, [8])]


# --- personal data


def test_features_of_many_proposals_at_once():
    from skarn.llm import pii

    parts = [*"0123456789" * 4, *"  ()./:-+@#$€,%abİdotTelKΣ\n", "tel ", "order ", "(at)", " dot ", "192.168.", "+49 ", "call "]
    texts = ["".join(R.choice(parts) for _ in range(R.randint(0, 80))) for _ in range(800)] + [t for t, _, _ in pii.examples(300, 9)]
    n = 0
    for t in texts:
        numbers = pii.Numbers(t)
        found = numbers.proposals(0, len(numbers.begin))
        halves = [numbers.proposals(a, a + 3) for a in range(0, len(numbers.begin), 3)]
        assert sorted(zip(*(x.tolist() for x in found), strict=True)) == sorted(r for h in halves for r in zip(*(x.tolist() for x in h), strict=True))
        if len(found[0]):
            n += len(found[0])
            assert np.array_equal(numbers.features(*found), np.array([pii.describe(t, (a, b, pii.KINDS[k])) for a, b, k in zip(*found, strict=True)]))
    assert n > 1000


def test_proposals_against_all_stretches():
    from skarn.llm import pii

    for _ in range(300):
        t = "".join(R.choice("0123456789 .-(+x:") for _ in range(R.randint(0, 50)))
        want = set()
        for i in range(len(t)):
            for j in range(i + 7, min(len(t), i + 42) + 1):
                s, digits = t[i:j], sum(c.isdigit() for c in t[i:j])
                whole = s[0].isdigit() and s[-1].isdigit() and not t[:i][-1:].isdigit() and not t[j:][:1].isdigit()
                if not whole or any(c not in "0123456789 ().:/-" for c in s):
                    continue
                lead = i - (t[:i][-1:] == "(")
                lead -= t[:lead][-1:] == "+"
                want |= {(lead, j, "phone")} if 7 <= digits <= 15 else set()
                want |= {(i, j, "card")} if 13 <= digits <= 19 else set()
                want |= {(i, j, "ip")} if s.count(".") == 3 and 4 <= digits <= 12 else set()
        assert {c for c in pii.candidates(t) if c not in pii.others(t)} == want


@pytest.mark.parametrize("unit", ["1 ", "7:", "ab", "+1 2-3", "4111111111111111 "])
def test_a_megabyte_of_numbers(unit):
    from skarn.llm import pii

    trees, text = pii.model(), unit * (1_000_000 // len(unit))
    began, before = time.monotonic(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    pii.find(text, trees)
    assert time.monotonic() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
    assert pii.find(text[:200] + " mail a@b.org", trees)[0][-1][2] == "email"
