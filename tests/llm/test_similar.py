"""SimHash, suffix-array deduplication and decontamination against brute force."""

import hashlib
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash

from skarn.llm import components, simhash, similar, suffix_dedup, suffixes, words
from skarn.llm import decontaminate as dc

WORDS = "the of and a to in is it on as by for with that this from at be was are".split()


def text(rng, n, extra=200):
    return " ".join(rng.choice(WORDS) if rng.random() < 0.4 else f"w{rng.randrange(extra)}" for _ in range(n))


def edited(rng, t, share):
    return " ".join(f"x{rng.randrange(9999)}" if rng.random() < share else w for w in t.split(" "))


# --- words


def test_word_hashes_depend_on_the_word_alone():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \t\n\x0bÉ.") for _ in range(rng.randrange(40))).encode() for _ in range(300)] + [b"", b" ", b"a" * 50]
    seen = {}
    for size in (16, 1 << 21):
        words.PIECE, before = size, words.PIECE
        try:
            found = [[] for _ in texts]
            for buf, at, which in words.pieces(texts, size):
                low = words.LOWER[buf]
                s, e = words.split(low)
                first = np.append(np.searchsorted(s, at), len(s))
                h = words.hashes(low, s, e)
                for k, i in enumerate(which):
                    found[i] += h[first[k] : first[k + 1]].tolist()
        finally:
            words.PIECE = before
        for t, hs in zip(texts, found, strict=True):
            ws = t.lower().split()
            assert len(ws) == len(hs)
            for w, h in zip(ws, hs, strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


# --- components


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(5, 5), (7, None), (-3, 9), (9, -3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- SimHash


def plain_fingerprint(t):
    ws = t.encode().lower().split()
    if not ws:
        return 0
    k = min(4, len(ws))
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + k]), 42) for i in range(len(ws) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("masks", [simhash.exact_masks(64, 4), simhash.exact_masks(64, 4, 5), simhash.exact_masks(128, 3, 7)])
def test_exact_masks_never_miss(masks):
    rng, bits = random.Random(3), 128 if max(masks) >> 64 else 64
    assert all(any(not d & m for m in masks) for _ in range(2000) for d in [sum(1 << b for b in rng.sample(range(bits), 3 if bits == 128 else 4))])


def test_bk_tree_finds_all():
    rng = random.Random(4)
    base = [rng.getrandbits(16) for _ in range(300)]
    tree = simhash.BKTree()
    for x in dict.fromkeys(base):
        tree.add(x)
    for q in base[:50]:
        assert set(tree.within(q, 3)) == {x for x in base if (x ^ q).bit_count() <= 3}


def documents(rng):
    base = [text(rng, rng.randrange(1, 120)) for _ in range(120)]
    return [(i, t) for i, t in enumerate(base + [edited(rng, t, 0.01) for t in base[:60]] + base[:30] + ["", "  ", "A\tb", "a b", "long " * 5000])] + [(500, None), (500, None), (None, base[0]), (None, "alone " * 3)]


@pytest.mark.parametrize("nodes", [20_000, 3])
def test_simhash_groups(spark, nodes):
    rows = documents(random.Random(5))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lo string").drop("lo")
    got = simhash.duplicate_groups(df, simhash.SimHashConfig(tree_nodes=nodes)).collect()
    prints = [plain_fingerprint(t or "") for _, t in rows]
    group = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            a, b = group[i], group[j]
            group = [min(a, b) if g in (a, b) else g for g in group]
    least = {g: min((d for (d, _), h in zip(rows, group, strict=True) if h == g and d is not None), default=None) for g in group}
    want = Counter((d, p, least[g]) for (d, _), p, g in zip(rows, prints, group, strict=True))
    assert Counter((r.doc_id, r.lo % (1 << 64), r.component_id) for r in got) == want


def test_near_copies_keep_one(spark):
    rng = random.Random(6)
    base = [text(rng, 200, 5000) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, edited(rng, t, 0.01)) for i, t in enumerate(base[:20])] + [(200 + i, t) for i, t in enumerate(base[:5])] + [(7, base[7])]
    kept = sorted(r.doc_id for r in simhash.one_of_each(spark.createDataFrame([(*r, "src", 1) for r in rows], "doc_id long, text string, root string, n int")).collect())
    assert kept == list(range(40))


def tail_replaced(rng, n):
    """A text of 90 shingles, and one that shares all but the last n of them: their similarity is (90 - n) / (90 + n)."""
    ws = [f"u{rng.randrange(10**9)}" for _ in range(94)]
    return " ".join(ws), " ".join(ws[: 94 - n] + [f"v{rng.randrange(10**9)}" for _ in range(n)])


def test_near_copies_below_the_similarity_stay(spark):
    rng = random.Random(10)
    rows = []
    for i in range(60):
        a, b = tail_replaced(rng, 11 + i % 3)
        rows += [(i, a), (100 + i, b)]
    kept = sorted(r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == sorted(i for i, _ in rows)


def test_pairs_at_the_similarity_meet_at_any_row_count(spark):
    rng = random.Random(12)
    pairs = [tail_replaced(rng, 10) for _ in range(150)]
    for others in (0, 1500):
        rows = [(i + k * 1000, t) for i, p in enumerate(pairs) for k, t in enumerate(p)] + [(5000 + i, text(rng, 40, 10**6)) for i in range(others)]
        kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert kept == {i for i, _ in rows if not 1000 <= i < 5000}


def test_groups_equal_brute_force(spark):
    rng = random.Random(11)
    base = [text(rng, rng.randrange(1, 90), 300) for _ in range(60)]
    rows = list(enumerate(base + [edited(rng, t, rng.choice([0.01, 0.03, 0.05])) for t in base * 2] + [edited(rng, base[0] + " " + base[1], 0.02) for _ in range(60)] + ["a b c", "A  b\tc", "", " "]))
    sets = [frozenset(tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4:
            a, b = group[i], group[j]
            group = [min(a, b) if g in (a, b) else g for g in group]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (20, 1):
        got = similar.groups(df.selectExpr("doc_id", "doc_id as row", "text"), similar.SimilarConfig(count_bits=bits)).collect()
        least = {}
        for r in sorted(got):
            least.setdefault(r.root, r.doc_id)
        assert {r.doc_id: least[r.root] for r in got} == dict(enumerate(group))


def test_the_choice_of_repeated_rows_goes_by_maps_too(spark):
    """Rows that differ in nothing but a map or a variant: the same one stays however they lie."""
    for made in ("map('a', timestamp_micros(id))", "parse_json(concat('{\"a\": ', id, '}'))"):
        both = (ids.selectExpr("1L as doc_id", "'a text of some words that stands here' as text", f"{made} as c") for ids in (spark.range(0, 24, 1, 1), spark.range(23, -1, -1, 1)))
        ones = [[r.c for r in simhash.one_of_each(x).selectExpr("cast(c as string) as c").collect()] for x in both]
        assert len(ones[0]) == 1 and ones[0] == ones[1]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.duplicate_groups(df).count() == 0 and simhash.one_of_each(df).count() == 0
    assert suffix_dedup.deduplicated(df).count() == 0
    assert dc.marked(df, spark.createDataFrame([], "item_id long, text string")).count() == 0


# --- suffix arrays


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_suffix_array(letters):
    rng = np.random.default_rng(letters)
    for n in (0, 1, 2, 3, 30, 200):
        x = rng.integers(97, 97 + letters, n).astype(np.uint8)
        b = x.tobytes()
        assert suffixes.suffix_array(x, 256).tolist() == sorted(range(n), key=lambda i: b[i:])


def test_types():
    b = b"mississippi"
    assert suffixes.smaller_than_next(np.frombuffer(b, np.uint8)).tolist() == [b[i:] < b[i + 1 :] for i in range(len(b))]


def brute(rows, length):
    data = [(d, (t or "").encode()) for d, t in rows]
    times = Counter(t[i : i + length] for _, t in data for i in range(len(t) - length + 1))
    out = []
    for d, t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if times[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup(spark, hot):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(80)))) for i in range(60)] + [(60, "a" * 300), (61, None), (62, "ab" * 100), (62, "ab" * 100), (63, "\0" * 50), (None, "ü" * 40), (64, "ab")]
    cfg = suffix_dedup.DedupConfig(length=12, gram=4, array_bytes=2000, chunk=37, hot=hot)
    got = suffix_dedup.deduplicated(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, uid int"), cfg).collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows, 12))


def test_a_run_of_one_byte_is_few_rows():
    rows = [x for x in suffix_dedup._segments(b"a" * 5_000_000, suffix_dedup.DedupConfig())]
    assert sum(len(x[0]) for x in rows) < 20 and sum(int(x[7].sum()) for x in rows) == 5_000_000 - 199


def test_a_passage_in_many_surroundings(spark):
    rng = random.Random(9)
    passage = text(rng, 60, 10**6)
    rows = [(i, f"{rng.random()} {passage} {rng.random()}" if i % 2 else text(rng, 60, 10**6)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (4096, 20):
        got = suffix_dedup.deduplicated(df, suffix_dedup.DedupConfig(hot=hot)).collect()
        assert Counter(map(tuple, got)) == Counter(brute(rows, 200))


def test_suffix_dedup_of_passages(spark):
    rng = random.Random(8)
    passage = text(rng, 80)
    rows = [(i, f"{text(rng, 60)} {passage if i % 3 == 0 else ''} {text(rng, 20)}") for i in range(40)] + [(99, text(rng, 30) + passage[:199])] + [(100 + i, passage) for i in range(5)]
    got = suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows, 200))


# --- decontamination


def test_verified_overlaps():
    cfg = dc.SeedConfig()
    item = np.arange(100, 120, dtype=np.uint64)
    doc = np.concatenate([np.arange(5), item, np.arange(50, 60)]).astype(np.uint64)
    assert dc.verified(doc, item, [5], cfg) == 20
    doc[[7, 12, 19]] = 0
    assert dc.verified(doc, item, [5], cfg) == 20
    assert dc.verified(doc, item, [4], cfg) == 0


@pytest.mark.parametrize("tokens, gap", [(45, 15), (90, 30), (100, 22)])
def test_parts_around_a_replaced_block_count_together(tokens, gap):
    rng, cfg = random.Random(13), dc.SeedConfig()
    item = [f"w{rng.randrange(10**6)}" for _ in range(tokens)]
    a = (tokens - gap) // 2
    quoted = " ".join(["before"] * 9 + item[:a] + [f"x{i}" for i in range(gap)] + item[a + gap :] + ["after"] * 9)
    found = dc.leaks([quoted.encode()], dc.SeedIndex([(7, " ".join(item))], cfg), cfg)[0]
    assert [i for i, _ in found] == [0] and found[0][1] >= tokens - gap


def plain_stretches(same, least, identity):
    """All stretches, each time the best of all parts of what is left on either side, trying every pair of ends."""
    if len(same) < least:
        return 0
    value = np.where(same, 1 - identity, -identity)
    best = max(((value[a:b].sum().round(9), -a, -(b - a)) for a in range(len(same)) for b in range(a + 1, len(same) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return 0
    a, b = -best[1], -best[1] - best[2]
    own = int(b - a) if b - a >= least and same[a:b].mean() >= identity else 0
    return own + plain_stretches(same[:a], least, identity) + plain_stretches(same[b:], least, identity)


def plain_leaks(doc, items, cfg):
    """Every diagonal on which some mask fits in full, token by token."""
    found, shortest = set(), min(map(len, cfg.masks))
    tokens = lambda t: "".join(c.lower() if c.isalnum() or ord(c) > 127 else " " for c in t).split()
    d = tokens(doc)
    for i, text_ in items:
        t = tokens(text_)
        masks = cfg.masks if len(t) >= shortest else ("1" * len(t),)
        covered = set()
        for shift in range(-len(t) + 1, len(d)):
            met = any(all(d[q + shift + j] == t[q + j] for j, c in enumerate(m) if c == "1") for m in masks for q in range(len(t) - len(m) + 1) if 0 <= q + shift and q + shift + len(m) <= len(d))
            if t and met:
                lo, hi = max(0, -shift), min(len(t), len(d) - shift)
                same = np.array([d[q + shift] == t[q] for q in range(lo, hi)])
                for a, b in dc.stretches(same, min(cfg.stretch, len(t)), cfg.identity):
                    covered |= set(range(lo + a, lo + b))
        if t and len(covered) >= min(len(t), max(cfg.covered_tokens, -(-len(t) // 2))):
            found.add((i, len(covered)))
    return found


def test_leaks_equal_brute_force():
    rng, cfg = random.Random(15), dc.SeedConfig()
    items = [(i, " ".join(f"t{rng.randrange(8)}" if i % 2 else f"u{rng.randrange(500)}" for _ in range(rng.randrange(2, 34)))) for i in range(25)]
    texts = []
    for _ in range(60):
        parts = [edited(rng, t, rng.choice([0, 0.1, 0.3])) if rng.random() < 0.8 else " ".join(t.split()[: rng.randrange(1, 20)]) for _, t in rng.sample(items, 2)]
        texts.append(f"{text(rng, rng.randrange(9))} {parts[0]}, {text(rng, rng.randrange(5))} {parts[1].upper()}!")
    index = dc.SeedIndex(items, cfg)
    for t, got in zip(texts, dc.leaks([t.encode() for t in texts], index, cfg), strict=True):
        assert {(index.ids[i], n) for i, n in got} == plain_leaks(t, items, cfg)


def test_stretches_cover_as_much_as_trying_all_ends():
    rng = np.random.default_rng(3)
    for _ in range(300):
        same = rng.random(rng.integers(1, 40)) < rng.choice([0.4, 0.6, 0.8])
        got = dc.stretches(same, 8, 0.65)
        assert all(b - a >= 8 and same[a:b].mean() >= 0.65 for a, b in got) and all(b <= c for (_, b), (c, _) in zip(sorted(got), sorted(got)[1:], strict=False))
        assert bool(got) == bool(plain_stretches(same, 8, 0.65))


def test_short_items_are_found_whole():
    cfg = dc.SeedConfig()
    index = dc.SeedIndex([(1, "What is the capital of Peru?"), (2, "Lima"), (3, " ".join(f"t{i}" for i in range(20))), (4, "")], cfg)
    texts = ["He asked: what is the CAPITAL of Peru? Lima, said she. Lima!", "what is the capital", "of peru what is the capital", "the capital of peru is what", ""]
    assert [[(index.ids[i], n) for i, n in sorted(x)] for x in dc.leaks([t.encode() for t in texts], index, cfg)] == [[(1, 6), (2, 1)], [], [], [], []]


def test_leaks_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(9)
    items = [(i, text(rng, rng.randrange(15, 60), 3000)) for i in range(40)]
    clean = [(1000 + i, text(rng, 300, 3000)) for i in range(60)]
    quoted = [(2000 + i, f"{text(rng, 40, 3000)} {' '.join(t.split()[:7])} {text(rng, 40, 3000)}") for i, t in items]
    exact = [(i, f"{text(rng, 40, 3000)}\n{t.upper()}, {text(rng, 40, 3000)}") for i, t in items]
    near = [(100 + i, f"{text(rng, 40, 3000)} {edited(rng, t, 0.08)} {text(rng, 40, 3000)}") for i, t in items]
    rows = clean + quoted + exact + near + [(None, items[0][1]), (3000, None), (3001, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, leaks string").withColumnRenamed("leaks", "item_id")
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "too short")], "item_id long, text string")
    found = {}
    for cfg in (dc.SeedConfig(), dc.SeedConfig(block_bytes=1500)):
        got = dc.marked(df, bench, cfg).collect()
        assert len(got) == len(rows)
        hits = {(r.doc_id, x["item_id"]) for r in got for x in r.leaks}
        assert found.setdefault("hits", hits) == hits
    assert {(i, i) for i, _ in items} | {(None, 0)} <= hits
    assert sum((100 + i, i) in hits for i, _ in items) >= 37
    assert not {d for d, _ in hits} & {d for d, _ in clean + quoted}
