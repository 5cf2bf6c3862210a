"""Packing, nearest neighbours and chat formatting."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.llm import ann, chat, packing, subwords

DATA = "/root/testdata/sf0.01"


# --- subwords and packing


@pytest.fixture(scope="module")
def ids():
    return subwords.subwords()


def whole(ids, t):
    return ids.tokenizer.encode(t, add_special_tokens=False).ids


def test_units_give_the_tokenizers_ids(ids):
    rng = random.Random(1)
    alphabet = list("ab'sS.,|<>1é İ\t-_½… ́ﬁ$") + ["'re", "'S", "…", "<|endoftext|>"]
    texts = ["", " ", "it's x.y", "\x1c", "a" * 300] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += [t for (t,) in duckdb.sql(f"select text from '{DATA}/documents.parquet' limit 200").fetchall()]
    for most in (1_500_000, 20):
        sub = subwords.Subwords(None, most)
        for a in range(0, len(texts), 400):
            flat, n = sub([t.encode() for t in texts[a : a + 400]])
            for t, got in zip(texts[a : a + 400], np.split(flat, np.cumsum(n)[:-1]), strict=True):
                assert got.tolist() == whole(ids, t)


def test_plans_hold_every_piece():
    rng = np.random.default_rng(2)
    for length, n in ((8, 30), (50, 400), (2048, 3000)):
        counts = np.bincount(rng.integers(1, length + 1, n), minlength=length + 1)
        plan = packing.plan(counts, length)
        used = np.zeros(length + 1, int)
        for held, times in plan:
            assert 0 < sum(k * c for k, c in held.items()) <= length
            for k, c in held.items():
                used[k] += c * times
        assert (used == counts).all()
        # First-fit decreasing, piece by piece, is no better.
        bins = []
        for k in sorted(np.repeat(np.arange(length + 1), counts).tolist(), reverse=True):
            for i, free in enumerate(bins):
                if free >= k:
                    bins[i] -= k
                    break
            else:
                bins.append(length - k)
        assert sum(t for _, t in plan) <= len(bins)


def test_two_for_the_smallest():
    counts = np.zeros(11, int)
    counts[[6, 3, 2]] = [1, 1, 2]
    # 6 + 3 leaves a gap of 1; 2 + 2 in place of 3 closes it.
    assert packing.plan(counts, 10)[0] == ({6: 1, 2: 2}, 1)
    assert packing.plan(np.zeros(11, int), 10) == []


def plain_best_two_fit(lengths, room):
    """Bins piece by piece: the longest piece that fits again and again, then two for the smallest if they fill more."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        held, free = [], room
        for k in list(left):
            if k <= free:
                held.append(k)
                left.remove(k)
                free -= k
        small = min(held)
        pairs = [(left[i] + left[j], left[i], left[j]) for i in range(len(left)) for j in range(i + 1, len(left)) if left[i] + left[j] <= free + small]
        if free and pairs and max(pairs)[0] > small:
            held.remove(small)
            left.append(small)
            for k in max(pairs)[1:]:
                held.append(k)
                left.remove(k)
            left.sort(reverse=True)
        bins.append(sum(held))
    return bins


def test_plans_equal_plain_best_two_fit():
    rng = np.random.default_rng(8)
    for length, n in ((8, 25), (30, 40), (100, 60), (100, 30)):
        for _ in range(10):
            lengths = rng.integers(1, length + 1, n).tolist()
            bins = [sum(k * c for k, c in held.items()) for held, times in packing.plan(np.bincount(lengths, minlength=length + 1), length) for _ in range(times)]
            assert sorted(bins) == sorted(plain_best_two_fit(lengths, length))


def test_words_that_a_polynomial_could_not_tell_apart(spark, ids):
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    flat, n = subwords.Subwords()([one.encode(), two.encode()])
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == [whole(ids, one), whole(ids, two)]


def test_packing(spark, ids):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["word", "the", "Zebra!"]) for _ in range(rng.randrange(60)))) for i in range(80)] + [(90, "long " * 300), (91, None), (92, ""), (93, "same same"), (93, "same same"), (None, "none")]
    cfg = packing.PackConfig(length=32)
    got = packing.packed(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, part int"), cfg).collect()
    want = Counter()
    for d, t in rows:
        x = np.array([*whole(ids, t or ""), 0], "<u4")
        for i, a in enumerate(range(0, len(x), 32)):
            want[(d, i, a, len(x[a : a + 32]), zlib.crc32(x[a : a + 32].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 32
    assert len(seqs) <= 1.03 * -(-sum(r.length for r in got) // 32) + 1
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- nearest neighbours


def test_hilbert_is_a_curve():
    for d, bits in ((2, 4), (3, 3), (1, 5)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d), -1).reshape(-1, d)
        key = ann.hilbert(grid, bits)
        path = grid[np.argsort(key)]
        assert sorted(key.tolist()) == list(range(len(grid))) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def nearest(rows, every=50):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    good = list({(i, v.tobytes()): (i, v) for i, v in good}.values())
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    ids = np.array([i for i, _ in good])
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i % every == 0:
            s = np.where(ids == i, -9, (x @ v).round(12))
            out[int(i)] = [int(ids[j]) for j in np.lexsort((ids, -s))[:5] if s[j] > -9]
    return out


@pytest.mark.parametrize("cfg", [ann.CurveConfig(), ann.CurveConfig(block_rows=7, chunk_bytes=20_000, least=20, sample=20)])
def test_neighbours(spark, cfg):
    g = np.random.default_rng(4)
    rows = [(i, g.normal(size=16).tolist()) for i in range(1500)]
    same = rows[0][1]
    rows += [(2000 + i, same) for i in range(400)] + [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [1.0] * 3), (3004, [None] + [1.0] * 15), (None, same), (3050, [float("inf")] * 16), (0, same)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    for r in sorted(ann.nearest(df, F.col("vec_id") % 50 == 0, cfg).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
        assert r.rank == len(got[r.query_id]) and r.score <= 1 + 1e-9
    want = nearest(rows)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert np.mean([len(set(got[q]) & set(w)) / 5 for q, w in want.items()]) >= 0.9
    assert got[2000] == want[2000] == [0, 2001, 2002, 2003, 2004] and got[0] == [2000, 2001, 2002, 2003, 2004]


@pytest.mark.parametrize("noise", [1e-2, 1e-4, 1e-8])
def test_a_third_of_all_nearly_equal(spark, noise):
    """Windows are measured, so a hot cell of the curves costs work and no recall."""
    g = np.random.default_rng(7)
    centre = g.normal(size=16)
    rows = [(i, (centre + noise * g.normal(size=16) if i % 3 == 0 else g.normal(size=16)).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, ann.CurveConfig(least=20)).collect():
        got[r.query_id].add(r.vec_id)
    x = np.array([v for _, v in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = {0: [], 1: []}
    for q, found in got.items():
        c = x @ x[q]
        c[q] = -9
        # By the measure itself: at the least noise all of the group are equally near in double precision.
        hits[int(q % 3 == 0)].append(np.mean([c[i] >= np.sort(c)[-5] - 1e-15 for i in found]))
    assert len(got) == 120 and np.mean(hits[0]) >= 0.9 and np.mean(hits[1]) >= 0.9


def test_very_large_and_very_small_components(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1e200, 1e199, 0.0]), (2, [1e-200, 2e-200, 0.0]), (3, [1.0, 1e-3, 0.0]), (4, [-1e308, 0.0, 0.0]), (5, [5e-324, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in sorted(ann.nearest(df, F.col("vec_id") == 0).collect(), key=lambda r: r.rank)]
    assert [i for i, _ in got] == [5, 3, 1, 2, 4]
    assert [s for _, s in got] == pytest.approx([1, (1 + 1e-6) ** -0.5, 1.01**-0.5, 5**-0.5, -1])


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.nearest(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 0.707107)]
    assert ann.nearest(df.where("false"), F.col("vec_id") == 0).count() == 0


def test_recall_on_the_table(spark):
    rows = duckdb.sql(f"select vec_id, embedding from '{DATA}/embeddings.parquet'").fetchall()
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([i for i, _ in rows])
    got = defaultdict(set)
    for r in ann.op1_ann(spark, DATA).collect():
        got[r.query_id].add(r.vec_id)
    hits = []
    for i, v in zip(ids, x, strict=True):
        if i % 50 == 0:
            s = np.where(ids == i, -9, x @ v)
            hits.append(len(got[int(i)] & set(ids[np.argsort(-s)[:5]].tolist())) / 5)
    assert np.mean(hits) >= 0.9


# --- chat


def test_round_trips():
    rng = random.Random(5)
    parts = ["\\", ":", "<", ">", "|", "turn", "<|turn|>", "<|end|>", "</s>", "[INST]", "a", "\n", "\x02?\x03", "\x02", "?", "é", "<|says|>"]
    for _ in range(5000):
        m = [(rng.choice(["user", "assistant", "<|says|>", "", "sys\\"]), "".join(rng.choice(parts) for _ in range(rng.randrange(6)))) for _ in range(rng.randrange(5))]
        f = chat.formatted(m)
        assert chat.read(f.text) == m and not f.rewrites
        assert [chat.unescaped(f.text[a:b]) for a, b in f.own] == [t for _, t in m]
        assert all(c not in chat.escaped(t) for _, t in m for c in chat.CONTROL)


def test_other_templates():
    inst = lambda ms: "".join(f"[INST] {t} [/INST]" if r == "user" else f" {t}</s>" for r, t in ms)
    m = [("user", "hi"), ("assistant", "yo"), ("user", "hi"), ("assistant", "[INST] hi")]
    f = chat.formatted(m, inst)
    assert [f.text[a:b] for a, b in f.own] == [t for _, t in m] and not f.rewrites and chat.loss_text(f, m) == "yo[INST] hi"
    trailer = lambda ms: "".join(f"<{r}>{t}" for r, t in ms) + "<go>"
    assert not chat.formatted(m, trailer).rewrites
    forgets = lambda ms: "".join(f"<{r}>{t if i == len(ms) - 1 else t[:1]}" for i, (r, t) in enumerate(ms))
    assert chat.formatted([("user", "hello"), ("assistant", "there"), ("user", "x")], forgets).rewrites


def test_conversations_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{DATA}/conversations.parquet'")
    want = sorted(con.execute(chat.OP6_SQL).fetchall())
    assert sorted(map(tuple, chat.op6_chat(spark, DATA).collect())) == want and want[0][0] == -1


def test_conversation_corners(spark):
    rows = [(1, 2, "assistant", "b", 0), (1, 1, "user", None, 0), (1, 2, "assistant", "a", 0), (None, None, None, "x", 0), (None, 1, "user", "z", 0), (2, 1, "assistant", "y" * 100000, 0)]
    found = chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")).collect()
    got = {r.conv_id: r for r in found}
    assert (got[1].n_turns, got[1].loss_chars, got[None].loss_chars, got[2].loss_chars) == (3, 2, 0, 100000)
    assert [r.n_turns for r in found if r.conv_id is None] == [1, 1]
    assert chat.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
