"""Language identification, quality, personal data and language-model scoring."""

import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.llm import langid, lm, pii, quality

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text, lang from '{DATA}/documents.parquet'").fetchall()


# --- language


def test_document_vector_is_the_sum_of_bound_letters():
    cfg = langid.LangConfig(size=64)
    letters = np.random.default_rng(cfg.seed).choice(np.array([-1, 1], np.int8), (40, 64)).astype(int)
    code = [0, 1, 2, 0, 3, 0]
    want = sum(np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for a, b, c in zip(code, code[1:], code[2:], strict=False))
    at, n, some = langid.gram_counts(b"aB 1. c")
    assert some and langid.bundle(at, n, cfg).astype(int).tolist() == want.tolist()


def test_predictions_equal_plain_ones(spark):
    """Learning, centring and cosine, letter by letter."""
    cfg, rng = langid.LangConfig(size=64), random.Random(2)
    letters = np.random.default_rng(cfg.seed).choice(np.array([-1, 1], np.int8), (40, 64)).astype(float)
    kinds = {"x": "abc de", "y": "bcd fé", "z": "xyz a"}
    rows = [(i, "".join(rng.choice(kinds[k]) for _ in range(rng.randrange(3, 40))), k) for i, k in enumerate(list(kinds) * 20)]

    def vector(t):
        code, out = [0], np.zeros(64)
        for c in [*(int(langid.letter_classes()[ord(c)]) for c in t), 0]:
            if c or code[-1]:
                code.append(c)
        for a, b, c in zip(code, code[1:], code[2:], strict=False):
            out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return out

    unit = lambda v: v / max(1e-12, np.linalg.norm(v))
    protos = {k: unit(sum(unit(vector(t)) for i, t, x in rows[:30] if x == k)) for k in kinds}
    centre = sum(protos.values()) / 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predicted(df, langid.learn(df.where("doc_id < 30").select("lang", "text"), cfg), cfg).collect()}
    for i, t, _ in rows:
        cos = {k: float(unit(p - centre) @ unit(unit(vector(t)) - centre)) for k, p in protos.items()}
        best = max(sorted(cos), key=cos.get)
        assert got[i].lang_pred == best and got[i].score == pytest.approx((1 + cos[best]) / 2, abs=1e-4)


def test_languages(spark, docs):
    got = langid.op2_langid(spark, DATA).collect()
    lang = {d: x for d, _, x in docs}
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_language_corners(spark):
    rows = [(1, "the cat and the dog", "en", 1), (2, "der Hund und die Katze", "de", 1), (3, "x", None, 1), (None, "the", None, 1), (5, None, "en", 1), (6, "123 !?", "en", 1), (7, "", "de", 1), (8, "the cat " * 20000, None, 1), (8, "the cat " * 20000, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    learned = langid.learn(df.select("lang", "text"))
    got = Counter((r.doc_id, r.lang_pred) for r in langid.predicted(df, learned).collect())
    assert got[(5, "und")] == got[(6, "und")] == got[(7, "und")] == got[(None, "en")] == 1 and got[(8, "en")] == 2
    nothing = langid.learn(df.where("false").select("lang", "text"))
    assert {r.lang_pred for r in langid.predicted(df, nothing).collect()} == {"und"}
    assert langid.predicted(df.where("false"), learned).count() == 0


# --- quality


def plain_score(m, rows):
    """The score of one bag, passage by passage."""
    h = [np.tanh((x - m.mean) / m.scale @ m.p["W"] + m.p["b"]) for x in rows.astype(float)]
    e = np.array([(np.tanh(v @ m.p["V"]) / (1 + np.exp(-(v @ m.p["U"])))) @ m.p["w"] for v in h])
    a = np.exp(e) / np.exp(e).sum()
    return 1 / (1 + math.exp(-(sum(w * v for w, v in zip(a, h, strict=True)) @ m.p["c"] + m.p["d"][0])))


def test_gradients():
    cfg = quality.QualityConfig(hidden=5, gate=3, epochs=1)
    g = np.random.default_rng(0)
    x, count, y = g.normal(size=(12, 7)).astype(np.float32), np.array([3, 1, 5, 3]), np.array([0, 1, 1, 0])
    m = quality.AttentionMIL(7, cfg)

    def loss():
        p = np.array([plain_score(m, x[a : a + n]) for a, n in zip(np.cumsum(count) - count, count, strict=True)])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grad = m.gradients(x, count, y)
    for k, p in m.p.items():
        for i in range(min(p.size, 6)):
            was, ends = p.flat[i], []
            for d in (1e-4, -1e-4):
                p.flat[i] = was + d
                ends.append(loss())
            p.flat[i] = was
            assert grad[k].flat[i] == pytest.approx((ends[0] - ends[1]) / 2e-4, abs=2e-5), k
    before = loss()
    for _ in range(150):
        m.fit(x, count, y, quality.QualityConfig(hidden=5, gate=3, epochs=3))
    assert loss() < 0.3 * before
    whole = m.score(x, count)
    assert np.allclose(whole, [plain_score(m, x[a : a + n]) for a, n in zip(np.cumsum(count) - count, count, strict=True)], atol=1e-5)


def plain_features(t, cfg):
    """Class shares, word-bucket shares and the rest of a text, passage by passage, without numpy's bulk operations."""
    flat = t + b"\n"
    cuts = [flat[a : a + cfg.passage_bytes] for a in range(0, max(1, len(flat) - 1), cfg.passage_bytes)]
    if len(cuts) > 1 and len(flat) - 1 == cfg.passage_bytes * (len(cuts) - 1):
        cuts = cuts[:-1]
    out = []
    for i, c in enumerate(cuts):
        c = c if i + 1 < len(cuts) else flat[i * cfg.passage_bytes :]
        begun = [m for m in re.finditer(rb"[^\x20\x09-\x0D]+", flat) if i * cfg.passage_bytes <= m.start() < i * cfg.passage_bytes + len(c)]
        ws = [m.group().lower() for m in begun]
        n = max(1, len(ws))
        h = [int(quality.words.hashed_texts([w])[0][0]) for w in ws]
        kinds = np.bincount([int(quality._CLASS[x]) for x in c], minlength=quality._CLASSES) / len(c)
        bag = np.bincount([v % cfg.buckets for v in h], minlength=cfg.buckets) / n
        same = [sum(a == b for a, b in zip(ws[d:], ws, strict=False)) / n for d in (1, 2)]
        out.append([*kinds, *bag, *same, len(set(ws)) / n, sum(map(len, ws)) / n / 10, math.log1p(len(ws)), math.log1p(len(c))])
    return np.array(out)


def test_scores_equal_plain_ones(docs):
    cfg = quality.QualityConfig(passage_bytes=64)
    texts = [b"", b"a", b"x y x y y", b"b" * 64, b"b" * 65, *(t.encode()[:1500] for _, t, _ in docs[:40])]
    x, n = quality.features(texts, cfg)
    m, g = quality.AttentionMIL(x.shape[1], cfg), np.random.default_rng(1)
    m.p["c"] = g.normal(size=m.p["c"].shape) * 5
    got, at = m.score_texts(texts, cfg), np.cumsum(n) - n
    for i, t in enumerate(texts):
        rows = plain_features(t, cfg)
        assert np.allclose(x[at[i] : at[i] + n[i]], rows, atol=1e-5) and got[i] == pytest.approx(plain_score(m, rows), abs=1e-4)


def test_every_passage_is_learned(spark):
    """A label that only the last of 400 passages explains."""
    rows = [(i, "plain words of no kind " * 9000 + ("zebra! zebra! " * 30 if i % 2 else "")) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    cfg = quality.QualityConfig(epochs=60)
    model = quality.learn(df, labels.where("doc_id < 40"), cfg, held_out=lambda c: F.lit(False))
    got = {r.doc_id: r.score for r in quality.scored(df, model, cfg).collect()}
    assert sum((got[i] >= 0.5) == (i % 2 == 1) for i in range(40, 60)) >= 18


def test_quality(spark):
    got = quality.op9_quality(spark, DATA).collect()
    label = dict(duckdb.sql(f"select doc_id, quality from '{DATA}/labels.parquet'").fetchall())
    held = [r for r in got if r.held_out and r.doc_id in label]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.95 * len(held)


def test_quality_corners(spark):
    df = spark.createDataFrame([(1, "a b", 1.0), (None, None, 1.0), (2, "", 2.0), (2, "", 2.0), (3, "word " * 100000, 0.0)], "doc_id long, text string, score double").toDF("doc_id", "text", "doc_id2")
    for rows in ([], [(1, 1, 0)], [(1, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 0), (3, 7, 0)]):
        model = quality.learn(df.select("doc_id", "text"), spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), held_out=lambda c: F.lit(False))
        got = quality.scored(df, model).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality.scored(df.where("false"), model).count() == 0


# --- personal data


def plain_spans(t):
    digits = pii._digits
    out = [(*m.span(), "email") for m in pii._EMAIL.finditer(t)]
    out += [(*m.span(), "ip") for m in pii._IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(*m.span(), "card") for m in pii._CARD.finditer(t) if 14 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    return out + [(*m.span(), "phone") for m in pii._PHONE.finditer(t) if 10 <= len(digits(m.group())) <= 15]


def test_base_spans_equal_plain_matching(docs):
    rng = random.Random(1)
    made = ["".join(rng.choice("a.@ -1234567890+()b%") for _ in range(60)) for _ in range(5000)]
    for t in [*made, *(t for _, t, _ in docs)]:
        assert pii.base_spans(t) == plain_spans(t)


def test_long_runs_of_digits_take_linear_time():
    for t in ("7" * 1_000_000, "1." * 500_000, "12 " * 3000 + "9" * 500_000, "1.2.3" * 200_000):
        began = time.perf_counter()
        pii.base_spans(t)
        pii.candidates(t[:100_000])
        assert time.perf_counter() - began < 5
    dotted = "".join(random.Random(4).choice("0123456789..") for _ in range(20_000))
    assert [m.span() for m in pii._IP_RUNS.finditer(dotted)] == [m.span() for m in pii._IP.finditer(dotted)]


def plain_tree_score(trees, x):
    total, inner = trees.start, len(trees.feature[0])
    for f, c, v in zip(trees.feature, trees.cut, trees.leaf, strict=True):
        node = 0
        while node < inner:
            node = 2 * node + (2 if x[f[node]] > c[node] else 1)
        total += v[node - inner]
    return 1 / (1 + math.exp(-total))


def plain_find(t, trees):
    """Added spans: the best candidate that is over its threshold and touches no base span and none taken before it."""
    taken = [(s, e) for s, e, _ in plain_spans(t)]
    scored = sorted(((-plain_tree_score(trees, pii.describe(t, c)), i, c) for i, c in enumerate(pii.candidates(t))), key=lambda x: x[:2])
    out = []
    for score, _, (s, e, k) in scored:
        if -score >= trees.threshold[k] and all(e <= a or s >= b for a, b in taken):
            taken.append((s, e))
            out.append((s, e, k))
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


def test_added_spans_equal_plain_choice(docs):
    trees = pii.model()
    made = [t for t, _, _ in pii.examples(150, 5)]
    found = 0
    for t in [*made, *(t for _, t, _ in docs if "+" in t or "@" in t)][:400]:
        base, added = pii.find(t, trees)
        assert added == plain_find(t, trees)
        found += len(added)
    assert found > 20


def test_unseen_examples():
    trees, seen = pii.model(), pii.examples(1500, 77)
    score = trees.score(np.array([pii.describe(t, s) for t, s, _ in seen]))
    right = [(x >= trees.threshold[s[2]]) == bool(y) for x, (_, s, y) in zip(score, seen, strict=True)]
    assert np.mean(right) > 0.95


def test_added_spans_leave_base_ones_alone():
    t = "mail ann.lee@mail.example.com or bob smith at corp dot com, call (555) 123-4567, card 4111 1111 1111 1111, host 10.0.0.1, order 20240101"
    base, added = pii.find(t, pii.model())
    assert [k for *_, k in base] == ["email", "card", "ip"]
    assert "phone" in {k for *_, k in added} and all(e <= a or s >= b for s, e, _ in added for a, b, _ in base)
    clean = pii.redacted(t, base + added)
    assert "ann.lee" not in clean and "4111" not in clean and "10.0.0.1" not in clean and "20240101" in clean


@pytest.mark.parametrize("t, want", [
    ("Tel 555-123-4567 555-987-6543", ["555-123-4567", "555-987-6543"]),
    ("030 1234567 / 0171 1234567", ["030 1234567", "0171 1234567"]),
    ("call +1 (826) 555-4081 190.137.223.204 now", ["+1 (826) 555-4081"]),
    ("paid 2353820953013749 4550997810720808", ["4550997810720808"]),
    ("paid 7536784127813050 4845168114407329", ["7536784127813050", "4845168114407329"]),
])
def test_numbers_beside_numbers_are_found(t, want):
    base, added = pii.find(t, pii.model())
    assert [t[s:e] for s, e, _ in added] == want


def test_pii_frame(spark):
    rows = [(1, "a@b.co", "x"), (None, None, "x"), (2, "", "x"), (2, "", "x"), (3, "no " * 50000 + "+1 (555) 123-4567", "x")]
    got = pii.with_spans(spark.createDataFrame(rows, "doc_id long, text string, pii string").toDF("doc_id", "text", "spans")).collect()
    assert [(r.pii.email, r.pii.phone, r.pii.redacted is None) for r in sorted(got, key=lambda r: r.doc_id or 0)] == [(0, 0, True), (1, 0, False), (0, 0, True), (0, 0, True), (0, 1, False)]
    assert pii.with_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- language model


def plain_base(rows):
    tokens = [(d, [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None]) for d, t in rows]
    c = Counter(w for d, ws in tokens if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    return Counter((d, len(ws), sum(c[w] > 0 for w in ws), n, f"{sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws):.5f}") for d, ws in tokens)


@pytest.mark.parametrize("head", [500_000, 3, 1])
def test_base_scores(spark, head):
    rows = [(1, "a b A a"), (2, ""), (3, None), (4, "x y z"), (4, "x y z"), (None, "x y z q"), (5, "  q" * 3), (6, "É é a")]
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    got = lm.scored(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, w int"), held, lm.LMConfig(head=head)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.5f}") for r in got) == plain_base(rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_no_document_and_no_training(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    (r,) = lm.scored(df, F.lit(True)).collect()
    assert (r.n_known, r.train_tokens) == (0, 0) and r.base_score == 0 and r.score < 0
    assert lm.scored(df.where("false"), F.lit(False)).count() == 0


def small(cfg, seed=0):
    g = np.random.default_rng(seed)
    texts = [np.cumsum(g.integers(0, 3, int(g.integers(0, 90)))).astype(np.int32) % 40 for _ in range(60)]
    class_of = np.arange(cfg.vocabulary) % cfg.classes
    flat = np.concatenate([np.concatenate([[cfg.edge], t]) for t in texts] + [[cfg.edge]]).astype(int)
    after = np.zeros((cfg.classes, cfg.vocabulary))
    np.add.at(after, (class_of[flat[:-1]], flat[1:]), 1)
    return lm.AttentionLM(cfg, after, class_of), texts


SMALL = lm.LMConfig(vocabulary=41, edge=40, classes=5, block=8, width=4, own=41, shared=1, embedding=6, passes=6, every=1, batch=8)


def test_gradients_of_the_attention_model():
    m, texts = small(SMALL)
    m.fit(texts)
    m.p = {k: v.astype(float) for k, v in m.p.items()}
    m.freeze()
    inputs, targets, first, _ = m.windows(texts[:6])
    begins = np.zeros(len(inputs), bool)
    begins[first] = True
    before = np.roll(inputs, 1, 0)
    n = (targets >= 0).sum()

    def loss():
        m.freeze()
        within = sum(m.within[m.class_of[x], y][y >= 0].sum(dtype=float) for x, y in zip(inputs, targets, strict=True))
        return -(m.score(texts[:6]).sum() - within) * math.log(10) / n

    grad = m.gradients(inputs, targets, before, begins)
    for k, p in m.p.items():
        for i in np.argsort(-np.abs(grad[k]).reshape(-1))[:3]:
            was, ends = p.flat[i], []
            for d in (1e-4, -1e-4):
                p.flat[i] = was + d
                ends.append(loss())
            p.flat[i] = was
            assert grad[k].flat[i] == pytest.approx((ends[0] - ends[1]) / 2e-4, rel=0.05, abs=1e-4), k


def test_runs_of_windows_have_the_gradients_of_their_windows():
    """Windows taken in runs, over the ends of texts too, against each taken alone; a run is filled up without effect."""
    m, texts = small(SMALL)
    m.fit(texts)
    inputs, targets, first, _ = m.windows(texts)
    begins = np.zeros(len(inputs), bool)
    begins[first] = True
    before, n = np.roll(inputs, 1, 0), len(inputs) // 4 * 4 - 1
    alone = m.gradients(inputs[:n], targets[:n], before[:n], begins[:n])
    filled = targets[: n + 1].copy()
    filled[n] = -1
    runs = m.gradients(inputs[: n + 1].reshape(-1, 32), filled.reshape(-1, 32), before[: n + 1 : 4], begins[: n + 1].reshape(-1, 4), most=12)
    for k, g in alone.items():
        assert np.allclose(runs[k], g, atol=1e-6) and np.abs(g).max() > 1e-4, k


def test_steps_over_runs_take_every_window_once():
    m, texts = small(lm.LMConfig(vocabulary=41, edge=40, classes=5, block=8, width=4, own=41, shared=1, embedding=6, batch=32, run=4, settled=0))
    taken, plain = [], m.gradients
    m.gradients = lambda x, y, before, begins: taken.append(y.reshape(-1, 8)) or plain(x, y, before, begins)
    _, targets, _, _ = m.windows(texts)
    assert m.learn(texts) == len(targets)
    assert Counter(map(bytes, np.concatenate(taken))) - Counter([bytes(np.full(8, -1, np.int32))]) - Counter(map(bytes, targets)) <= Counter({bytes(np.full(8, -1, np.int32)): 3})
    assert not Counter(map(bytes, targets)) - Counter(map(bytes, np.concatenate(taken)))


def test_words_that_share_a_place_are_still_looked_up():
    """Known words, two of them at one place of the table, and unknown ones, text by text."""
    texts = [b"a b c a", b"", b"d d a e", b"c"]
    h = {w: int(lm.words.hashed_texts([w.encode()])[0][0]) for w in "abcde"}
    known = np.sort(np.array([h["a"], h["b"], h["c"]], np.uint64))
    value = np.arange(3) + 1.0
    of = {int(k): v for k, v in zip(known, value, strict=True)}
    for bits in (1, 20):
        direct = lm.words.Direct(bits)
        direct.put(known, np.arange(3))
        for _ in range(2):
            size, seen, sums, w, k, cut = lm._looked_up(texts, known, value, direct)
            assert size.tolist() == [4, 0, 4, 1] and seen.tolist() == [4, 0, 1, 1]
            assert sums.tolist() == [sum(of.get(h[x], 0) for x in t.decode().split()) for t in texts]
            rare = [dict(zip(w.view(np.uint64)[a:b].tolist(), k[a:b].tolist(), strict=True)) for a, b in zip(cut, cut[1:], strict=False)]
            assert rare == [{}, {}, {h["d"]: 2, h["e"]: 1}, {}]


def test_all_training_windows_are_learned(spark):
    """The steps of every task count: the windows of all training rows, of whole texts, and of no other ones."""
    cfg = lm.LMConfig(held=500)
    rows = [(i % 3 == 2, np.random.default_rng(i).integers(0, 300, 20_000 if i == 4 else 30).astype("<u2").tobytes()) for i in range(40)] + [(False, b""), (False, None)]
    model = lm.learned(spark.createDataFrame(rows, "held_out boolean, ids binary").repartition(3), cfg)
    blocks = [-(-(len(x or b"") // 2 + 1) // cfg.block) for out, x in rows if not out]
    # One in `every` of each text, give or take one at its ends, and one of each at least.
    assert sum(max(1, n // cfg.every) for n in blocks) <= model.learned <= sum(-(-n // cfg.every) for n in blocks) and model.score([np.arange(20)])[0] < 0
    every = lm.learned(spark.createDataFrame(rows, "held_out boolean, ids binary").repartition(3), lm.LMConfig(held=500, every=1))
    assert every.learned == sum(blocks)


def test_steps_take_every_window_unless_told_otherwise():
    """Of the query's own settings: all windows of long and short texts, wherever they stand."""
    m, texts = small(lm.LMConfig(vocabulary=41, edge=40, classes=5, block=8, width=4, own=41, shared=1, embedding=6))
    assert lm.LMConfig().every == 1 and m.learn(texts) == sum(-(-(len(t) + 1) // 8) for t in texts)


def test_the_corpus_is_what_the_model_knows(spark):
    """Trained on two kinds of text, the model finds an unseen text of either kind likelier than its words shuffled."""
    rng = random.Random(3)
    lines = ["the cat sat on the mat and the dog ran to the house", "one two three four five six seven eight nine ten"]
    rows = [(i, " ".join(rng.choice(lines) for _ in range(8))) for i in range(300)]
    shuffled = [(1000 + i, " ".join(rng.sample(t.split(), len(t.split())))) for i, t in rows[:40]]
    got = {r.doc_id: r.score for r in lm.scored(spark.createDataFrame(rows + shuffled, "doc_id long, text string"), F.col("doc_id") >= 1000).collect()}
    assert sum(got[i] > got[1000 + i] for i in range(40)) == 40


def test_windows_score_each_token_once_and_causally():
    m, texts = small(SMALL)
    m.fit(texts)
    for t, got in zip(texts, m.score(texts), strict=True):
        seq, total = np.concatenate([[40], t]), 0.0
        for i in range(len(seq)):
            ctx = seq[max(0, (i // 8 - 1) * 8) : i + 1]
            slot = m.slot[ctx]
            e = m.tables[1][slot] @ m.tables[0][slot[-1]] + m.p["r"][np.arange(len(ctx))[::-1]]
            a = np.exp(e - e.max())
            logit = (a / a.sum()) @ m.tables[2][slot] @ m.p["o"] + m.tables[3][slot[-1]] + m.p["b"][m.class_of[seq[i]]]
            to = t[i] if i < len(t) else 40
            total += (logit[m.class_of[to]] - np.log(np.exp(logit).sum())) / math.log(10) + m.within[m.class_of[seq[i]], to]
        assert got == pytest.approx(total, abs=1e-3)


def test_the_next_subwords_probabilities_sum_to_one():
    m, _ = small(SMALL)
    both = [m.score([np.array([3, 7, i], np.int32)])[0] for i in range(41)]
    # P(3, 7, i, end) / P(end | 3, 7, i) over all i, against P(3, 7, *).
    ends = []
    for i in range(41):
        seq = [np.array([3, 7, i], np.int32)]
        x, y, first, _ = m.windows(seq)
        ends.append(10 ** (both[i] - _prefix(m, [3, 7, i])))
    assert sum(10 ** _prefix(m, [3, 7, i]) for i in range(41)) == pytest.approx(10 ** _prefix(m, [3, 7]), rel=1e-3) and max(ends) <= 1


def _prefix(m, ids):
    """log10 P of a prefix: the text's score with its end's factor left out."""
    inputs, targets, first, _ = m.windows([np.array(ids, np.int32)])
    targets[0, len(ids)] = -1
    real = m.windows
    m.windows = lambda texts: (inputs, targets, first, None)
    try:
        return m.score([np.array(ids, np.int32)])[0]
    finally:
        del m.windows
        assert m.windows == real


def test_training_helps():
    m, texts = small(SMALL)
    before = m.score(texts).sum()
    assert m.fit(texts).score(texts).sum() > before
