"""Operators on small frames."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from skarn.functions.html import main_text
from skarn.operators import catalog, chunk, clean, evaluate, index, logs, search, tabular
from skarn.plugins import HashEmbedder, count_words, embedded, extractive_generator, overlap_reranker, routed
from skarn.settings import DEFAULT
from skarn.sources import files as sources


# --- search


@pytest.fixture(scope="module")
def library(spark):
    rows = [(1, "izin izin izin günleri", "internal", "active"), (2, "izin formu KLK-IT-07", "internal", "active"), (3, "gizli izin notu", "restricted", "active"), (4, "eski izin kuralı", "internal", "superseded"), (5, "", "internal", "active"), (6, None, "internal", "active")]
    return spark.createDataFrame(rows, "doc_id long, text string, access_level string, status string")


def test_repeats_add_less_and_less(spark):
    df = spark.createDataFrame([(1, "izin"), (2, "izin izin izin")], "doc_id long, text string")
    once, three = (r.weight for r in search.weights(search.postings(df)).orderBy("doc_id").collect())
    assert once < three < 3 * once


def test_search_filters_every_leg(spark, library):
    asked = spark.createDataFrame([(1, "izin"), (2, "?")], "question_id long, text string")
    e = HashEmbedder(16)
    vectors = library.withColumn("text", F.coalesce("text", F.lit(""))).transform(lambda d: embedded(d, "text", e)).select("doc_id", "embedding")
    qv = spark.createDataFrame([(1, e(["izin"])[0]), (2, e(["formu"])[0])], "question_id long, vector array<double>")
    for mode in ("sparse", "dense", "hybrid"):
        hits = search.search(asked, library, ("internal",), mode, vectors, qv, k=10).collect()
        assert not {h.doc_id for h in hits} & {3, 4}
    assert {h.doc_id for h in search.search(asked, library, ("internal", "restricted"), "sparse", k=10, superseded=True).collect()} == {1, 2, 3, 4}
    assert search.search(asked, library, (), "sparse").count() == 0
    assert {h.question_id for h in search.search(asked, library, ("internal",), "sparse").collect()} == {1}
    assert {h.question_id for h in search.search(asked, library, ("internal",), "hybrid", vectors, qv).collect()} == {1, 2}
    with pytest.raises(ValueError):
        search.search(asked, library, ("internal",), "fuzzy")


def test_rerank_keeps_the_threshold_and_the_old_order(spark):
    hits = spark.createDataFrame([(1, d, r, s) for d, r, s in ((10, 1, 0.02), (11, 2, 0.5), (12, 3, 0.5), (13, 4, 0.0199))], "question_id long, doc_id long, rank int, new double")
    out = search.reranked(hits, F.col("new"), 5, 0.02).orderBy("rank").collect()
    assert [r.doc_id for r in out] == [11, 12, 10]


def test_blocks_of_queries_change_nothing(spark):
    v = spark.range(40).select(F.col("id").alias("vec_id"), F.array(*(F.rand(i) for i in range(4))).alias("embedding")).cache()
    q = v.where("vec_id < 9").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    one, many = (sorted(map(tuple, search.dense_topk(q, v, 3, block_rows=n).collect())) for n in (100, 2))
    assert one == many and len(one) == 27


# --- catalog


GOOD = '[[document]]\nfile = "a.pdf"\naccess_level = "internal"\neffective_date = 2024-05-01\n[[document]]\nfile = "b.pdf"\naccess_level = "internal"\nstatus = "superseded"\nreplaced_by = "a.pdf"\n'
BROKEN = [
    GOOD + '[[document]]\nfile = "a.pdf"\naccess_level = "internal"\n',
    '[[document]]\naccess_level = "internal"\n',
    '[[document]]\nfile = "a"\naccess_level = "public"\n',
    '[[document]]\nfile = "a"\nacess_level = "internal"\n',
    '[[document]]\nfile = "a"\naccess_level = "internal"\nstatus = "old"\n',
    '[[document]]\nfile = "a"\naccess_level = "internal"\nstatus = "superseded"\n',
    '[[document]]\nfile = "a"\naccess_level = "internal"\nreplaced_by = "b"\n',
    '[[document]]\nfile = "a"\naccess_level = "internal"\neffective_date = "2024-05-01"\n',
    '[[document]]\nfile = "a"\naccess_level = "internal"\nstatus = "superseded"\nreplaced_by = "gone"\n',
    "[document]\nfile = 1\n",
    "not toml",
]


@pytest.mark.parametrize("text", BROKEN)
def test_broken_catalogs_are_rejected(spark, text):
    with pytest.raises(catalog.CatalogError):
        catalog.checked(catalog.parsed(spark, text))


def test_labels_and_default(spark):
    labels = catalog.checked(catalog.parsed(spark, GOOD))
    rows = spark.createDataFrame([("a.pdf",), ("x.pdf",), (None,)], "source string")
    got = {r.source: (r.access_level, r.status, r.catalogued) for r in catalog.labelled(rows, labels).collect()}
    assert got == {"a.pdf": ("internal", "active", True), "x.pdf": ("restricted", "active", False), None: ("restricted", "active", False)}
    assert [r.file for r in catalog.missing_files(labels, spark.createDataFrame([("a.pdf",)], "file string")).collect()] == ["b.pdf"]
    assert catalog.checked(catalog.parsed(spark, catalog.entry_text('q".pdf', "internal", effective_date=datetime.date(2024, 1, 2)))).first().file == 'q".pdf'


def test_ocr_ranges(spark):
    chunks = spark.createDataFrame([("a", 1, 2), ("a", 3, 4), ("a", None, None), ("b", 1, 9)], "source string, page_start int, page_end int")
    pages = spark.createDataFrame([("a", 2, True), ("a", 3, False), ("a", None, True)], "source string, number int, ocr boolean")
    assert sorted((r.source, r.page_start or 0, r.ocr) for r in catalog.with_ocr(chunks, pages).collect()) == [("a", 0, False), ("a", 1, True), ("a", 3, False), ("b", 1, False)]


def test_ocr_pages_of_one_long_source(spark):
    import random

    r = random.Random(3)
    pages = [("long", n, r.random() < 0.02) for n in range(-5, 3_000)] + [("long", None, True), (None, 1, True), ("none", 64, None)]
    ranges = [("long", a, a + r.choice([0, 1, 5, 63, 64, 200])) for a in (r.randint(-4, 3_100) for _ in range(2_000))] + [("long", 5, 4), ("long", None, 3), ("long", 3, None), (None, 1, 1), ("none", 1, 99), ("other", 1, 1)]
    read = {n for s, n, o in pages if s == "long" and o and n is not None}
    chunks = spark.createDataFrame([(*x, i) for i, x in enumerate(ranges)], "source string, page_start int, page_end int, block int")
    got = {x.block: x.ocr for x in catalog.with_ocr(chunks, spark.createDataFrame(pages, "source string, number int, ocr boolean")).collect()}
    assert got == {i: s == "long" and None not in (a, b) and any(n in read for n in range(a, b + 1)) for i, (s, a, b) in enumerate(ranges)}


# --- cleaning and tables


def test_repeated_lines(spark):
    pages = [("d", i, f"Company Ltd {i}\nBody {chr(96 + i)}\n| Company |\nPage {i}") for i in range(1, 5)] + [("d", None, "Company Ltd 9\nPage 7\nkept")]
    out = {r.number: (r.markdown, r.removed) for r in clean.without_repeated(spark.createDataFrame(pages, "source string, number int, markdown string")).collect()}
    assert out[1] == ("Body a\n| Company |", ["Company Ltd 1", "Page 1"])
    assert out[None] == ("kept", ["Company Ltd 9", "Page 7"])


def test_lines_out_are_marked(spark):
    """Rows with one number are one page, however often a line's hash is counted; a line counts once for each page."""
    pages = [("a", 1, "head\nx 1\nhead"), ("a", 1, "head\nonce"), ("a", 2, "Head \npage 3"), ("b", 1, "twice\nhead"), ("b", 1, "twice"), ("b", 2, "other"), ("b", None, "twice"), ("c", 3, None)]
    marked = clean.marked_lines(spark.createDataFrame(pages, "source string, number int, markdown string"))
    assert sorted(r.line for r in marked.where("out").collect()) == ["Head ", "head", "head", "head", "page 3"]
    assert marked.where("not out").count() == 7


@pytest.mark.parametrize(
    "html, text",
    [
        ("<body><nav>menu</nav><article><h1>T</h1><p>a <b>b</b></p><div class='Cookie-box'>no</div></article>out</body>", "T\na b"),
        ("<body><main>one<script>x()</script></main><article>two</article></body>", "one"),
        ("<p>a</p><footer>f</footer><p id='sidebar'>s</p>b", "a\nb"),
        ("<body>x<br>y &amp; z</body>", "x\ny & z"),
        ("", ""),
        (None, ""),
        ("<div><p>unclosed <aside>n", "unclosed"),
    ],
)
def test_main_text(spark, html, text):
    assert spark.createDataFrame([(html,)], "html string").select(main_text(F.col("html"))).first()[0] == text


@pytest.mark.parametrize("x, pattern, said", [(1234.5, "#,##0.00", "1.234,50"), (0.15, "0%", "%15"), (-50000, '#,##0 "TL"', "-50.000 TL"), (0.085, "0.0%", "%8,5"), (2026, "General", "2026"), (1.5, None, "1,5"), (3, "[$₺-41F]0;-0", "3 ₺")])
def test_spreadsheet_numbers(x, pattern, said):
    assert tabular.spreadsheet_number(x, pattern) == said


def test_csv_cells(spark):
    data = 'Firma,Şehir,Açıklama\n"Yıldız Ltd. Şti., Ankara",Çorum,"iki\nsatır"\n'.encode("cp1254")
    frame = spark.createDataFrame([("f.csv", bytearray(data)), ("bad.xlsx", bytearray(b"no"))], "source string, content binary")
    cells = tabular.cells_of_files(frame)
    text = {r.table: r.markdown for r in tabular.grid_markdown(cells).collect()}
    assert text["f.csv"] == "Firma: Yıldız Ltd. Şti., Ankara | Şehir: Çorum | Açıklama: iki satır"
    assert text["bad.xlsx"] == "" and cells.where("error is not null").count() == 1


def test_grid_rules(spark):
    cells = [("t", "Title", r, c, v) for r, c, v in ((1, 1, "Merged"), (2, 2, ""), (3, 1, "A"), (3, 3, "C"), (4, 1, "1"), (4, 2, "2"), (4, 3, "3"), (5, 2, "note"))] + [("e", "Empty", 1, 1, "")]
    out = {r.table: r.markdown for r in tabular.grid_markdown(spark.createDataFrame(cells, "table string, title string, row_no int, col_no int, value string")).collect()}
    assert out == {"t": "## Title\n\nMerged\n\nA: 1 | Column 2: 2 | C: 3\n\nnote", "e": ""}


def test_workbook(spark):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Name</t></si><si><r><t>Pa</t></r><r><t>y</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="164" formatCode="#,##0 &quot;TL&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>Day</t></is></c></row><row r="2"><c r="A2" t="str"><v>Ann</v></c><c r="B2" s="1"><v>85000</v></c><c r="C2" s="2"><v>45413</v></c></row></sheetData></worksheet>')
    rows = tabular.cells_of_files(spark.createDataFrame([("w.xlsx", bytearray(buf.getvalue()))], "source string, content binary"))
    assert tabular.grid_markdown(rows).first().markdown == "## S\n\nName: Ann | Pay: 85.000 TL | Day: 01.05.2024"


# --- chunks


def chunks_of(spark, source, pages):
    df = chunk.chunked(spark.createDataFrame([(source, n, t) for n, t in pages], "source string, number int, markdown string"))
    return [tuple(r) for r in df.orderBy("chunk_index").collect()]


def test_no_headings(spark):
    (c,) = chunks_of(spark, "test.md", [(None, "Just text.")])
    assert c == ("test.md", 0, "[test.md]\nJust text.", "", None, None, 3)


def test_blocks(spark):
    text = "## A\nright below\n\n## Label:\n- x\n- y\n\n| a |\n\n\n  \n2) item\n\n#no heading\n\n# B"
    rows = chunk.blocks(spark.createDataFrame([("s", 1, text), ("s", None, None)], "source string, number int, markdown string")).orderBy("part", "sub").collect()
    assert [(r.kind, r.text, r.level) for r in rows] == [
        ("heading", "A", 2), ("paragraph", "right below", 0), ("paragraph", "Label:", 2), ("list", "- x\n- y", 0), ("table", "| a |", 0), ("list", "2) item", 0), ("paragraph", "#no heading", 0), ("heading", "B", 1),
    ]


def test_heading_paths(spark):
    text = "## Title\n\n## 5. Playbooks\n\n## PB-01\n\nfirst\n\n## 5.1 Deep\n\nsecond\n\n## Appendix\n\nthird\n\n## Label:\n\nfourth"
    assert [c[3] for c in chunks_of(spark, "s", [(1, text)])] == ["5. Playbooks > PB-01", "5. Playbooks > 5.1 Deep", "5. Playbooks > Appendix"]
    assert [c[3] for c in chunks_of(spark, "s", [(1, "# A\n\n### B\n\nx\n\n## C\n\ny")])] == ["A > B", "A > C"]


@pytest.mark.parametrize(
    "text",
    [
        " ".join(f"Sentence number {i} has a few words." for i in range(80)),
        "| a | b |\n|---|---|\n" + "\n".join(f"| row {i} | value {i} |" for i in range(150)),
        "\n".join(f"- item {i} with words" for i in range(150)),
        " ".join(f"w{i}" for i in range(3000)),
    ],
)
def test_long_blocks_lose_nothing(spark, text):
    out = chunks_of(spark, "doc", [(3, text)])
    assert len(out) > 1 and all(c[6] <= DEFAULT.chunk_tokens for c in out) and [c[1] for c in out] == list(range(len(out)))
    held = {w for c in out for w in c[2].split()}
    assert set(text.split()) <= held and {c[4] for c in out} == {3}
    if text.startswith("|"):
        assert all("|---|---|" in c[2] for c in out)
    if text.startswith("Sentence"):
        assert out[1][2].split("\n")[1].split(". ")[0] in out[0][2]


def test_runs_of_sentences_against_a_plain_walk():
    import random

    rng, count = random.Random(6), lambda t: len(t.split())
    for _ in range(300):
        units = [" ".join(["w"] * rng.randrange(1, 7)) + "." for _ in range(rng.randrange(1, 12))]
        budget, overlap = rng.randrange(6, 14), rng.randrange(0, 9)
        size = [count(u) for u in units]
        spans, a = [], 0
        for b in range(1, len(units)):
            if sum(size[a : b + 1]) > budget and a < b:
                spans.append((a, b))
                a = min(k for k in range(a, b + 1) if sum(size[k:b]) <= overlap)
                a = a if sum(size[a : b + 1]) <= budget else b
        runs = [units[x:y] for x, y in [*spans, (a, len(units))]]
        assert chunk.sentences_grouped(" ".join(units), budget, overlap, count) == [" ".join(r) for r in runs]


def test_chunked_frame_and_packing(spark):
    pages = spark.createDataFrame([("b", 2, "two"), ("b", 1, "# One\n\none"), ("n", None, "x"), ("e", None, None)], "source string, number int, markdown string")
    got = sorted((r.source, r.text, r.page_start, r.page_end) for r in chunk.chunked(pages).collect())
    assert got == [("b", "[b > One]\none\n\ntwo", 1, 2), ("n", "[n]\nx", None, None)]
    sizes = [3, 4, 9, 1, 1, 1]
    by_column = spark.createDataFrame([(sizes,)], "s array<int>").select(chunk.greedy_groups(F.col("s"), lambda x: x, 9).alias("g")).first().g
    flat = [g for g, items in enumerate(chunk.grouped(sizes, sizes, 9)) for _ in items]
    assert by_column == flat == [0, 0, 1, 2, 2, 2]


# --- index


def test_sync_scenarios(spark, tmp_path):
    folder, path = tmp_path / "docs", f"file://{tmp_path}/index"
    folder.mkdir()
    three = "# 1. A\n\naaa\n\n# 2. B\n\nbbb\n\n# 3. C\n\nccc"
    (folder / "a.txt").write_text(three)
    (folder / "b.txt").write_text("bbb")
    (folder / "~$a.txt").write_text("lock")
    (folder / "old.doc").write_text("x")
    labels = spark.createDataFrame([("a.txt", "internal", "active", None, None)], catalog.SCHEMA)

    def build(changed):
        return chunk.chunked(sources.read_text_pages(changed))

    def run(dry=False, labels=labels):
        found = sources.listed(spark, f"file://{folder}").where("status = 'supported'")
        plan = {r.source: r.action for r in index.sync(spark, found, labels, path, build, dry).collect()}
        stored = index.read_index(spark, path)
        return plan, sorted((r.source, r.chunk_index) for r in stored.collect()) if stored is not None else []

    assert run(True) == ({"a.txt": "would index", "b.txt": "would index"}, [])
    assert run() == ({"a.txt": "index", "b.txt": "index"}, [("a.txt", 0), ("a.txt", 1), ("a.txt", 2), ("b.txt", 0)])
    assert run()[0] == {"a.txt": "unchanged", "b.txt": "unchanged"}
    (folder / "a.txt").write_text("# 1. A\n\naaa")
    assert run() == ({"a.txt": "index", "b.txt": "unchanged"}, [("a.txt", 0), ("b.txt", 0)])
    relabelled = spark.createDataFrame([("a.txt", "restricted", "active", None, None)], catalog.SCHEMA)
    assert run(labels=relabelled)[0] == {"a.txt": "index", "b.txt": "unchanged"}
    (folder / "b.txt").unlink()
    assert run(True, relabelled)[0]["b.txt"] == "would remove"
    assert run(labels=relabelled)[1] == [("a.txt", 0)]
    (folder / "a.txt").unlink()
    with pytest.raises(index.SyncError):
        run()
    assert index.read_index(spark, path).count() == 1


def test_files_and_cache(spark, tmp_path):
    for name, data in (("a.md", b"x"), ("B.PDF", b"%"), ("c.doc", b"c"), ("d.zip", b"d"), (".hid", b"h"), ("Thumbs.db", b"t"), ("e.csv", b"\xff\x81")):
        (tmp_path / name).write_bytes(data)
    listed = sources.listed(spark, f"file://{tmp_path}")
    assert {r.source: r.status for r in listed.collect()} == {"a.md": "supported", "B.PDF": "supported", "c.doc": "old format .doc: save it anew", "d.zip": "unsupported format .zip", "e.csv": "supported"}
    calls = []

    def parse(files):
        calls.append(sorted(r.source for r in files.collect()))
        return sources.read_text_pages(files)

    text = listed.where("source in ('a.md', 'e.csv')")
    pages, cache = sources.read_cached(text, None, 1, parse)
    assert {r.source: r.error for r in pages.collect()} == {"a.md": None, "e.csv": "none of the known encodings fits"}
    again, new = sources.read_cached(text, cache, 1, parse)
    assert calls == [["a.md", "e.csv"], []] and again.count() == 2 and new.count() == 0
    assert sources.read_cached(text, cache, 2, parse)[1].count() == 2
    warned = sources.warnings(pages.withColumn("ocr", F.col("source") == "a.md"))
    assert {(r.source, r.warning) for r in warned.collect()} == {("a.md", "hardly any text"), ("a.md", "1 pages read by OCR"), ("e.csv", "hardly any text")}


# --- evaluation and logs


def test_status_rules(spark):
    base = {"leaks": [], "missing": [], "not_indexed": [], "phrase_problems": [], "source_rank": 1, "answerable": True, "off_topic": False, "hits": 3, "verdict": None, "rejected": False}
    cases = [({}, "pass", ""), ({"leaks": ["x"], "verdict": "correct"}, "fail", "LEAK"), ({"off_topic": True}, "fail", "not stopped"), ({"verdict": "partial"}, "partial", "generation"), ({"verdict": "wrong", "source_rank": None}, "fail", "retrieval"),
             ({"phrase_problems": ["p"], "not_indexed": ["e"]}, "fail", "reading"), ({"phrase_problems": ["p"], "answerable": False}, "fail", "made up an answer"), ({"rejected": True}, "fail", "rejected"), ({"phrase_problems": ["p"], "missing": ["m"]}, "fail", "retrieval")]
    kind = "leaks array<string>, missing array<string>, not_indexed array<string>, phrase_problems array<string>, source_rank int, answerable boolean, off_topic boolean, hits int, verdict string, rejected boolean"
    df = spark.createDataFrame([tuple((base | c).values()) for c, _, _ in cases], kind)
    s, d, _ = evaluate.answer_status({c: F.col(c) for c in df.columns})
    assert [(r[0], r[1]) for r in df.select(s, d).collect()] == [(a, b) for _, a, b in cases]


def test_evidence_leaks_and_ranks(spark):
    hits = spark.createDataFrame([(1, 1, "a", "22 gündür", "internal"), (1, 2, "b", "gizli maaş 5", "restricted")], "question_id int, rank int, source string, text string, access_level string")
    asked = spark.createDataFrame([(1, "employee", ["b"], [["22 gün", "x"], ["maaş"], ["yok", "hiç"]], ["gizli"]), (2, "employee", ["a"], [["z"]], [])], "question_id int, role string, sources array<string>, evidence array<array<string>>, forbidden array<string>")
    roles = spark.createDataFrame([("employee", ["internal"])], "role string, access_levels array<string>")
    assert {r.question_id: r.source_rank for r in evaluate.source_rank(hits, asked).collect()} == {1: 2, 2: None}
    assert {r.question_id: r.missing for r in evaluate.missing_evidence(hits, asked).collect()} == {1: ["yok / hiç"], 2: ["z"]}
    assert {r.leak for r in evaluate.leaks(hits, asked, roles).collect()} == {"b (restricted)", "'gizli' in b"}
    one = asked.withColumn("evidence", F.array(F.array(F.lit("maaş"))))
    assert {r.question_id: r.answer_rank for r in evaluate.first_answer_rank(hits, one).collect()} == {1: 2}


def test_answer_problems(spark):
    df = spark.createDataFrame([("Says 22 gün [7]", ["22 gün", "maaş"], ["a", "b"], ["gün"])], "a string, m array<string>, o array<string>, n array<string>")
    assert df.select(evaluate.phrase_problems(F.col("a"), F.col("m"), F.col("o"), F.col("n"), F.lit(True)).alias("p")).first().p == ["missing maaş", "none of a, b", "contains gün"]
    shown = F.array(F.lit("x"), F.lit("y"))
    say = lambda answer, ok=True: spark.range(1).select(evaluate.citation_problems(F.lit(answer), shown, F.array(F.lit("y")), F.lit(ok), F.lit(True)).alias("p")).first().p
    assert say("a [2]") == [] and say("a") == ["no citation"] and say("a [1]") == ["cites none of the expected files"]
    assert say("a [9]") == ["not in the source list: 9", "no citation"] and say("a [2]", False) == ["not marked as not found"] and say("[NOT_FOUND]", False) == []


def test_empty_run_has_zeros(spark):
    kind = "answerable boolean, evidence_total int, missing array<string>, source_rank int, phrase_problems array<string>, citation_problems array<string>, invalid_citations array<int>, citations array<int>, unverified array<string>, leaks array<string>, verdict string, disagreement boolean, answered_by string, known_gap string, off_topic boolean, hits int, retrieval_ms double, llm_ms double, input_tokens long, output_tokens long, status string"
    row = evaluate.summarize(spark.createDataFrame([], kind)).first()
    assert len(row) == 33 and all(v == 0 for k, v in row.asDict().items() if k != "top_k")


def test_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(datetime.datetime(2024, 1, 2), "u", "q "), (datetime.datetime(2024, 2, 2), "v", "q")], "time timestamp_ntz, user string, question string")
    full = rows.select(*(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], logs.SCHEMA).schema))
    sources.append_log(full, path)
    (tmp_path / "log" / "month=2024-02" / "broken.json").write_text("{not json\n\n")
    assert sources.read_log(spark, path).count() == 2 and sources.read_log(spark, path, "2024-02").count() == 1
    assert logs.gaps(sources.read_log(spark, path).drop("month")).collect()[0].times == 2


def test_runs_are_never_overwritten(spark, tmp_path):
    df = spark.createDataFrame([(1, "pass")], "question_id int, status string")
    sources.save_run(df, str(tmp_path), "one")
    with pytest.raises(Exception, match="already exists"):
        sources.save_run(df, str(tmp_path), "one")
    sources.save_run(df, str(tmp_path), "two")
    assert set(sources.newest_runs(spark, str(tmp_path))) == {"one", "two"}


def test_plugins(spark):
    df = spark.createDataFrame([("leave days", ["Leave is 20 days. More."]), ("x", [])], "q string, s array<string>")
    assert [r.a for r in df.select(extractive_generator(F.col("q"), F.col("s")).alias("a")).collect()] == ["Leave is 20 days. [1]", "[NOT_FOUND]"]
    assert df.select(overlap_reranker(F.col("q"), F.lit("days off")).alias("x")).first().x == 0.5
    assert count_words(" a  b ") == 2
    assert [r.r for r in spark.createDataFrame([(["internal"],), (["restricted"],)], "l array<string>").select(routed(F.col("l"), DEFAULT.local_only).alias("r")).collect()] == ["any", "local"]


def test_table_files_are_read_once(spark):
    files = [(f"{i}.csv", f"Key;Name\n{i};x\n;y".encode()) for i in range(3)] + [("empty.csv", b"")]
    cells = tabular.cells_of_files(spark.createDataFrame(files, "source string, content binary"))
    found = tabular.grid_markdown(cells.unionByName(spark.createDataFrame([("n", "n", "T", 1, 1, "", None)], cells.schema)))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert {r.table: r.markdown for r in found.collect()} == {**{f"{i}.csv": f"Key: {i} | Name: x\n\ny" for i in range(3)}, "n": ""}


def test_files_share_frames(spark, monkeypatch):
    monkeypatch.setattr(tabular, "FRAME_ROWS", 3)
    made = []
    frame = tabular.pd.DataFrame
    monkeypatch.setattr(tabular.pd, "DataFrame", lambda rows, **k: made.append(len(rows)) or frame(rows, **k))

    class Files:
        sparkSession = spark

        def select(self, *names):
            return self

        def mapInPandas(self, run, shape):
            return list(run(iter([frame({"source": [f"{i}.csv" for i in range(4)], "content": [b"a;b"] * 4})])))

    assert sum(map(len, tabular.cells_of_files(Files()))) == 8 and made == [4, 4]


def test_an_answer_is_normalized_once(spark):
    some = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    assert str(evaluate.phrase_problems(F.col("said_so"), some, some, some, F.lit(True))).count("said_so") == 1


def test_pages_are_cut_once(spark):
    pages = spark.createDataFrame([("f", 1, "# A\n\ntext\n\n# B\n\nmore")], "source string, number int, markdown string")
    found = chunk.sections(chunk.blocks(pages))
    assert "markdown" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.path for r in found.collect()) == [["A"], ["B"]]
