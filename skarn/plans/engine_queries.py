"""Reading, storing, checking and answering: operators of the engine over whole tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.functions.citations import shortened, unverified
from skarn.functions.text import page_label, rewritten, sigmoid, verdict, without_thoughts
from skarn.operators import answer, chunk, delimited, index, logs, search, segments, tabular
from skarn.operators import evaluate as V
from skarn.operators.catalog import labelled
from skarn.plans.common import ASKED_SQL, LABELS_SQL, POSTINGS_SQL, catalog, documents, questions, roles, sparse_sql, spread, stored, tokens_sql
from skarn.plans.evaluation_queries import _HELD, _NORM, _log
from skarn.plans.search_queries import _sparse
from skarn.plugins import overlap_reranker, routed
from skarn.runtime import goes_with_session, shared_path, table
from skarn.settings import DEFAULT
from skarn.sources import files as sources
from skarn.sources.config import is_admin

_EXT = ("md", "PDF", "txt", "xls", "doc", "exe", "csv", "tar.gz")


def _named(spark, sf_dir: str) -> DataFrame:
    """Documents as files: a name with one of eight endings, the text as its bytes, and their hash."""
    d = documents(spark, sf_dir)
    ending = F.element_at(F.array(*map(F.lit, _EXT)), (F.col("doc_id") % len(_EXT) + 1).cast("int"))
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return d.select("doc_id", F.concat(F.lit("file "), F.col("doc_id").cast("string"), F.lit("."), ending).alias("source"), content.alias("content"), F.sha2(content, 256).alias("file_hash"))


def file_support(spark, sf_dir: str) -> DataFrame:
    """Which files can be read, and why others are skipped."""
    return _named(spark, sf_dir).select("doc_id", sources.support(F.col("source")).alias("status"))


def parsed_documents(spark, sf_dir: str) -> DataFrame:
    """Every document parsed as a text file: once without a cache and once from the cache that this has made; what the
    second pass parses anew is counted."""
    named = spread(_named(spark, sf_dir))
    pages, new = sources.read_cached(named.select("source", "content", "file_hash"), None, 1, sources.read_text_pages)
    again, missed = sources.read_cached(named.select("source", "content", "file_hash"), new, 1, sources.read_text_pages)
    both = pages.select("source", F.sha2(F.col("markdown").cast("binary"), 256).alias("first")).join(again.select("source", F.sha2(F.col("markdown").cast("binary"), 256).alias("second"), "error").distinct(), "source")
    return both.crossJoin(missed.agg(F.count("*").alias("parsed_again")))


def reading_warnings(spark, sf_dir: str) -> DataFrame:
    """Documents of hardly any text, and those of which pages came from OCR."""
    pages = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source"), F.col("text").alias("markdown"), (F.col("doc_id") % 10 == 3).alias("ocr"))
    return sources.warnings(pages)


def ocr_pages(spark, sf_dir: str) -> DataFrame:
    """Pages whose text layer holds hardly anything: the first words of each document, as many as its id allows."""
    layer = F.substring(F.coalesce("text", F.lit("")), 1, (F.col("doc_id") % 40).cast("int"))
    return documents(spark, sf_dir).select("doc_id", sources.needs_ocr(layer).alias("needs_ocr"))


def inspection_pages(spark, sf_dir: str) -> DataFrame:
    """Every document as people read it in a dump."""
    pages = documents(spark, sf_dir).select("source", F.col("doc_id").alias("number"), F.col("text").alias("markdown"))
    return sources.inspection_text(pages).select(F.sha2(F.col("value").cast("binary"), 256).alias("digest"))


def table_files(spark, sf_dir: str) -> DataFrame:
    """Customers as delimited files of three lines, read, sniffed and written as records."""
    c = table(spark, sf_dir, "customer")
    by = F.element_at(F.array(F.lit(";"), F.lit(","), F.lit("\t"), F.lit("|")), (F.col("c_custkey") % 4 + 1).cast("int"))
    key = F.col("c_custkey").cast("string")
    line = lambda x, y, z: F.concat(x, by, y, by, z)
    text = F.concat_ws("\n", line(F.lit("Key"), F.lit("Name"), F.lit("Segment")), line(key, F.col("c_name"), F.concat(F.lit('"'), "c_mktsegment", by, F.lit('part"'))), line(key, F.lit(""), F.lit("x")))
    cells = tabular.cells_of_files(spread(c.select(F.concat(key, F.lit(".csv")).alias("source"), F.encode(text, "UTF-8").alias("content"))))
    return tabular.grid_markdown(cells).select("table", "markdown")


def sheet_numbers(spark, sf_dir: str) -> DataFrame:
    """Prices of all lines as a spreadsheet shows them under four formats."""
    formats = F.array(F.lit("General"), F.lit('#,##0.00 "TL"'), F.lit("0.0%"), F.lit("[$€-407]#,##0;-0"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.element_at(formats, (F.col("l_linenumber") % 4 + 1).cast("int")).alias("pattern"))
    return tabular.numbers_as_text(lines, "quantity", "pattern").select("l_orderkey", "l_linenumber", "shown")


def delimited_splits(spark, sf_dir: str) -> DataFrame:
    """Order lines written as delimited files with line breaks and quotes in their values, and read again in parts of 256 KB
    wherever those fall: the rows of each first value, and a sum over all others."""
    path = shared_path(spark, "delimited")
    l = table(spark, sf_dir, "lineitem")
    note = F.concat(F.lit('"'), F.when(F.col("l_linenumber") % 3 == 0, F.lit('say ""so"";\n')).otherwise(F.lit("")), F.col("l_linestatus"), F.when(F.col("l_linenumber") % 2 == 0, F.lit("\n;;\n\n")).otherwise(F.lit("")), F.lit('"'))
    l.select(F.concat_ws(";", F.col("l_returnflag"), F.col("l_orderkey").cast("string"), note, F.col("l_linenumber").cast("string"))).write.text(path)
    goes_with_session(spark, path)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "262144")
    try:
        found = delimited.rows(spark, path)
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    v = lambda i: F.get("values", i)
    return found.groupBy(v(0).alias("flag")).agg(F.count("*").alias("n"), F.sum(v(1).cast("long")).alias("orders"), F.sum(v(3).cast("long")).alias("lines"), F.sum(F.length(v(2))).alias("chars"), F.count_if(F.size("values") != 4).alias("broken"))


def stored_log(spark, sf_dir: str) -> DataFrame:
    """Events appended to a question log by month and read back, a row for each month."""
    path = shared_path(spark, "log")
    rows = _log(spark, sf_dir).select("time", "user", "question", "llm_asked", "not_found", "retrieval_ms", "error")
    sources.append_log(rows.withColumn("time", F.col("time").cast("timestamp_ntz")), path)
    goes_with_session(spark, path)
    log = sources.read_log(spark, path)
    return log.groupBy("month").agg(F.count("*").alias("rows"), F.round(F.sum("retrieval_ms"), 2).alias("retrieval_ms"), F.count("error").alias("errors"), F.count_distinct("user").alias("users"))


def stored_runs(spark, sf_dir: str) -> DataFrame:
    """Two stored runs over the labels, the newest first, compared."""
    path = shared_path(spark, "runs")
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("question_id"), "quality", "toxic")
    sources.save_run(rows.select("question_id", F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("status")), path, "1")
    sources.save_run(rows.select("question_id", F.when(F.col("toxic") == 1, "fail").when(F.col("quality") == 1, "pass").otherwise("partial").alias("status")), path, "2")
    goes_with_session(spark, path)
    new, old = (spark.read.parquet(f"{path}/run_id={r}") for r in sources.newest_runs(spark, path))
    return V.compared(old, new).groupBy("change").agg(F.count("*").alias("n"))


def rescored_runs(spark, sf_dir: str) -> DataFrame:
    """Saved results of all labels under the rules of the questions that are left: those of the documents in English."""
    none = F.expr("cast(array() as array<string>)")
    saved = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("question_id"), F.lit("old").alias("type"), "quality")
    left = documents(spark, sf_dir).where("lang = 'en'").select(F.col("doc_id").alias("question_id"), F.col("source").alias("type"), F.lit("intern").alias("role"), F.lit(True).alias("answerable"), F.lit(False).alias("off_topic"), *(none.alias(c) for c in ("must_include", "any_of", "must_not", "sources")))
    kept, gone = V.rescored(saved, left)
    return kept.groupBy("type").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("good")).unionByName(gone.groupBy(F.lit("gone").alias("type")).agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("good")))


def synced_index(spark, sf_dir: str) -> DataFrame:
    """The index after two syncs: all documents, each source a file, then without src0 and with src1 changed."""
    path = shared_path(spark, "synced")
    docs = documents(spark, sf_dir)
    file = lambda d: d.groupBy("source").agg(F.sum(F.xxhash64("doc_id", "text").cast("decimal(38,0)")).cast("string").alias("file_hash"))
    rows = lambda d: lambda changed: d.join(changed.select("source"), "source").select("source", F.col("doc_id").cast("int").alias("chunk_index"), "text")
    first = index.sync(spark, file(docs), catalog(spark), path, rows(docs))
    goes_with_session(spark, path)
    then = docs.where("source <> 'src0'").withColumn("text", F.when(F.col("source") == "src1", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    second = index.sync(spark, file(then), catalog(spark), path, rows(then))
    left = index.read_index(spark, path).groupBy("source").agg(F.count("*").alias("chunks"), F.count_distinct("point_id").alias("points"), F.sum(F.length("text")).cast("long").alias("chars"))
    actions = first.select("source", F.col("action").alias("first_action")).join(second.select("source", F.col("action").alias("second_action")), "source", "full_outer")
    return actions.join(left, "source", "left")


def segmented_index(spark, sf_dir: str) -> DataFrame:
    """The index after three syncs (all; then without src0 and with src1 changed; then with src2 changed, too), by source:
    documents, postings, words and weights as they are searched, and what a reader from before the second sync sees."""
    path = shared_path(spark, "segmented")
    file = lambda d: d.groupBy("source").agg(F.sum(F.xxhash64("doc_id", "text").cast("decimal(38,0)")).cast("string").alias("file_hash"))
    rows = lambda d: lambda changed: d.join(changed.select("source"), "source").select("source", F.col("doc_id").cast("int").alias("chunk_index"), "text")
    docs, first = documents(spark, sf_dir).select("doc_id", "source", "text"), None
    for k in range(3):
        more = F.concat("text", F.lit(" zzadded"))
        now = docs.where(F.lit(k == 0) | (F.col("source") != "src0")).withColumn("text", F.when(F.col("source").isin(*(f"src{i}" for i in range(1, k + 1))), more).otherwise(F.col("text")))
        index.sync(spark, file(now), catalog(spark), path, rows(now))
        first = first or segments.read(spark, path)
    goes_with_session(spark, path)
    last = segments.read(spark, path)
    each = last.table("postings").select("shard", F.explode(F.arrays_zip("docs", "tfs", "weights")).alias("x"))
    # Summed by document before they meet them, and merged: Spark takes a list of postings for one, and would broadcast them all.
    # Weights have four places; as whole numbers their sum is exact, so halves always round up.
    held = each.groupBy("shard", F.col("x.docs").alias("place")).agg(F.count("*").alias("postings"), F.sum("x.tfs").alias("words"), F.sum(F.round(F.col("x.weights") * 10_000).cast("long")).alias("weight"))
    own = last.docs.select("shard", "place", "source").join(held.hint("merge"), ["shard", "place"], "left").groupBy("source")
    own = own.agg(F.count("*").alias("docs"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("postings", "words")), F.round(F.coalesce(F.sum("weight"), F.lit(0)) / 10_000, 2).alias("weight"))
    before = first.docs.groupBy("source").agg(F.count("*").alias("old_docs"))
    total = last.rarity.agg(F.count("*").alias("terms"), F.sum("df").alias("df"))
    return before.join(own, "source", "full_outer").crossJoin(total).withColumns({"texts": F.lit(last.size).cast("long"), "segments": F.lit(len(last.segments)).cast("long")})


def point_ids(spark, sf_dir: str) -> DataFrame:
    """The id under which every document is stored."""
    return documents(spark, sf_dir).select("doc_id", index.point_id(F.sha2("source", 256), F.col("doc_id")).alias("point_id"))


# --- searching and answering


def _hits(spark, sf_dir: str) -> DataFrame:
    """The 20 hits of every question with their documents."""
    return _sparse(spark, sf_dir).join(labelled(documents(spark, sf_dir).select("doc_id", "source", "text"), catalog(spark)), "doc_id")


def search_reranked(spark, sf_dir: str) -> DataFrame:
    """The whole search of every benchmark item: candidates that may be seen, reranked, cut at the threshold and at five."""
    docs = labelled(documents(spark, sf_dir).select("doc_id", "source", "text"), catalog(spark))
    asked = questions(spark, sf_dir)
    found = search.search(asked, docs, ("internal",), mode="sparse", reranker=overlap_reranker, stored=stored(spark, sf_dir))
    return found.select("question_id", "doc_id", "score", "rank", "old_rank")


def missing_facts(spark, sf_dir: str) -> DataFrame:
    """Of three facts for each question (its text, its text or a phrase that nothing holds, that phrase alone), those that
    none of its hits holds."""
    never = F.lit("qx zz no text says this")
    asked = questions(spark, sf_dir).select("question_id", F.array(F.array("text"), F.array(never, F.col("text")), F.array(never)).alias("evidence"))
    found = V.missing_evidence(_hits(spark, sf_dir).select("question_id", "text"), asked)
    return found.select("question_id", "evidence_total", F.size("missing").alias("n_missing"), F.sha2(F.array_join("missing", "|"), 256).alias("missing"))


def answer_ranks(spark, sf_dir: str) -> DataFrame:
    """The first hit that holds a question's whole text by itself."""
    asked = questions(spark, sf_dir).select("question_id", F.array(F.array("text")).alias("evidence"))
    return V.first_answer_rank(_hits(spark, sf_dir).select("question_id", "rank", "text"), asked)


def source_ranks(spark, sf_dir: str) -> DataFrame:
    """The first rank at which src5 or src6 was found."""
    asked = questions(spark, sf_dir).select("question_id", F.array(F.lit("src5"), F.lit("src6")).alias("sources"))
    return V.source_rank(_hits(spark, sf_dir).select("question_id", "rank", "source"), asked)


def answer_routes(spark, sf_dir: str) -> DataFrame:
    """Where each question may be answered, by the levels of all its hits."""
    levels = _hits(spark, sf_dir).groupBy("question_id").agg(F.collect_set("access_level").alias("levels"))
    return levels.select("question_id", routed(F.col("levels"), DEFAULT.local_only).alias("route"))


def leaked_hits(spark, sf_dir: str) -> DataFrame:
    """Hits of every question that an intern may not see."""
    asked = questions(spark, sf_dir).select("question_id", F.lit("intern").alias("role"), F.expr("cast(array() as array<string>)").alias("forbidden"))
    found = V.leaks(_hits(spark, sf_dir).select("question_id", "source", "text", "access_level"), asked, roles(spark))
    return found.groupBy("question_id").agg(F.count("*").alias("leaks"))


def source_headers(spark, sf_dir: str) -> DataFrame:
    """Every document as the numbered source of a prompt."""
    d = labelled(documents(spark, sf_dir).select("doc_id", "source", "text"), catalog(spark))
    n = F.col("doc_id")
    made = F.struct(
        "source", F.col("text"), F.when(n % 2 == 0, F.lit("A > B")).otherwise("").alias("heading_path"), F.when(n % 3 > 0, n).cast("int").alias("page_start"), F.when(n % 3 > 0, n + n % 3 - 1).cast("int").alias("page_end"),
        "status", "effective_date", "replaced_by", (n % 7 == 0).alias("ocr"),
    )
    said = answer.prompt(F.lit("Why?"), F.array(made))
    return d.select("doc_id", answer.source_header(F.lit(1), made).alias("header"), page_label(made["page_start"], made["page_end"]).alias("pages"), F.sha2(said.cast("binary"), 256).alias("prompt"))


def generated_answers(spark, sf_dir: str) -> DataFrame:
    """Every document asked about, with a provider that is busy, one that answers and one inside the house."""
    return answer.generated(spread(documents(spark, sf_dir).select("doc_id", F.concat(F.lit("About "), F.col("source")).alias("prompt"), (F.col("doc_id") % 4 == 0).alias("local_only"))), _PROVIDERS, attempts=2, first_wait=0.0).select("doc_id", "reply", "provider", F.array_join("passed", "; ").alias("passed"), "error")


def journaled_answers(spark, sf_dir: str) -> DataFrame:
    """The same by way of a journal: each different prompt is asked once, by four lanes, and the second run asks no one."""
    asked = spread(documents(spark, sf_dir).select("doc_id", F.concat(F.lit("About "), F.col("source")).alias("prompt"), (F.col("doc_id") % 4 == 0).alias("local_only")))
    path = shared_path(spark, "journal")
    answer.generated(asked, _PROVIDERS, attempts=2, first_wait=0.0, journal=path, lanes=4).write.format("noop").mode("overwrite").save()
    goes_with_session(spark, path)
    nobody = [answer.Provider(p.name, _gone, p.local) for p in _PROVIDERS]
    return answer.generated(asked, nobody, attempts=1, journal=path, lanes=4).select("doc_id", "reply", "provider", F.array_join("passed", "; ").alias("passed"), "error")


def _gone(messages: list[dict]) -> str:
    raise ValueError("nobody should be asked")


def _busy(messages: list[dict]) -> str:
    raise answer.Unavailable("busy")


_PROVIDERS = [answer.Provider("busy", _busy), answer.Provider("cloud", lambda m: m[0]["content"].upper()), answer.Provider("house", lambda m: m[0]["content"].lower(), True)]


def standalone_questions(spark, sf_dir: str) -> DataFrame:
    """Every user question as it is searched: a later one in the rewriter's words."""
    turns = logs.with_history(table(spark, sf_dir, "conversations"))
    found = answer.standalone(turns, lambda prompt: F.concat(F.lit('\nQuestion: "and then after that?"\n'), prompt))
    return found.select("conv_id", "turn", F.sha2(F.col("searched_as").cast("binary"), 256).alias("searched_as"))


# --- replies and checks


def model_replies(spark, sf_dir: str) -> DataFrame:
    """Replies made of every turn: thoughts are dropped, the first line is taken, and a verdict is read."""
    t, n = F.coalesce("text", F.lit("")), F.col("turn")
    words = F.regexp_replace(t, r"[^a-z]", "")
    thought = F.concat(F.lit("<THINK>"), t, F.when(n % 3 == 0, "").otherwise("</think>"), F.lit(" so "), words)
    said = F.concat(F.lit("Here: {"), F.lit('"verdict": "'), F.element_at(F.array(*map(F.lit, ("correct", "Partial", "maybe"))), (n % 3 + 1).cast("int")), F.lit('", "reason": "r'), n.cast("string"), F.lit('"} end'))
    line = F.concat(F.lit("\n Question: 'w"), words, F.lit("'\nx"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(without_thoughts(thought).cast("binary"), 256).alias("clean"), verdict(said)["verdict"].alias("verdict"), verdict(said)["reason"].alias("reason"), F.length(rewritten(line, F.lit("q"))).alias("rewritten"))


def judged_answers(spark, sf_dir: str) -> DataFrame:
    """Every turn judged by a judge that compares lengths; one reply in five is no verdict."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit("q").alias("question"), F.col("role").alias("expected"), F.when(F.col("turn") != 1, F.col("text")).alias("answer"))
    judge = lambda prompt: F.when(F.length(prompt) % 5 == 0, "no idea").otherwise(F.concat(F.lit('{"verdict": "'), F.when(F.length(prompt) % 2 == 0, "correct").otherwise("wrong"), F.lit('", "reason": "even or odd"}')))
    return V.judged(t, judge).groupBy("verdict", "judge_failed", "reason").agg(F.count("*").alias("n"))


def phrase_checks(spark, sf_dir: str) -> DataFrame:
    """Every text held against phrases it must hold, of which it must hold one, and that it must not hold."""
    a = lambda *x: F.array(*map(F.lit, x))
    found = V.phrase_problems(F.col("text"), a("the", "de"), a("und", "and", "pour"), a("license", "la"), F.col("doc_id") % 2 == 0)
    return spread(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.array_join(found, "; ").alias("problems"))


def citation_checks(spark, sf_dir: str) -> DataFrame:
    """Answers to every turn that cite the source of their conversation's number."""
    n, turn = F.col("conv_id") % 6, F.col("turn")
    said = F.when(n == 5, "Not there [NOT_FOUND]").otherwise(F.concat(F.lit("It is so ["), n.cast("string"), F.lit("].")))
    found = V.citation_problems(said, F.array(*map(F.lit, "abc")), F.array(F.lit("b")), turn % 3 > 0, F.col("role") == "assistant")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(found, "; ").alias("problems"))


def _made_results(spark, sf_dir: str) -> DataFrame:
    """Results of questions made of the ids of all documents."""
    n = F.col("doc_id")
    some = lambda c: F.when(c, F.array(F.lit("x"))).otherwise(F.expr("cast(array() as array<string>)"))
    return documents(spark, sf_dir).select(
        "doc_id", some(n % 31 == 0).alias("leaks"), some(n % 5 == 0).alias("missing"), some(n % 7 == 0).alias("not_indexed"), F.when(n % 3 > 0, n % 3).alias("source_rank"), (n % 4 > 0).alias("answerable"), (n % 28 == 4).alias("off_topic"),
        (n % 6).alias("hits"), some(n % 2 == 0).alias("phrase_problems"), F.when(n % 11 == 1, "correct").when(n % 11 == 2, "partial").when(n % 11 == 3, "wrong").alias("verdict"), (n % 53 == 0).alias("rejected"),
        F.when(n % 13 == 0, F.array(F.lit("internal"), F.lit("restricted"))).otherwise(F.array(F.lit("internal"))).alias("levels"), F.when(n % 3 == 0, "cloud").when(n % 3 == 1, "house").alias("answered_by"), F.when(n % 2 == 0, "judge").alias("judged_by"),
    )


def status_rules(spark, sf_dir: str) -> DataFrame:
    """Status and diagnosis of results, for searches and for answers."""
    rows = _made_results(spark, sf_dir)
    r = {c: F.col(c) for c in rows.columns}
    (found, why), (status, diagnosis, disagreement) = V.retrieval_status(r), V.answer_status(r)
    return rows.select("doc_id", found.alias("found"), why.alias("why"), status.alias("status"), diagnosis.alias("diagnosis"), disagreement.alias("disagreement"))


def confidential_checks(spark, sf_dir: str) -> DataFrame:
    """Results whose confidential sources went to a model outside the house."""
    rows = _made_results(spark, sf_dir)
    found = V.confidential_problems({c: F.col(c) for c in rows.columns}, ("house",))
    return rows.select("doc_id", F.array_join(found, "; ").alias("problems")).where("problems <> ''")


def ingestion_checks(spark, sf_dir: str) -> DataFrame:
    """How many documents hold each of four expectations, anywhere in a word or by a pattern."""
    expected = spark.createDataFrame([("LICENSE",), ("ion de",), ("re:[0-9]{3}-[0-9]{4}",), ("re:^The",)], "expected string")
    rows = spread(documents(spark, sf_dir).select("doc_id", "text")).join(F.broadcast(expected))
    return rows.groupBy("expected").agg(F.count_if(V.ingested(F.col("text"), F.col("expected"))).alias("documents"))


def verify_facts(spark, sf_dir: str) -> DataFrame:
    """Numbers of answers made for every turn that their first source lacks, and where they stand."""
    n, turn = F.col("conv_id"), F.col("turn")
    say = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    held = F.array(say("They get ", n + turn % 3, " days."), say("Others get ", n, " days, or ", n + 1000, "."))
    found = unverified(say("It is ", n, " days [1]."), held, say("And ", turn, "?"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(found).alias("u"))
    return rows.select("conv_id", "turn", "u.fact", V.unverified_label(F.col("u")).alias("label"))


def excerpts(spark, sf_dir: str) -> DataFrame:
    """Every text cut to 80 characters after a word."""
    return documents(spark, sf_dir).select("doc_id", shortened(F.col("text"), 80).alias("excerpt"))


def logistic_scores(spark, sf_dir: str) -> DataFrame:
    """The logistic function of the discounts of all lines."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(sigmoid((F.col("l_discount") - 0.05) * 100), 9).alias("score"))


def admin_counts(spark, sf_dir: str) -> DataFrame:
    """Customers as users with roles: how many of each segment may manage the index."""
    names = list(DEFAULT.roles)
    role = F.element_at(F.array(*map(F.lit, names)), (F.col("c_custkey") % len(names) + 1).cast("int"))
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count_if(is_admin(role)).alias("admins"), F.count("*").alias("users"))


def chunk_checks(spark, sf_dir: str) -> DataFrame:
    """What must hold of the chunks of every document: words that are lost, numbers that are skipped, chunks over budget, and
    chunks without their first line."""
    docs = spread(documents(spark, sf_dir).select("doc_id", "text"))
    made = chunk.chunked(docs.select(F.col("doc_id").cast("string").alias("source"), F.lit(None).cast("int").alias("number"), F.col("text").alias("markdown")))
    word = lambda c: F.regexp_extract_all(c, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    body = F.regexp_replace("text", r"^\[[^\n]*\]\n", "")
    by_doc = made.groupBy(F.col("source").cast("long").alias("doc_id")).agg(
        F.array_distinct(F.flatten(F.collect_list(word(body)))).alias("held"), F.count("*").alias("n"), F.max("chunk_index").alias("last"),
        F.count_if(F.col("token_count") > DEFAULT.chunk_tokens).alias("over"), F.count_if(~F.col("text").startswith(F.concat(F.lit("["), F.col("source"), F.lit("]\n")))).alias("headless"),
    )
    both = docs.join(by_doc, "doc_id")
    return both.select("doc_id", F.size(F.array_except(word(F.col("text")), F.col("held"))).alias("lost"), (F.col("last") + 1 - F.col("n")).cast("int").alias("skipped"), F.col("over").cast("int").alias("over"), F.col("headless").cast("int").alias("headless"))


QUERIES = {
    f.__name__: f
    for f in (
        file_support, parsed_documents, reading_warnings, ocr_pages, inspection_pages, table_files, delimited_splits, sheet_numbers, stored_log, stored_runs, rescored_runs, synced_index, segmented_index, point_ids, search_reranked, missing_facts, answer_ranks,
        source_ranks, answer_routes, leaked_hits, source_headers, generated_answers, journaled_answers, standalone_questions, model_replies, judged_answers, phrase_checks, citation_checks, status_rules, confidential_checks, ingestion_checks,
        verify_facts, excerpts, logistic_scores, admin_counts, chunk_checks,
    )
}

_VISIBLE = "access_level = 'internal' AND status = 'active'"
_FOUND = f"{POSTINGS_SQL}, {ASKED_SQL}, {sparse_sql()}"
_EXT_SQL = "list_extract([" + ", ".join(f"'{e}'" for e in _EXT) + f"], CAST(doc_id % {len(_EXT)} + 1 AS INT))"
_SUFFIX_SQL = f"lower(regexp_extract('file.' || {_EXT_SQL}, '\\.([^.]+)$', 1))"
_READ = ", ".join(f"'{s}'" for s in DEFAULT.suffixes)
_OLD = ", ".join(f"'{s}'" for s in DEFAULT.legacy_suffixes)
_STARTS = "regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}]){}')"
_ROLE_SQL = "list_extract([" + ", ".join(f"'{r}'" for r in DEFAULT.roles) + f"], CAST(c_custkey % {len(DEFAULT.roles)} + 1 AS INT))"
_RESULTS = """r AS (SELECT doc_id, doc_id % 31 = 0 AS leaks, doc_id % 5 = 0 AS missing, doc_id % 7 = 0 AS not_indexed, CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 END AS source_rank, doc_id % 4 > 0 AS answerable, doc_id % 28 = 4 AS off_topic, doc_id % 6 AS hits,
  doc_id % 2 <> 0 AS fine, CASE doc_id % 11 WHEN 1 THEN 'correct' WHEN 2 THEN 'partial' WHEN 3 THEN 'wrong' END AS verdict, doc_id % 53 = 0 AS rejected FROM documents)"""

ORACLES = {
    "file_support": f"SELECT doc_id, CASE WHEN {_SUFFIX_SQL} IN ({_READ}) THEN 'supported' WHEN {_SUFFIX_SQL} IN ({_OLD}) THEN 'old format .' || {_SUFFIX_SQL} || ': save it anew' ELSE 'unsupported format .' || {_SUFFIX_SQL} END AS status FROM documents",
    "parsed_documents": f"SELECT 'file ' || doc_id || '.' || {_EXT_SQL} AS source, sha256(coalesce(text, '')) AS first, sha256(coalesce(text, '')) AS second, CAST(NULL AS VARCHAR) AS error, CAST(0 AS BIGINT) AS parsed_again FROM documents",
    "reading_warnings": """SELECT CAST(doc_id AS VARCHAR) AS source, 'hardly any text' AS warning FROM documents WHERE length(coalesce(text, '')) < 50
  UNION ALL SELECT CAST(doc_id AS VARCHAR), '1 pages read by OCR' FROM documents WHERE doc_id % 10 = 3""",
    "ocr_pages": "SELECT doc_id, length(trim(left(coalesce(text, ''), CAST(doc_id % 40 AS INT)))) < 20 AS needs_ocr FROM documents",
    "inspection_pages": "SELECT sha256('=== ' || source || ' p. ' || doc_id || ' ===' || chr(10) || text) AS digest FROM documents",
    "table_files": """SELECT c_custkey || '.csv' AS "table", 'Key: ' || c_custkey || ' | Name: ' || c_name || ' | Segment: ' || c_mktsegment || s || 'part' || chr(10) || chr(10) || 'Key: ' || c_custkey || ' | Segment: x' AS markdown
  FROM (SELECT *, CASE c_custkey % 4 WHEN 0 THEN ';' WHEN 1 THEN ',' WHEN 2 THEN ' ' ELSE '|' END AS s FROM customer)""",
    "sheet_numbers": """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) WHEN 1 THEN translate(format('{:,.2f}', l_quantity), ',.', '.,') || ' TL'
  WHEN 2 THEN '%' || translate(format('{:.1f}', l_quantity * 100), '.', ',') ELSE translate(format('{:,.0f}', l_quantity), ',', '.') || ' €' END AS shown FROM lineitem""",
    "delimited_splits": """SELECT l_returnflag AS flag, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS orders, CAST(sum(l_linenumber) AS BIGINT) AS lines,
  CAST(sum(length(trim(regexp_replace(CASE WHEN l_linenumber % 3 = 0 THEN 'say "so"; ' ELSE '' END || l_linestatus || CASE WHEN l_linenumber % 2 = 0 THEN ' ;; ' ELSE '' END, '\\s+', ' ', 'g')))) AS BIGINT) AS chars, 0 AS broken FROM lineitem GROUP BY 1""",
    "stored_log": """SELECT strftime(ts, '%Y-%m') AS month, count(*) AS rows, round(sum(value), 2) AS retrieval_ms, count(*) FILTER (WHERE event_type = 'error' OR event_id % 17 = 0) AS errors, count(DISTINCT user_id) AS users FROM events GROUP BY 1""",
    "stored_runs": """SELECT change, count(*) AS n FROM (SELECT CASE WHEN n > o THEN 'fixed' WHEN n < o THEN 'broken' ELSE 'same' END AS change FROM (
  SELECT CASE WHEN quality = 1 THEN 2 ELSE 0 END AS o, CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END AS n FROM labels)) GROUP BY change""",
    "rescored_runs": """SELECT coalesce(d.source, 'gone') AS type, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good FROM labels l LEFT JOIN (SELECT doc_id, source FROM documents WHERE lang = 'en') d USING (doc_id) GROUP BY 1""",
    "synced_index": """SELECT source, 'index' AS first_action, CASE source WHEN 'src0' THEN 'remove' WHEN 'src1' THEN 'index' ELSE 'unchanged' END AS second_action,
  CASE WHEN source <> 'src0' THEN count(*) END AS chunks, CASE WHEN source <> 'src0' THEN count(DISTINCT doc_id) END AS points, CASE WHEN source <> 'src0' THEN CAST(sum(length(text) + CASE WHEN source = 'src1' THEN 1 ELSE 0 END) AS BIGINT) END AS chars FROM documents GROUP BY source""",
    "segmented_index": f"""WITH now AS (SELECT source, {tokens_sql("CASE WHEN source IN ('src1', 'src2') THEN text || ' zzadded' ELSE text END")} AS t, doc_id FROM documents WHERE source <> 'src0'),
p AS (SELECT source, doc_id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT source, doc_id, len(t) AS length, unnest(t) AS term FROM now) GROUP BY ALL),
own AS (SELECT source, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS words, round(sum(round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / 60.0)), 4)), 2) AS weight FROM p GROUP BY source),
n AS (SELECT source, count(*) AS docs FROM now GROUP BY source), total AS (SELECT count(DISTINCT term) AS terms, count(*) AS df FROM p)
SELECT o.source, o.old_docs, n.docs, coalesce(own.postings, CASE WHEN n.docs > 0 THEN 0 END) AS postings, coalesce(own.words, CASE WHEN n.docs > 0 THEN 0 END) AS words, coalesce(own.weight, CASE WHEN n.docs > 0 THEN 0.0 END) AS weight,
  terms, df, (SELECT count(*) FROM now) AS texts, 3 AS segments FROM (SELECT source, count(*) AS old_docs FROM documents GROUP BY source) o LEFT JOIN n USING (source) LEFT JOIN own USING (source) CROSS JOIN total""",
    "point_ids": "SELECT doc_id, sha256(sha256(source) || '/' || doc_id) AS point_id FROM documents",
    "search_reranked": f"""WITH {LABELS_SQL}, {POSTINGS_SQL}, {ASKED_SQL}, {sparse_sql(_VISIBLE)},
q AS (SELECT item_id AS question_id, list_distinct({tokens_sql("text")}) AS words FROM benchmark),
scored AS (SELECT question_id, doc_id, rank AS old_rank, CASE WHEN len(words) > 0 THEN round(len(list_intersect(words, t)) / len(words), 6) ELSE 0 END AS score FROM sparse JOIN q USING (question_id) JOIN toks USING (doc_id))
SELECT * FROM (SELECT question_id, doc_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, old_rank) AS rank, old_rank FROM scored WHERE score >= 0.02) WHERE rank <= 5""",
    "missing_facts": f"""WITH {_FOUND}, {_HELD} SELECT question_id, 3 AS evidence_total, CASE WHEN holding > 0 THEN 1 ELSE 3 END AS n_missing,
  sha256(CASE WHEN holding > 0 THEN 'qx zz no text says this' ELSE text || '|qx zz no text says this / ' || text || '|qx zz no text says this' END) AS missing FROM ranks JOIN benchmark b ON b.item_id = question_id""",
    "answer_ranks": f"WITH {_FOUND}, {_HELD} SELECT question_id, source_rank AS answer_rank FROM ranks WHERE question_id IN (SELECT question_id FROM sparse)",
    "source_ranks": f"WITH {_FOUND} SELECT b.item_id AS question_id, min(rank) FILTER (WHERE source IN ('src5', 'src6')) AS source_rank FROM benchmark b LEFT JOIN sparse ON question_id = b.item_id LEFT JOIN documents d ON d.doc_id = sparse.doc_id GROUP BY 1",
    "answer_routes": f"WITH {LABELS_SQL}, {_FOUND} SELECT question_id, CASE WHEN bool_or(access_level = 'restricted') THEN 'local' ELSE 'any' END AS route FROM sparse JOIN labelled USING (doc_id) GROUP BY 1",
    "leaked_hits": f"WITH {LABELS_SQL}, {_FOUND} SELECT question_id, count(DISTINCT source) AS leaks FROM sparse JOIN labelled USING (doc_id) WHERE access_level <> 'internal' GROUP BY 1",
    "source_headers": f"""WITH {LABELS_SQL},
p AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN CAST(doc_id AS VARCHAR) ELSE doc_id || '-' || (doc_id + 1) END AS pages FROM labelled),
h AS (SELECT *, concat_ws(', ', CASE WHEN pages <> '' THEN 'p. ' || pages END, CASE WHEN effective_date IS NOT NULL THEN 'effective ' || effective_date END,
  CASE WHEN status = 'superseded' THEN 'SUPERSEDED by ' || replaced_by END, CASE WHEN doc_id % 7 = 0 THEN 'read by OCR, may hold errors' END) AS details FROM p),
k AS (SELECT *, '[1] ' || source || CASE WHEN doc_id % 2 = 0 THEN ' > A > B' ELSE '' END || CASE WHEN details <> '' THEN ' (' || details || ')' ELSE '' END AS header FROM h)
SELECT doc_id, header, pages, sha256('Sources:' || chr(10) || chr(10) || header || chr(10) || regexp_replace(text, '^\\[[^\\n]*\\]\\n', '') || chr(10) || chr(10) || 'Question: Why?') AS prompt FROM k""",
    "generated_answers": """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN lower('About ' || source) ELSE upper('About ' || source) END AS reply, CASE WHEN doc_id % 4 = 0 THEN 'house' ELSE 'cloud' END AS provider,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'busy: busy' END AS passed, CAST(NULL AS VARCHAR) AS error FROM documents""",
    "journaled_answers": """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN lower('About ' || source) ELSE upper('About ' || source) END AS reply, CASE WHEN doc_id % 4 = 0 THEN 'house' ELSE 'cloud' END AS provider,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'busy: busy' END AS passed, CAST(NULL AS VARCHAR) AS error FROM documents""",
    "standalone_questions": """SELECT conv_id, turn, sha256(CASE WHEN first < turn THEN 'and then after that?' ELSE text END) AS searched_as FROM (
  SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations WHERE role = 'user' AND trim(text) <> '')""",
    "model_replies": """WITH w AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[^a-z]', '', 'g') AS words FROM conversations)
SELECT conv_id, turn, sha256(CASE WHEN turn % 3 = 0 THEN '' ELSE trim('so ' || words) END) AS clean, CASE turn % 3 WHEN 0 THEN 'correct' WHEN 1 THEN 'partial' END AS verdict,
  CASE WHEN turn % 3 < 2 THEN 'r' || turn END AS reason, CASE WHEN length(words) + 1 > 201 THEN 1 ELSE length(words) + 1 END AS rewritten FROM w""",
    "judged_answers": """WITH p AS (SELECT turn, length('Compare the answer with the expected one. Reply with JSON alone: {"verdict": "correct", "partial" or "wrong", "reason": one sentence}.') + 6 + length('Question: q') + length('Expected: ') + coalesce(length(role), 0) + length('Answer: ') + length(text) AS n, text FROM conversations)
SELECT CASE WHEN turn = 1 OR text IS NULL OR n % 5 = 0 THEN NULL WHEN n % 2 = 0 THEN 'correct' ELSE 'wrong' END AS verdict, turn <> 1 AND text IS NOT NULL AND n % 5 = 0 AS judge_failed,
  CASE WHEN turn <> 1 AND text IS NOT NULL AND n % 5 <> 0 THEN 'even or odd' END AS reason, count(*) AS n FROM p GROUP BY 1, 2, 3""",
    "phrase_checks": f"""WITH d AS (SELECT doc_id, {_NORM.format("text")} AS t FROM documents)
SELECT doc_id, concat_ws('; ', {", ".join(f"CASE WHEN NOT {_STARTS.format(p)} THEN 'missing {p}' END" for p in ("the", "de"))},
  CASE WHEN NOT ({" OR ".join(_STARTS.format(p) for p in ("und", "and", "pour"))}) THEN CASE WHEN doc_id % 2 = 0 THEN 'none of und, and, pour' ELSE 'does not say that the information is missing' END END,
  {", ".join(f"CASE WHEN {_STARTS.format(p)} THEN 'contains {p}' END" for p in ("license", "la"))}) AS problems FROM d""",
    "citation_checks": """WITH a AS (SELECT conv_id, turn, conv_id % 6 AS n, turn % 3 > 0 AS ok, role = 'assistant' AS asked FROM conversations), b AS (SELECT *, n = 5 OR NOT asked AS nf FROM a)
SELECT conv_id, turn, concat_ws('; ', CASE WHEN n IN (0, 4) THEN 'not in the source list: ' || n END,
  CASE WHEN NOT ok AND NOT nf THEN 'not marked as not found' WHEN NOT ok THEN NULL WHEN nf THEN 'says the answer is not there' WHEN n IN (0, 4) THEN 'no citation' WHEN n <> 2 THEN 'cites none of the expected files' END) AS problems FROM b""",
    "status_rules": f"""WITH {_RESULTS}, f AS (SELECT *, off_topic AND hits > 0 AS slipped, source_rank IS NOT NULL AND NOT missing AS got FROM r),
g AS (SELECT *, CASE WHEN leaks OR slipped THEN 'fail' WHEN got OR NOT answerable THEN 'pass' ELSE 'fail' END AS found, CASE WHEN leaks OR slipped OR rejected THEN 'fail' WHEN verdict = 'correct' THEN 'pass' WHEN verdict = 'partial' THEN 'partial' WHEN verdict = 'wrong' THEN 'fail' WHEN fine THEN 'pass' ELSE 'fail' END AS status FROM f)
SELECT doc_id, found, CASE WHEN leaks THEN 'LEAK' WHEN slipped THEN 'not stopped' WHEN found = 'pass' THEN '' WHEN not_indexed THEN 'reading' ELSE 'retrieval' END AS why, status,
  CASE WHEN leaks THEN 'LEAK' WHEN rejected THEN 'rejected' WHEN slipped THEN 'not stopped' WHEN status = 'pass' THEN '' WHEN NOT answerable THEN 'made up an answer' WHEN not_indexed THEN 'reading' WHEN source_rank IS NULL OR missing THEN 'retrieval' ELSE 'generation' END AS diagnosis,
  coalesce(fine <> (verdict = 'correct'), false) AS disagreement FROM g""",
    "confidential_checks": """SELECT doc_id, concat_ws('; ', CASE WHEN doc_id % 3 = 0 THEN 'confidential sources were answered by cloud' END, CASE WHEN doc_id % 2 = 0 THEN 'confidential sources were judged by judge' END) AS problems
  FROM documents WHERE doc_id % 13 = 0 AND (doc_id % 3 = 0 OR doc_id % 2 = 0)""",
    "ingestion_checks": f"""WITH d AS (SELECT text, {_NORM.format("text")} AS t FROM documents)
SELECT 'LICENSE' AS expected, count(*) FILTER (WHERE contains(t, lower(replace('LICENSE', 'I', 'ı')))) AS documents FROM d UNION ALL SELECT 'ion de', count(*) FILTER (WHERE contains(t, 'ion de')) FROM d
UNION ALL SELECT 're:[0-9]{{3}}-[0-9]{{4}}', count(*) FILTER (WHERE regexp_matches(text, '[0-9]{{3}}-[0-9]{{4}}')) FROM d UNION ALL SELECT 're:^The', count(*) FILTER (WHERE regexp_matches(text, '^The')) FROM d""",
    "verify_facts": "SELECT conv_id, turn, CAST(conv_id AS VARCHAR) AS fact, conv_id || ' (cited 1, stands in 2)' AS label FROM conversations WHERE turn % 3 <> 0 AND conv_id <> turn",
    "excerpts": """WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), h AS (SELECT *, regexp_extract(t, '^(.{0,78})\\s', 1) AS head FROM f)
SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE rtrim(head) || CASE WHEN head <> '' THEN ' …' ELSE '…' END END AS excerpt FROM h""",
    "logistic_scores": "SELECT l_orderkey, l_linenumber, round(1.0 / (1.0 + exp(-((l_discount - 0.05) * 100))), 9) AS score FROM lineitem",
    "admin_counts": f"SELECT c_mktsegment, count(*) FILTER (WHERE {_ROLE_SQL} = 'hr_admin') AS admins, count(*) AS users FROM customer GROUP BY 1",
    "chunk_checks": "SELECT doc_id, 0 AS lost, 0 AS skipped, 0 AS over, 0 AS headless FROM documents WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''",
}
