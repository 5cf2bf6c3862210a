"""Citations, facts, excerpts, retrieval measures, comparisons and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.functions.citations import best_piece, citations, fact_keys
from skarn.functions.text import contains_phrase, normalize
from skarn.operators import answer
from skarn.operators import evaluate as V
from skarn.operators import logs, phrases
from skarn.operators.catalog import labelled
from skarn.plans.common import ASKED_SQL, LABELS_SQL, POSTINGS_SQL, catalog, documents, questions, sparse_sql, spread, stored, tokens_sql
from skarn.plans.search_queries import _sparse, overlap_hits
from skarn.runtime import shared_dir, table, written
from skarn.settings import DEFAULT
from skarn.sources.config import against_index


def parse_citations(spark, sf_dir: str) -> DataFrame:
    """Citations of made-up answers: each turn's text with markers made of its numbers; five sources each."""
    turns = table(spark, sf_dir, "conversations")
    mark = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    conv, turn = F.col("conv_id") % 9, F.col("turn")
    answer = mark(F.coalesce("text", F.lit("")), " [", conv, "][", turn, ", ", turn + 2, "] and [2-4], [1-90]", F.when(conv == 0, " [not_found]").otherwise(""))
    c = citations(answer, F.lit(5))
    text = lambda a: F.concat_ws(",", F.transform(a, lambda n: n.cast("string")))
    return turns.select("conv_id", "turn", c.alias("c")).select("conv_id", "turn", text(F.col("c.numbers")).alias("numbers"), text(F.col("c.invalid")).alias("invalid"), "c.not_found", F.sha2(F.col("c.clean_text").cast("binary"), 256).alias("clean_sha256"))


def fact_counts(spark, sf_dir: str) -> DataFrame:
    """Distinct number keys of every document, parts of numbers included."""
    d = spread(documents(spark, sf_dir).select("doc_id", "text"))
    keys = F.filter(fact_keys(F.col("text"), True), lambda k: ~k.startswith("code:"))
    return d.select("doc_id", keys.alias("keys")).select("doc_id", F.size("keys").alias("n"), F.concat_ws(",", F.array_sort("keys")).alias("keys"))


def best_excerpt(spark, sf_dir: str) -> DataFrame:
    """For every question the sentence of its best document that shares most words with it."""
    hit = _sparse(spark, sf_dir, k=1).join(documents(spark, sf_dir).select("doc_id", "text"), "doc_id").join(questions(spark, sf_dir).select("question_id", F.col("text").alias("question")), "question_id")
    return hit.select("question_id", "doc_id", best_piece(F.col("text"), F.col("question")).alias("excerpt"))


def _judged(spark, sf_dir: str) -> DataFrame:
    """(question_id, source_rank, expected): the first hit that holds the question's whole text, and how many do."""
    hits = _sparse(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", "text"), "doc_id").join(questions(spark, sf_dir).select("question_id", F.col("text").alias("question")), "question_id")
    held = hits.withColumn("held", contains_phrase(F.col("text"), F.col("question")))
    return questions(spark, sf_dir).select("question_id").join(held.groupBy("question_id").agg(F.min(F.when(F.col("held"), F.col("rank"))).alias("source_rank"), F.count_if("held").alias("holding")), "question_id", "left")


def eval_ranks(spark, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("question_id", "source_rank", F.coalesce("holding", F.lit(0)).alias("holding"))


def eval_retrieval(spark, sf_dir: str) -> DataFrame:
    """The 33 figures of a retrieval run over all benchmark items."""
    r = _judged(spark, sf_dir)
    none = F.expr("cast(array() as array<string>)")
    rows = r.select(
        "question_id", F.lit(True).alias("answerable"), F.lit(1).alias("evidence_total"), F.when(F.col("source_rank").isNull(), F.array(F.lit("text"))).otherwise(none).alias("missing"), "source_rank",
        *(none.alias(c) for c in ("phrase_problems", "citation_problems", "invalid_citations", "citations", "unverified", "leaks", "not_indexed")),
        F.lit(None).cast("string").alias("verdict"), F.lit(False).alias("disagreement"), F.lit("").alias("answered_by"), F.lit(None).cast("string").alias("known_gap"), F.lit(False).alias("off_topic"),
        F.lit(20).alias("hits"), F.lit(0.0).alias("retrieval_ms"), F.lit(0.0).alias("llm_ms"), F.lit(0).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"),
    )
    status, _ = V.retrieval_status({c: F.col(c) for c in rows.columns})
    return V.summarize(rows.withColumn("status", status))


def eval_threshold_study(spark, sf_dir: str) -> DataFrame:
    """The threshold that every question with an answer survives, against the best hit of those without."""
    hits = overlap_hits(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", "text"), "doc_id").join(questions(spark, sf_dir).select("question_id", F.col("text").alias("question")), "question_id")
    scored = written(hits.select("question_id", F.round("overlap", 6).alias("new"), contains_phrase(F.col("text"), F.col("question")).alias("held")), "scored")
    needed = V.needed_score(scored.select("question_id", F.lit("text").alias("fact"), F.when(F.col("held"), F.col("new")).alias("score"))).where("needed is not null")
    others = scored.join(needed.select("question_id"), "question_id", "left_anti").select("question_id", F.col("new").alias("score"))
    study = V.threshold_study(needed, others)
    return study.withColumn("suggested", F.round("suggested", 6))


def quality_by_label(spark, sf_dir: str) -> DataFrame:
    """Labels by language, as counts of statuses by type."""
    rows = table(spark, sf_dir, "labels").join(documents(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    status = F.when(F.col("toxic") == 1, "fail").when(F.col("quality") == 1, "pass").otherwise("partial")
    return V.by_type(rows.withColumn("status", status), "lang")


def compare_runs(spark, sf_dir: str) -> DataFrame:
    """Two runs over documents: the labelled ones by quality, and all of them by toxicity and length."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("question_id"), "quality", "toxic")
    old = labels.withColumn("status", F.when(F.col("quality") == 1, "pass").otherwise("fail"))
    new = documents(spark, sf_dir).select(F.col("doc_id").alias("question_id"), "n_chars").join(labels, "question_id", "left")
    return V.compared(old, new.withColumn("status", F.when(F.col("toxic") == 1, "fail").when(F.col("n_chars") > 500, "pass").otherwise("partial")))


def compare_settings(spark, sf_dir: str) -> DataFrame:
    """Settings that differ between two runs: one for each source of the documents in both, one for each language in one."""
    d = documents(spark, sf_dir)
    by = lambda key, value: d.groupBy(F.col(key).alias("key")).agg(value.alias("value"))
    return V.settings_diff(by("source", F.min("lang")), by("source", F.max("lang")).unionByName(by("lang", F.max("lang"))))


def _log(spark, sf_dir: str) -> DataFrame:
    """Events as a question log: the type is the outcome, the value the time."""
    e = table(spark, sf_dir, "events")
    kinds = F.col("event_type")
    return e.select(
        F.col("ts").alias("time"), F.col("user_id").cast("string").alias("user"), kinds.alias("question"), F.when(F.col("event_id") % 7 == 0, kinds).alias("searched_as"), F.lit(None).cast("array<string>").alias("unverified"),
        (F.col("event_id") % 5 != 0).alias("llm_asked"), (F.col("event_id") % 3 == 0).alias("not_found"), (F.col("event_id") % 11 == 0).alias("confidential"), F.when(F.col("event_id") % 13 == 0, "other").alias("fallback"),
        F.col("value").alias("retrieval_ms"), F.col("value").alias("llm_ms"), F.lit(None).cast("double").alias("rewrite_ms"), F.when(kinds == "error", F.concat(F.lit("failed "), (F.col("event_id") % 4).cast("string"))).when(F.col("event_id") % 17 == 0, "busy").alias("error"),
    )


def log_summary(spark, sf_dir: str) -> DataFrame:
    """A row for each month."""
    return logs.summary(_log(spark, sf_dir).withColumn("month", F.date_format("time", "yyyy-MM")), ["month"])


def log_errors(spark, sf_dir: str) -> DataFrame:
    return logs.errors(_log(spark, sf_dir))


def log_gaps(spark, sf_dir: str) -> DataFrame:
    """The 20 questions most often without an answer."""
    return logs.gaps(_log(spark, sf_dir))


def log_last(spark, sf_dir: str) -> DataFrame:
    """The last 25 entries."""
    return logs.last(_log(spark, sf_dir), 25).select("time", "user", "question")


def stream_daily_outcomes(spark, sf_dir: str) -> DataFrame:
    """Events as a stream, counted by day and type."""
    import uuid

    from skarn.streaming.logs import daily_outcomes, run_to_end

    e = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(e.schema).parquet(f"{sf_dir}/events.parquet*").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    name = f"daily_{uuid.uuid4().hex}"
    return run_to_end(daily_outcomes(stream), name, f"{shared_dir(spark).rstrip('/')}/{name}")


def evidence_in_index(spark, sf_dir: str) -> DataFrame:
    """Benchmark items as facts expected in any of the sources: those that no document holds, and a file that is missing."""
    named = F.array(*(F.lit(f"src{i}") for i in (*range(20), 77)))
    asked = questions(spark, sf_dir).select(F.col("question_id").cast("int"), F.lit(None).cast("string").alias("known_gap"), named.alias("sources"), F.array(F.array("text")).alias("evidence"))
    return against_index(asked, stored(spark, sf_dir)).select("question_id", F.sha2("problem", 256).alias("problem"), "blocking")


def phrase_documents(spark, sf_dir: str) -> DataFrame:
    """Of every benchmark item's first words, as phrases of one to five words with an open edge, and of the whole item: how
    many documents hold them, and the first one."""
    n = F.least(F.col("question_id") % 5 + 1, F.size(F.split("text", " ")))
    asked = questions(spark, sf_dir).select("question_id", "text", F.array_join(F.slice(F.split("text", " "), 1, n.cast("int")), " ").alias("some"))
    both = asked.select(F.col("question_id").alias("item_id"), F.posexplode(F.array("some", "text")).alias("kind", "phrase")).withColumn("phrase_id", F.col("item_id") * 2 + F.col("kind"))
    found = phrases.holding(stored(spark, sf_dir), both.select("phrase_id", "phrase")).groupBy("phrase_id").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))
    return both.join(found, "phrase_id", "left").select("item_id", "kind", F.coalesce("docs", F.lit(0)).alias("docs"), "first_doc")


def rerank_proximity(spark, sf_dir: str) -> DataFrame:
    """All 20 candidates of every question with the shortest stretches that hold its words, scored by them."""
    hits = phrases.proximity(stored(spark, sf_dir), questions(spark, sf_dir), _sparse(spark, sf_dir).select("question_id", "doc_id"))
    score = phrases.proximity_score(*(F.col(c) for c in ("words", "held", "window", "in_order")))
    return hits.select("question_id", "doc_id", "words", "held", "window", "in_order", F.round(score + 1e-9, 6).alias("score"))


def answer_questions(spark, sf_dir: str) -> DataFrame:
    """Every benchmark item answered from its five best internal documents by the extractive generator."""
    hits = _sparse(spark, sf_dir, ("internal",), k=DEFAULT.top_k).join(labelled(documents(spark, sf_dir).select("doc_id", "source", "text"), catalog(spark)), "doc_id")
    none = F.lit(None).cast("int")
    hits = hits.withColumns({"heading_path": F.lit(""), "page_start": none, "page_end": none, "ocr": F.lit(False)})
    asked = answer.with_sources(questions(spark, sf_dir).select("question_id", F.col("text").alias("question")), hits)
    got = answer.answered(asked)
    return got.select("question_id", "route", F.size("sources").alias("n_sources"), "answer", F.size("citations.numbers").alias("n_cited"), F.size("unverified").alias("n_unverified"))


def normalized_phrases(spark, sf_dir: str) -> DataFrame:
    """The form in which every benchmark item is looked up."""
    return table(spark, sf_dir, "benchmark").select("item_id", normalize(F.col("text")).alias("phrase"))


QUERIES = {
    f.__name__: f
    for f in (
        parse_citations, fact_counts, best_excerpt, eval_ranks, eval_retrieval, eval_threshold_study, quality_by_label, compare_runs, compare_settings,
        log_summary, log_errors, log_gaps, log_last, stream_daily_outcomes, evidence_in_index, phrase_documents, rerank_proximity, answer_questions, normalized_phrases,
    )
}

_NORM = "trim(regexp_replace(replace(regexp_replace(lower(replace(replace({}, 'İ', 'i'), 'I', 'ı')), '[*`]', '', 'g'), '’', ''''), '\\s+', ' ', 'g'))"
_LOG = """log AS (SELECT ts AS time, CAST(user_id AS VARCHAR) AS "user", event_type AS question, event_id % 7 = 0 AS rewritten, event_id % 5 <> 0 AS llm_asked, event_id % 3 = 0 AS not_found,
  event_id % 11 = 0 AS confidential, event_id % 13 = 0 AS fallback, value, CASE WHEN event_type = 'error' THEN 'failed ' || (event_id % 4) WHEN event_id % 17 = 0 THEN 'busy' END AS error FROM events),
out AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN NOT llm_asked THEN 'nothing found' WHEN not_found THEN 'not found' ELSE 'answered' END AS outcome FROM log)"""
_HELD = f"""held AS (SELECT question_id, doc_id, rank, {_NORM.format("d.text")} AS t, {_NORM.format("b.text")} AS p FROM sparse JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = question_id),
ranks AS (SELECT b.item_id AS question_id, min(CASE WHEN h THEN rank END) AS source_rank, count(*) FILTER (WHERE h) AS holding
  FROM benchmark b LEFT JOIN (SELECT *, regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}])' || regexp_escape(p)) AS h FROM held) ON question_id = b.item_id GROUP BY b.item_id)"""
_BM = f"{POSTINGS_SQL}, {ASKED_SQL}, {sparse_sql()}"
_ZERO = "CAST(0 AS BIGINT)"
_OVERLAP_WORDS = "list_distinct(list_filter(regexp_extract_all(lower(replace(replace({}, 'İ', 'i'), 'I', 'ı')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 2 OR regexp_matches(w, '^\\p{{Nd}}+$')))"

_ENDS = "list_transform(regexp_split_to_array(p, '\\s*[-–]\\s*'), lambda x: CAST(trim(x) AS BIGINT))"
ORACLES = {
    "parse_citations": f"""WITH a AS (SELECT conv_id, turn, coalesce(text, '') || ' [' || (conv_id % 9) || '][' || turn || ', ' || (turn + 2) || '] and [2-4], [1-90]' || CASE WHEN conv_id % 9 = 0 THEN ' [not_found]' ELSE '' END AS t FROM conversations),
n AS (SELECT *, flatten(list_transform(flatten(list_transform(regexp_extract_all(t, '\\[\\s*(\\p{{Nd}}+(?:\\s*[,\\-–]\\s*\\p{{Nd}}+)*)\\s*\\]', 1), lambda g: regexp_split_to_array(g, '\\s*,\\s*'))),
  lambda p: CASE WHEN len({_ENDS}) = 2 AND {_ENDS}[2] - {_ENDS}[1] BETWEEN 1 AND 20 THEN range({_ENDS}[1], {_ENDS}[2] + 1) ELSE {_ENDS} END)) AS l FROM a),
d AS (SELECT *, list_filter(l, lambda x, i: list_position(l, x) = i) AS u FROM n)
SELECT conv_id, turn, array_to_string(list_filter(u, lambda x: x BETWEEN 1 AND 5), ',') AS numbers, array_to_string(list_filter(u, lambda x: x NOT BETWEEN 1 AND 5), ',') AS invalid,
  regexp_matches(t, '(?i)\\[\\s*NOT[_ ]FOUND\\s*\\]') AS not_found, sha256(trim(regexp_replace(t, '(?i)\\s*\\[\\s*NOT[_ ]FOUND\\s*\\]', '', 'g'))) AS clean_sha256 FROM d""",
    "eval_threshold_study": f"""WITH {_BM}, {_HELD},
q AS (SELECT item_id AS question_id, list_distinct({tokens_sql("text")}) AS words FROM benchmark),
scored AS (SELECT h.question_id, round(len(list_intersect(words, toks.t)) / len(words), 6) AS new, regexp_matches(h.t, '(^|[^\\p{{L}}\\p{{N}}])' || regexp_escape(h.p)) AS held FROM held h JOIN q USING (question_id) JOIN toks USING (doc_id)),
need AS (SELECT question_id, max(new) AS needed FROM scored WHERE held GROUP BY question_id),
other AS (SELECT question_id, new AS score FROM scored WHERE question_id NOT IN (SELECT question_id FROM need)),
w AS (SELECT min(needed) AS weakest, (SELECT question_id FROM need ORDER BY needed, question_id LIMIT 1) AS weakest_question FROM need),
o AS (SELECT max(score) AS strongest, (SELECT question_id FROM other ORDER BY score DESC, question_id DESC LIMIT 1) AS strongest_question FROM other)
SELECT *, round(floor(weakest / 10 / pow(10, floor(log10(weakest / 10)))) * pow(10, floor(log10(weakest / 10))), 6) AS suggested FROM w, o""",
    "fact_counts": """WITH plain AS (SELECT doc_id, translate(lower(replace(text, 'İ', 'i')), 'çğıöşüâîû', 'cgiosuaiu') AS t FROM documents),
codes AS (SELECT doc_id, t, list_filter(regexp_extract_all(t, '[\\p{L}\\p{N}]+(?:[-_/][\\p{L}\\p{N}]+)+'), lambda x: regexp_matches(x, '\\p{Nd}') AND regexp_matches(x, '\\p{L}')) AS c FROM plain),
nums AS (SELECT doc_id, regexp_extract_all(t, '\\p{Nd}+(?:[.,:/]\\p{Nd}+)*') AS n FROM codes),
parts AS (SELECT doc_id, list_distinct(list_transform(list_concat(n, flatten(list_transform(n, lambda x: regexp_split_to_array(x, '[.,:/]')))), lambda x: coalesce(nullif(ltrim(regexp_replace(x, '[^0-9]', '', 'g'), '0'), ''), '0'))) AS k FROM nums)
SELECT doc_id, len(k) AS n, array_to_string(list_sort(k), ',') AS keys FROM parts""",
    "best_excerpt": f"""WITH {POSTINGS_SQL}, {ASKED_SQL}, {sparse_sql(k=1)},
hit AS (SELECT question_id, doc_id, d.text, {_OVERLAP_WORDS.format("b.text")} AS w FROM sparse JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = question_id),
cut AS (SELECT question_id, doc_id, w, flatten(list_transform(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: CASE WHEN starts_with(x, '|') THEN [trim(x, ' |')] ELSE string_split(regexp_replace(x, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) END)) AS p FROM hit),
each AS (SELECT question_id, doc_id, w, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM cut),
scored AS (SELECT *, {_OVERLAP_WORDS.format("piece")} AS own FROM each)
SELECT question_id, doc_id, arg_max(piece, len(list_intersect(w, own)) * 1000000 - i) AS excerpt FROM scored WHERE len(own) > 0 GROUP BY question_id, doc_id""",
    "answer_questions": f"""WITH {LABELS_SQL}, {POSTINGS_SQL}, {ASKED_SQL}, {sparse_sql("access_level = 'internal' AND status = 'active'", k=5)},
hit AS (SELECT question_id, doc_id, regexp_replace(d.text, '^\\[[^\\n]*\\]\\n', '') AS text, {_OVERLAP_WORDS.format("b.text")} AS w FROM sparse JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = question_id WHERE rank = 1),
cut AS (SELECT question_id, w, flatten(list_transform(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: CASE WHEN starts_with(x, '|') THEN [trim(x, ' |')] ELSE string_split(regexp_replace(x, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) END)) AS p FROM hit),
each AS (SELECT question_id, w, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM cut), scored AS (SELECT *, {_OVERLAP_WORDS.format("piece")} AS own FROM each),
best AS (SELECT question_id, arg_max(piece, len(list_intersect(w, own)) * 1000000 - i) AS piece FROM scored WHERE len(own) > 0 GROUP BY question_id), n AS (SELECT question_id, count(*) AS n FROM sparse GROUP BY question_id)
SELECT b.item_id AS question_id, CASE WHEN n.n IS NULL THEN 'none' ELSE 'any' END AS route, CAST(coalesce(n.n, 0) AS INT) AS n_sources, CASE WHEN n.n IS NOT NULL THEN coalesce(piece || ' [1]', '[NOT_FOUND]') END AS answer,
  CAST(CASE WHEN piece IS NULL THEN 0 ELSE 1 END AS INT) AS n_cited, 0 AS n_unverified FROM benchmark b LEFT JOIN n ON n.question_id = b.item_id LEFT JOIN best ON best.question_id = b.item_id""",
    "eval_ranks": f"WITH {_BM}, {_HELD} SELECT question_id, source_rank, holding FROM ranks",
    "eval_retrieval": f"""WITH {_BM}, {_HELD} SELECT count(*) AS questions, count(source_rank) AS "pass", {_ZERO} AS partial, count(*) - count(source_rank) AS fail, {_ZERO} AS known_gaps_not_passed, count(*) AS answerable, 5 AS top_k,
  count(*) FILTER (WHERE source_rank = 1) AS "hit@1", count(*) FILTER (WHERE source_rank <= 3) AS "hit@3", count(source_rank) AS "hit@k", round(avg(coalesce(1.0 / source_rank, 0)), 3) AS mrr, count(*) AS with_evidence, count(source_rank) AS evidence_found,
  count(*) AS phrases_ok, {_ZERO} AS verdict_correct, {_ZERO} AS verdict_partial, {_ZERO} AS verdict_wrong, count(*) AS not_judged, {_ZERO} AS disagreements, count(*) AS citations_ok, {_ZERO} AS invalid_citations, 0.0::DOUBLE AS avg_cited, {_ZERO} AS unanswerable,
  {_ZERO} AS unanswerable_ok, {_ZERO} AS off_topic, {_ZERO} AS off_topic_stopped, {_ZERO} AS no_sources, {_ZERO} AS unverified_answers, {_ZERO} AS leaks, 0.0::DOUBLE AS avg_retrieval_ms, 0.0::DOUBLE AS avg_llm_s, {_ZERO} AS input_tokens, {_ZERO} AS output_tokens FROM ranks""",
    "quality_by_label": """SELECT lang, count(*) FILTER (WHERE toxic <> 1 AND quality = 1) AS "pass", count(*) FILTER (WHERE toxic <> 1 AND quality <> 1) AS partial, count(*) FILTER (WHERE toxic = 1) AS fail FROM labels JOIN documents USING (doc_id) GROUP BY lang""",
    "compare_runs": """WITH o AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS s FROM labels), n AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'fail' WHEN n_chars > 500 THEN 'pass' ELSE 'partial' END AS s FROM documents LEFT JOIN labels USING (doc_id))
SELECT coalesce(o.doc_id, n.doc_id) AS question_id, o.s AS old_status, n.s AS new_status, CASE WHEN n.s IS NULL THEN 'only old' WHEN o.s IS NULL THEN 'only new'
  WHEN list_position(['fail', 'partial', 'pass'], n.s) > list_position(['fail', 'partial', 'pass'], o.s) THEN 'fixed' WHEN list_position(['fail', 'partial', 'pass'], n.s) < list_position(['fail', 'partial', 'pass'], o.s) THEN 'broken' ELSE 'same' END AS change
FROM o FULL JOIN n ON o.doc_id = n.doc_id""",
    "compare_settings": """WITH o AS (SELECT source AS key, min(lang) AS value FROM documents GROUP BY source), n AS (SELECT source AS key, max(lang) AS value FROM documents GROUP BY source UNION ALL SELECT lang, max(lang) FROM documents GROUP BY lang)
SELECT coalesce(o.key, n.key) AS key, o.value AS old_value, n.value AS new_value FROM o FULL JOIN n ON o.key = n.key WHERE o.value IS DISTINCT FROM n.value""",
    "log_summary": f"""WITH {_LOG} SELECT strftime(time, '%Y-%m') AS month, count(*) AS questions, count(*) FILTER (WHERE outcome = 'answered') AS answered, count(*) FILTER (WHERE outcome = 'not found') AS not_found, count(*) FILTER (WHERE outcome = 'nothing found') AS nothing_found,
  count(*) FILTER (WHERE outcome = 'error') AS error, count(*) FILTER (WHERE confidential) AS confidential, count(*) FILTER (WHERE rewritten) AS rewritten, count(*) FILTER (WHERE fallback) AS fallback, {_ZERO} AS unverified,
  round(avg(value) FILTER (WHERE value > 0), 1) AS avg_retrieval_ms, round(avg(value) FILTER (WHERE value > 0), 1) AS avg_llm_ms, NULL::DOUBLE AS avg_rewrite_ms, count(DISTINCT "user") AS users FROM out GROUP BY 1""",
    "log_errors": f"WITH {_LOG} SELECT error, count(*) AS times FROM log WHERE error IS NOT NULL GROUP BY error",
    "log_gaps": f"WITH {_LOG} SELECT trim(question) AS question, count(*) AS times FROM out WHERE outcome IN ('not found', 'nothing found') GROUP BY 1 ORDER BY times DESC, question LIMIT 20",
    "log_last": f"""WITH {_LOG} SELECT time, "user", question FROM log ORDER BY time DESC, "user", question LIMIT 25""",
    "stream_daily_outcomes": "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2",
    "evidence_in_index": f"""WITH d AS (SELECT {_NORM.format("text")} AS t FROM documents),
b AS (SELECT item_id, text, {_NORM.format("text")} AS p FROM benchmark), near AS (SELECT item_id, t, p FROM b JOIN d ON contains(t, p)),
miss AS (SELECT item_id, text FROM b WHERE item_id NOT IN (SELECT item_id FROM near WHERE regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}])' || regexp_escape(p))))
SELECT CAST(item_id AS INT) AS question_id, sha256(problem) AS problem, true AS blocking FROM (SELECT item_id, 'src77 is not indexed' AS problem FROM benchmark UNION ALL SELECT item_id, 'no chunk holds ' || text FROM miss)""",
    "phrase_documents": f"""WITH d AS (SELECT doc_id, {_NORM.format("text")} AS t FROM documents),
b AS (SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark), each AS (SELECT item_id, 0 AS kind, array_to_string(w[1:least(item_id % 5 + 1, len(w))], ' ') AS phrase FROM b UNION ALL SELECT item_id, 1, text FROM b),
p AS (SELECT item_id, kind, {_NORM.format("phrase")} AS p FROM each), near AS (SELECT item_id, kind, doc_id FROM p JOIN d ON contains(t, p)
  WHERE regexp_matches(t, CASE WHEN regexp_matches(p, '^\\p{{Nd}}') THEN '(^|[^\\p{{L}}\\p{{N}}.,]|(^|[^\\p{{Nd}}])[.,])' WHEN regexp_matches(p, '^[\\p{{L}}\\p{{N}}]') THEN '(^|[^\\p{{L}}\\p{{N}}])' ELSE '' END || regexp_escape(p)))
SELECT item_id, CAST(kind AS INTEGER) AS kind, count(doc_id) AS docs, min(doc_id) AS first_doc FROM p LEFT JOIN near USING (item_id, kind) GROUP BY item_id, kind""",
    "rerank_proximity": f"""WITH {_BM},
q AS (SELECT item_id AS question_id, list_distinct(w) AS any_order, w FROM (SELECT item_id, regexp_extract_all({_NORM.format("text")}, '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark)),
f AS (SELECT question_id, len(any_order) AS words, list_filter(w, lambda x, i: list_position(w, x) = i) AS sought FROM q),
d AS (SELECT doc_id, regexp_extract_all({_NORM.format("text")}, '[\\p{{L}}\\p{{N}}]+') AS t FROM documents WHERE doc_id IN (SELECT doc_id FROM sparse)),
l AS (SELECT question_id, doc_id, words, list_filter(list_transform(sought, lambda x: list_filter(range(1, len(t) + 1), lambda i: t[i] = x)), lambda y: len(y) > 0) AS lists FROM sparse JOIN f USING (question_id) JOIN d USING (doc_id)),
s AS (SELECT question_id, doc_id, any_value(words) AS words, any_value(len(lists)) AS held,
  min(CASE WHEN list_bool_and(list_transform(lists, lambda y: list_max(y) >= s)) THEN list_max(list_transform(lists, lambda y: list_min(list_filter(y, lambda x: x >= s)))) - s + 1 END) AS "window",
  min(CASE WHEN list_contains(lists[1], s) THEN list_reduce(lists[2:], lambda a, y: [list_min(list_filter(y, lambda x: x > a[1]))], [s])[1] - s + 1 END) AS in_order
  FROM (SELECT *, unnest(flatten(lists)) AS s FROM l) GROUP BY question_id, doc_id)
SELECT question_id, doc_id, CAST(words AS INTEGER) AS words, CAST(coalesce(held, 0) AS INTEGER) AS held, CAST(coalesce("window", 0) AS INTEGER) AS "window", CAST(coalesce(in_order, 0) AS INTEGER) AS in_order,
  round(coalesce(CASE WHEN words > 0 THEN held / words * (0.6 + 0.3 * coalesce(held / "window", 0) + 0.1 * coalesce(held / in_order, 0)) END, 0) + 1e-9, 6) AS score FROM (SELECT question_id, doc_id, l.words, s.held, "window", in_order FROM l LEFT JOIN s USING (question_id, doc_id))""",
    "normalized_phrases": f"SELECT item_id, {_NORM.format('text')} AS phrase FROM benchmark",
}
