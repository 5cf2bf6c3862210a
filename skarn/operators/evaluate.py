"""Measuring retrieval and answers: checks by question, verdicts, summaries, comparisons and threshold studies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.citations import citations
from skarn.functions.text import contains_normalized, normalize, round_down, verdict
from skarn.settings import DEFAULT, Settings


def source_rank(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, source_rank): the first rank at which an expected source (sources) was found, null if none was."""
    near = hits.join(questions.select("question_id", "sources"), "question_id").where(F.array_contains("sources", F.col("source")))
    return questions.select("question_id").join(near.groupBy("question_id").agg(F.min("rank").alias("source_rank")), "question_id", "left")


def missing_evidence(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, evidence_total, missing): facts (evidence: an array of alternatives) that no hit's text holds."""
    texts = hits.groupBy("question_id").agg(F.collect_list(normalize(F.col("text"))).alias("texts"))
    both = questions.select("question_id", "evidence").join(texts, "question_id", "left")
    held = lambda alternatives: F.exists(alternatives, lambda p: F.exists(F.coalesce("texts", F.expr("cast(array() as array<string>)")), lambda t: contains_normalized(t, normalize(p))))
    return both.select("question_id", F.size("evidence").alias("evidence_total"), F.transform(F.filter("evidence", lambda a: ~held(a)), lambda a: F.array_join(a, " / ")).alias("missing"))


def leaks(hits: DataFrame, questions: DataFrame, roles: DataFrame) -> DataFrame:
    """(question_id, leak): hits that the asking role may not see, and forbidden phrases among the hits."""
    asked = questions.select("question_id", "role", "forbidden").join(F.broadcast(roles.select("role", "access_levels")), "role")
    both = hits.join(asked, "question_id")
    label = both.where(~F.array_contains("access_levels", F.col("access_level"))).select("question_id", F.concat("source", F.lit(" ("), "access_level", F.lit(")")).alias("leak"))
    phrase = both.select("question_id", "source", normalize(F.col("text")).alias("t"), F.explode("forbidden").alias("p")).where(contains_normalized(F.col("t"), normalize(F.col("p"))))
    shown = phrase.groupBy("question_id", "p").agg(F.concat(F.lit("'"), F.col("p"), F.lit("' in "), F.array_join(F.array_sort(F.collect_set("source")), ", ")).alias("leak"))
    return label.unionByName(shown.select("question_id", "leak")).distinct()


def phrase_problems(answer: Column, must: Column, any_of: Column, must_not: Column, answerable: Column) -> Column:
    """What an answer lacks, and what it must not say."""

    def problems(text: Column) -> Column:
        has = lambda p: contains_normalized(text, normalize(p))
        none = F.when((F.size(any_of) > 0) & ~F.exists(any_of, has), F.when(answerable, F.concat(F.lit("none of "), F.array_join(any_of, ", "))).otherwise(F.lit("does not say that the information is missing")))
        return F.concat(
            F.transform(F.filter(must, lambda p: ~has(p)), lambda p: F.concat(F.lit("missing "), p)),
            F.array_compact(F.array(none)),
            F.transform(F.filter(must_not, has), lambda p: F.concat(F.lit("contains "), p)),
        )

    # As a variable, the answer's normal form is made once and not for each phrase.
    return F.get(F.transform(F.array(normalize(answer)), problems), 0)


def citation_problems(answer: Column, shown: Column, expected: Column, answerable: Column, asked: Column, s: Settings = DEFAULT) -> Column:
    """What is wrong with an answer's citations; shown: the sources in order, asked: whether a model answered."""
    c = citations(answer, F.size(shown), s)
    not_found = c["not_found"] | ~asked
    files = F.transform(c["numbers"], lambda n: F.get(shown, n.cast("int") - 1))
    first = F.when(F.size(c["invalid"]) > 0, F.concat(F.lit("not in the source list: "), F.array_join(F.transform(c["invalid"], lambda n: n.cast("string")), ", ")))
    then = (
        F.when(~answerable & ~not_found, "not marked as not found")
        .when(~answerable, None)
        .when(not_found, "says the answer is not there")
        .when(F.size(c["numbers"]) == 0, "no citation")
        .when(~F.arrays_overlap(files, expected), "cites none of the expected files")
    )
    return F.array_compact(F.array(first, then))


def retrieval_status(r: dict[str, Column]) -> tuple[Column, Column]:
    """(status, diagnosis) of a search without an answer.

    r: leaks, missing, not_indexed (arrays), source_rank, answerable, off_topic, hits (a count)."""
    slipped = r["off_topic"] & (r["hits"] > 0)
    found = r["source_rank"].isNotNull() & (F.size(r["missing"]) == 0)
    status = F.when((F.size(r["leaks"]) > 0) | slipped, "fail").when(found | ~r["answerable"], "pass").otherwise("fail")
    return status, F.when(F.size(r["leaks"]) > 0, "LEAK").when(slipped, "not stopped").when(status == "pass", "").when(F.size(r["not_indexed"]) > 0, "reading").otherwise("retrieval")


def answer_status(r: dict[str, Column]) -> tuple[Column, Column, Column]:
    """(status, diagnosis, disagreement) of an answer; r as above, with phrase_problems (array) and verdict.

    A rejected request (column `rejected`) keeps its question's labels and is diagnosed as rejected."""
    slipped = r["off_topic"] & (r["hits"] > 0)
    fine = F.size(r["phrase_problems"]) == 0
    by_verdict = F.when(r["verdict"] == "correct", "pass").when(r["verdict"] == "partial", "partial").otherwise("fail")
    status = F.when((F.size(r["leaks"]) > 0) | slipped | r["rejected"], "fail").when(r["verdict"].isNotNull(), by_verdict).when(fine, "pass").otherwise("fail")
    diagnosis = (
        F.when(F.size(r["leaks"]) > 0, "LEAK")
        .when(r["rejected"], "rejected")
        .when(slipped, "not stopped")
        .when(status == "pass", "")
        .when(~r["answerable"], "made up an answer")
        .when(F.size(r["not_indexed"]) > 0, "reading")
        .when(r["source_rank"].isNull() | (F.size(r["missing"]) > 0), "retrieval")
        .otherwise("generation")
    )
    return status, diagnosis, r["verdict"].isNotNull() & (fine != (r["verdict"] == "correct"))


def confidential_problems(r: dict[str, Column], local: tuple[str, ...]) -> Column:
    """What went to a model that is not local although a source was confidential: any such answer or verdict fails a run.

    r: levels (of the sources shown), answered_by and judged_by (provider names, null or empty for none); local: providers
    inside the house."""
    outside = lambda who: (F.coalesce(who, F.lit("")) != "") & ~F.coalesce(who, F.lit("")).isin(*local)
    secret = F.arrays_overlap(r["levels"], F.array(*map(F.lit, DEFAULT.local_only)))
    told = lambda who, what: F.when(secret & outside(who), F.concat(F.lit(f"confidential sources were {what} "), who))
    return F.array_compact(F.array(told(r["answered_by"], "answered by"), told(r["judged_by"], "judged by")))


def judge_prompt(question: Column, expected: Column, answer: Column) -> Column:
    """What a judge is asked about an answer."""
    task = "Compare the answer with the expected one. Reply with JSON alone: {\"verdict\": \"correct\", \"partial\" or \"wrong\", \"reason\": one sentence}."
    return F.concat_ws("\n\n", F.lit(task), F.concat(F.lit("Question: "), question), F.concat(F.lit("Expected: "), expected), F.concat(F.lit("Answer: "), answer))


def judged(answers: DataFrame, ask) -> DataFrame:
    """Adds verdict, reason and judge_failed to answers (question, expected, answer); ask: prompt column to reply column.

    A reply that is no verdict leaves the verdict null and says so; without an answer no judge is asked."""
    reply = F.when(F.col("answer").isNotNull(), ask(judge_prompt(F.col("question"), F.col("expected"), F.col("answer"))))
    out = answers.withColumn("_reply", reply).withColumn("_said", verdict(F.col("_reply")))
    return out.withColumns({"verdict": F.col("_said.verdict"), "reason": F.col("_said.reason"), "judge_failed": F.col("answer").isNotNull() & F.col("_said").isNull()}).drop("_reply", "_said")


def unverified_label(found: Column) -> Column:
    """`fact (cited 1, stands in 2)` of an unverified fact."""
    numbers = lambda a: F.array_join(F.transform(a, lambda n: n.cast("string")), ", ")
    places = F.when(F.size(found["found_in"]) > 0, F.concat(F.lit("stands in "), numbers(found["found_in"]))).otherwise(F.lit("in no source"))
    return F.concat(found["fact"], F.lit(" (cited "), numbers(found["cited"]), F.lit(", "), places, F.lit(")"))


def ingested(text: Column, expected: Column) -> Column:
    """Whether a read document holds what is expected of it, anywhere in a word; after `re:` stands a pattern."""
    plain = F.contains(normalize(text), normalize(expected))
    return F.when(expected.startswith("re:"), F.regexp_like(text, F.substring(expected, 4, 10_000))).otherwise(plain)


def neighbours_overlap(chunks: DataFrame) -> DataFrame:
    """(source, chunk_index, overlaps): whether a chunk begins, below its first line, with words that end the one before."""
    body = F.regexp_replace("text", r"^\[[^\n]*\]\n", "")
    before = F.lag("body").over(Window.partitionBy("source").orderBy("chunk_index"))
    first = F.regexp_extract("body", r"(?s)^(.*?[.!?\u2026])(?:\s|$)", 1)
    rows = chunks.withColumn("body", body).withColumn("before", before).withColumn("first", first)
    return rows.select("source", "chunk_index", F.coalesce((F.col("first") != "") & F.col("before").isNotNull() & F.contains("before", "first"), F.lit(False)).alias("overlaps"))


def _n(condition: Column, name: str) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False))).alias(name)


def _mean(value: Column, digits: int, name: str) -> Column:
    return F.coalesce(F.round(F.avg(value), digits), F.lit(0.0)).alias(name)


def summarize(results: DataFrame, by: list[str] | None = None, s: Settings = DEFAULT) -> DataFrame:
    """One row of counts and means for a run (or for each group); means of nothing are 0."""
    c = F.col
    yes, evidence = c("answerable"), c("answerable") & (c("evidence_total") > 0)
    asked = c("answered_by") != ""
    measures = [
        F.count("*").alias("questions"), _n(c("status") == "pass", "pass"), _n(c("status") == "partial", "partial"), _n(c("status") == "fail", "fail"),
        _n(c("known_gap").isNotNull() & (c("status") != "pass"), "known_gaps_not_passed"), _n(yes, "answerable"), F.lit(s.top_k).alias("top_k"),
        _n(yes & (c("source_rank") == 1), "hit@1"), _n(yes & (c("source_rank") <= 3), "hit@3"), _n(yes & c("source_rank").isNotNull(), "hit@k"),
        _mean(F.when(yes, F.coalesce(1.0 / c("source_rank"), F.lit(0.0))), 3, "mrr"), _n(evidence, "with_evidence"), _n(evidence & (F.size("missing") == 0), "evidence_found"),
        _n(F.size("phrase_problems") == 0, "phrases_ok"), _n(c("verdict") == "correct", "verdict_correct"), _n(c("verdict") == "partial", "verdict_partial"), _n(c("verdict") == "wrong", "verdict_wrong"),
        _n(c("verdict").isNull(), "not_judged"), _n(c("disagreement"), "disagreements"), _n(F.size("citation_problems") == 0, "citations_ok"), _n(F.size("invalid_citations") > 0, "invalid_citations"),
        _mean(F.when(asked, F.size("citations")), 2, "avg_cited"), _n(~yes, "unanswerable"), _n(~yes & (c("status") == "pass"), "unanswerable_ok"), _n(c("off_topic"), "off_topic"),
        _n(c("off_topic") & (c("hits") == 0), "off_topic_stopped"), _n(c("hits") == 0, "no_sources"), _n(F.size("unverified") > 0, "unverified_answers"), _n(F.size("leaks") > 0, "leaks"),
        _mean(c("retrieval_ms"), 1, "avg_retrieval_ms"), _mean(F.when(asked, c("llm_ms") / 1000), 2, "avg_llm_s"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    ]
    return (results.groupBy(*by) if by else results.groupBy()).agg(*measures)


def by_type(results: DataFrame, key: str = "type") -> DataFrame:
    return results.groupBy(key).agg(*(_n(F.col("status") == v, v) for v in ("pass", "partial", "fail")))


_RANK = {"fail": 0, "partial": 1, "pass": 2}


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """(question_id, old_status, new_status, change) of two runs: fixed, broken, same, only old or only new."""
    level = lambda c: reduce(lambda acc, kv: acc.when(c == kv[0], kv[1]), list(_RANK.items())[1:], F.when(c == "fail", 0))
    both = old.select("question_id", F.col("status").alias("old_status")).join(new.select("question_id", F.col("status").alias("new_status")), "question_id", "full_outer")
    a, b = level(F.col("old_status")), level(F.col("new_status"))
    change = F.when(F.col("new_status").isNull(), "only old").when(F.col("old_status").isNull(), "only new").when(b > a, "fixed").when(b < a, "broken").otherwise("same")
    return both.withColumn("change", change)


def settings_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, old_value, new_value) of settings that differ, missing ones included."""
    both = old.select("key", F.col("value").alias("old_value")).join(new.select("key", F.col("value").alias("new_value")), "key", "full_outer")
    return both.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def needed_score(facts: DataFrame) -> DataFrame:
    """(question_id, needed): the threshold below which an answer keeps all its facts.

    facts: (question_id, fact, score), score null where no hit holds the fact; then nothing suffices."""
    best = facts.groupBy("question_id", "fact").agg(F.max("score").alias("best"))
    return best.groupBy("question_id").agg(F.when(F.count_if(F.col("best").isNull()) == 0, F.min("best")).alias("needed"))


def threshold_study(needed: DataFrame, off_topic: DataFrame) -> DataFrame:
    """The weakest answer, the strongest off-topic hit, and a tenth of the former rounded down to one digit."""
    weak = needed.agg(F.min("needed").alias("weakest"), F.min_by("question_id", F.struct("needed", "question_id")).alias("weakest_question"))
    strong = off_topic.agg(F.max("score").alias("strongest"), F.max_by("question_id", F.struct("score", "question_id")).alias("strongest_question"))
    return weak.crossJoin(strong).withColumn("suggested", round_down(F.col("weakest") / 10))


def first_answer_rank(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, answer_rank): the first hit whose text holds all evidence by itself."""
    both = hits.join(questions.select("question_id", "evidence"), "question_id").withColumn("t", normalize(F.col("text")))
    whole = F.forall("evidence", lambda a: F.exists(a, lambda p: contains_normalized(F.col("t"), normalize(p))))
    return both.groupBy("question_id").agg(F.min(F.when(whole, F.col("rank"))).alias("answer_rank"))


def rescored(saved: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(saved results with the current questions' rules, results whose question is gone)."""
    rules = questions.select("question_id", "type", "role", "answerable", "off_topic", "must_include", "any_of", "must_not", "sources")
    drop = [c for c in rules.columns if c in saved.columns and c != "question_id"]
    return saved.drop(*drop).join(rules, "question_id"), saved.join(rules, "question_id", "left_anti")
