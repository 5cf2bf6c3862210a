"""Reports over the question log, and conversation history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.settings import DEFAULT, Settings

SCHEMA = (
    "time timestamp_ntz, user string, role string, question string, searched_as string, "
    "sources array<struct<source:string,heading:string,score:double,access_level:string>>, cited array<int>, invalid_citations array<int>, "
    "not_found boolean, llm_asked boolean, model string, fallback string, confidential boolean, unverified array<string>, "
    "retrieval_ms double, llm_ms double, rewrite_ms double, error string"
)


def asked(said: DataFrame, role: str, user: str | None, s: Settings = DEFAULT) -> DataFrame:
    """Log rows of answered questions (question, sources, answer, citations, unverified)."""
    empty = said.sparkSession.createDataFrame([], SCHEMA)
    confidential = F.exists("sources", lambda x: x["access_level"].isin(*s.local_only))
    rows = said.select(
        F.current_timestamp().cast("timestamp_ntz").alias("time"), F.lit(user).cast("string").alias("user"), F.lit(role).alias("role"), "question", F.col("question").alias("searched_as"),
        F.transform("sources", lambda x: F.struct(x["source"].alias("source"), x["heading_path"].alias("heading"), F.lit(None).cast("double").alias("score"), x["access_level"].alias("access_level"))).alias("sources"),
        F.transform("citations.numbers", lambda n: n.cast("int")).alias("cited"), F.transform("citations.invalid", lambda n: n.cast("int")).alias("invalid_citations"), "citations.not_found", F.col("answer").isNotNull().alias("llm_asked"),
        confidential.alias("confidential"), F.transform("unverified", lambda u: u["fact"]).alias("unverified"),
    )
    return empty.unionByName(rows, allowMissingColumns=True)


def outcome() -> Column:
    return F.when(F.col("error").isNotNull(), "error").when(~F.coalesce("llm_asked", F.lit(False)), "nothing found").when(F.coalesce("not_found", F.lit(False)), "not found").otherwise("answered")


def summary(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of outcomes, flags and users, and mean times (a time of 0 is none)."""
    c = F.col
    n = lambda cond, name: F.count_if(F.coalesce(cond, F.lit(False))).alias(name)
    mean = lambda col: F.round(F.avg(F.when(c(col) > 0, c(col))), 1).alias(f"avg_{col}")
    rows = log.withColumn("outcome", outcome())
    return (rows.groupBy(*by) if by else rows.groupBy()).agg(
        F.count("*").alias("questions"), *(n(c("outcome") == v, v.replace(" ", "_")) for v in ("answered", "not found", "nothing found", "error")),
        n(c("confidential"), "confidential"), n(c("searched_as").isNotNull(), "rewritten"), n(c("fallback").isNotNull(), "fallback"), n(F.size("unverified") > 0, "unverified"),
        mean("retrieval_ms"), mean("llm_ms"), mean("rewrite_ms"), F.count_distinct("user").alias("users"),
    )


def gaps(log: DataFrame, k: int = 20) -> DataFrame:
    """The questions most often left without an answer: a top-k report."""
    rows = log.withColumn("outcome", outcome()).where(F.col("outcome").isin("not found", "nothing found"))
    return rows.groupBy(F.trim("question").alias("question")).agg(F.count("*").alias("times")).orderBy(F.desc("times"), "question").limit(k)


def errors(log: DataFrame) -> DataFrame:
    return log.where("error is not null").groupBy("error").agg(F.count("*").alias("times"))


def last(log: DataFrame, n: int) -> DataFrame:
    return log.orderBy(F.desc("time"), "user", "question").limit(n)


def with_history(turns: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(conv_id, turn, question, history): every user question with the last earlier ones, blanks left out."""
    asked = turns.where((F.col("role") == "user") & (F.trim("text") != "")).select("conv_id", "turn", F.col("text").alias("question"))
    return asked.withColumn("history", F.expr(f"collect_list(question) over (partition by conv_id order by turn rows between {s.history} preceding and 1 preceding)"))


def rewrite_prompt(history, question) -> Column:
    """The earlier questions numbered, then the last one."""
    lines = F.transform(history, lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q))
    return F.concat(F.array_join(lines, "\n"), F.lit("\n\n"), question)
