"""Answers for many questions in one plan: prompts, routing, generation, verification; and providers with fallback."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.citations import citations, unverified
from skarn.functions.text import chunk_content, page_label, rewritten
from skarn.operators.logs import rewrite_prompt
from skarn.plugins import extractive_generator, routed
from skarn.runtime import ship, written
from skarn.settings import DEFAULT, Settings


def source_header(number: Column, source: Column) -> Column:
    """`[n] file > headings (pages, effective date, superseded, OCR)` of a source struct."""
    pages = page_label(source["page_start"], source["page_end"])
    details = F.concat_ws(
        ", ",
        F.when(pages != "", F.concat(F.lit("p. "), pages)),
        F.when(source["effective_date"].isNotNull(), F.concat(F.lit("effective "), source["effective_date"].cast("string"))),
        F.when(source["status"] == "superseded", F.concat(F.lit("SUPERSEDED by "), F.coalesce(source["replaced_by"], F.lit("?")))),
        F.when(source["ocr"], F.lit("read by OCR, may hold errors")),
    )
    where = F.concat_ws(" > ", source["source"], F.when(source["heading_path"] != "", source["heading_path"]))
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), where, F.when(details != "", F.concat(F.lit(" ("), details, F.lit(")"))).otherwise(F.lit("")))


def prompt(question: Column, sources: Column) -> Column:
    """The numbered sources without their context lines, then the question."""
    listed = F.transform(sources, lambda s, i: F.concat_ws("\n", source_header(i + 1, s), chunk_content(s["text"])))
    return F.concat(F.lit("Sources:\n\n"), F.array_join(listed, "\n\n"), F.lit("\n\nQuestion: "), question)


def with_sources(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """questions (question_id, question, ...) plus `sources`: their hits in order of rank, an empty array for none."""
    fields = ["rank", "source", "text", "heading_path", "page_start", "page_end", "access_level", "status", "effective_date", "replaced_by", "ocr"]
    listed = hits.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("sources"))
    empty = F.array().cast(listed.schema["sources"].dataType)
    return questions.join(listed, "question_id", "left").withColumn("sources", F.coalesce("sources", empty))


def answered(asked: DataFrame, generate: Callable[[Column, Column], Column] = extractive_generator, s: Settings = DEFAULT) -> DataFrame:
    """Adds route, prompt, answer, its citations and what could not be verified.

    Without a source no model is asked: answer and prompt are null and the route is `none`. Where any source is
    confidential the route is `local`, whoever generates has to respect it."""
    some = F.size("sources") > 0
    texts = F.transform("sources", lambda x: x["text"])
    levels = F.transform("sources", lambda x: x["access_level"])
    out = asked.withColumns(
        {
            "route": F.when(~some, "none").otherwise(routed(levels, s.local_only)),
            "prompt": F.when(some, prompt(F.col("question"), F.col("sources"))),
            "answer": F.when(some, generate(F.col("question"), F.transform(texts, chunk_content))),
        }
    )
    text = F.coalesce("answer", F.lit(""))
    return out.withColumns({"citations": citations(text, F.size("sources"), s), "unverified": unverified(text, texts, F.col("question"), s)})


def standalone(turns: DataFrame, rewrite: Callable[[Column], Column]) -> DataFrame:
    """Adds `searched_as` to questions with history: the rewriter's reply if it is usable, else the question; a first
    question is never rewritten."""
    reply = rewrite(rewrite_prompt(F.col("history"), F.col("question")))
    return turns.withColumn("searched_as", F.when(F.size("history") > 0, rewritten(reply, F.col("question"))).otherwise(F.col("question")))


class Unavailable(RuntimeError):
    """A provider cannot be reached, is busy, or replied with nothing: the next one may be tried."""


class NoProvider(RuntimeError):
    """No provider of a route could answer."""


@dataclass(frozen=True)
class Provider:
    name: str
    call: Callable[[list[dict]], str]
    local: bool = False


@dataclass(frozen=True)
class Reply:
    text: str
    provider: str
    #: Why earlier providers of the route were passed over.
    passed: tuple[str, ...] = ()


def with_retries(call: Callable[[], str], attempts: int = 3, first_wait: float = 1.0, most_wait: float = 8.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Calls again after Unavailable, waiting twice as long each time."""
    for i in range(attempts):
        try:
            return call()
        except Unavailable:
            if i + 1 == attempts:
                raise
            sleep(min(most_wait, first_wait * 2**i))
    raise AssertionError


def generate(messages: list[dict], route: list[Provider], local_only: bool = False) -> Reply:
    """The first provider's reply; the next is asked only if one is unavailable. Any other error ends the call.

    With local_only the route holds local providers alone; if there is none, nothing is sent anywhere."""
    usable = [p for p in route if p.local or not local_only]
    passed: list[str] = []
    for p in usable:
        try:
            text = p.call(messages).strip()
            if not text:
                raise Unavailable("empty reply")
            return Reply(text, p.name, tuple(passed))
        except Unavailable as e:
            passed.append(f"{p.name}: {e}")
    raise NoProvider("; ".join(passed) or "no local provider")


class Journal:
    """Replies by prompt in a shared folder, each written aside and put in place by a rename, so that a reply that was paid
    for outlives the task that asked; and one moment before which nobody asks again. Any store that pyarrow knows."""

    def __init__(self, path: str):
        self.path = path

    def _at(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)

    def _read(self, name: str) -> dict | None:
        store, root = self._at()
        try:
            with store.open_input_stream(f"{root}/{name}.json") as f:
                return json.loads(f.readall())
        except (FileNotFoundError, json.JSONDecodeError):
            return None

    def _write(self, name: str, value: dict) -> None:
        store, root = self._at()
        store.create_dir(root, recursive=True)
        aside = f"{root}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(aside) as f:
            f.write(json.dumps(value).encode())
        store.move(aside, f"{root}/{name}.json")

    def get(self, key: str) -> Reply | None:
        found = self._read(key)
        return Reply(found["text"], found["provider"], tuple(found["passed"])) if found else None

    def put(self, key: str, reply: Reply) -> None:
        self._write(key, {"text": reply.text, "provider": reply.provider, "passed": reply.passed})

    def hold(self, seconds: float) -> None:
        """Nobody asks for so long: a provider is busy."""
        self._write("hold", {"until": max(time.time() + seconds, self.held())})

    def held(self) -> float:
        return (self._read("hold") or {"until": 0.0})["until"]


class Pace:
    """Calls of one lane at even distances, and none before the moment that all lanes wait for."""

    def __init__(self, seconds: float, journal: Journal | None = None):
        self.seconds, self.journal, self.next = seconds, journal, 0.0

    def wait(self, sleep: Callable[[float], None] = time.sleep) -> None:
        while (now := time.time()) < (until := max(self.next, self.journal.held() if self.journal else 0.0)):
            sleep(until - now)
        self.next = time.time() + self.seconds


def generated(prompts: DataFrame, route: list[Provider], attempts: int = 3, first_wait: float = 1.0, journal: str | None = None, calls_per_second: float | None = None, lanes: int = 8) -> DataFrame:
    """Adds reply, provider, passed (why others were passed over) and error to rows (prompt, local_only).

    Each prompt is asked on an executor, with retries and fallback; what no provider could answer has an error and no reply,
    so one row never stops the others. A null prompt is not sent anywhere.

    With a journal (a folder that executors share) or a rate, a prompt that many rows have is asked once, by one of so many
    lanes, which share the rate among them and wait together when a provider is busy. Replies in the journal are not asked
    for again, whatever became of the task that asked; errors are not kept."""
    if journal is None and calls_per_second is None:
        return _asked(prompts, route, attempts, first_wait, None, 0.0)
    ship(prompts.sparkSession)
    same = F.sha2(F.concat_ws("|", F.coalesce("local_only", F.lit(False)).cast("string"), "prompt").cast("binary"), 256)
    keyed = prompts.withColumn("_asked", F.when(F.col("prompt").isNotNull(), same))
    once = keyed.where("_asked is not null").groupBy("_asked").agg(F.first("prompt").alias("prompt"), F.first("local_only").alias("local_only"))
    lane = F.pmod(F.xxhash64("_asked"), F.lit(lanes)).cast("int")
    replies = _asked(once.withColumn("lane", lane).repartitionById(lanes, "lane").drop("lane"), route, attempts, first_wait, journal, lanes / calls_per_second if calls_per_second else 0.0)
    return keyed.join(written(replies.drop("prompt", "local_only"), "replies"), "_asked", "left").drop("_asked").withColumn("passed", F.coalesce("passed", F.expr("cast(array() as array<string>)")))


def _asked(prompts: DataFrame, route: list[Provider], attempts: int, first_wait: float, journal: str | None, apart: float) -> DataFrame:
    """Rows with their replies, in the tasks where they are; apart: seconds between a task's calls at least."""
    ship(prompts.sparkSession)
    names = prompts.columns
    place = {c: names.index(c) for c in ("prompt", "local_only")}

    def run(it):
        import pyarrow as pa

        book = Journal(journal) if journal else None
        pace = Pace(apart, book)

        def call(p: Provider, messages: list[dict]) -> str:
            pace.wait()
            return p.call(messages)

        def pause(seconds: float) -> None:
            book.hold(seconds) if book else time.sleep(seconds)

        def ask(key: str | None, text: str, local: bool) -> tuple[str | None, str | None, list[str], str | None]:
            r = book.get(key) if book else None
            try:
                if r is None:
                    r = generate([{"role": "user", "content": text}], [Provider(p.name, lambda m, p=p: with_retries(lambda: call(p, m), attempts, first_wait, sleep=pause), p.local) for p in route], local)
                    if book:
                        book.put(key, r)
                return r.text, r.provider, list(r.passed), None
            except Exception as e:  # noqa: BLE001  one row's failure is that row's result
                return None, None, [], f"{type(e).__name__}: {e}"

        for batch in it:
            keys = batch.column(names.index("_asked")).to_pylist() if book else [None] * batch.num_rows
            said = [ask(k, t, bool(x)) if t is not None else (None, None, [], None) for k, t, x in zip(keys, batch.column(place["prompt"]).to_pylist(), batch.column(place["local_only"]).to_pylist(), strict=True)]
            cols = list(zip(*said, strict=True)) or [[], [], [], []]
            kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*names, "reply", "provider", "passed", "error"])

    schema = prompts.withColumns({"reply": F.lit(None).cast("string"), "provider": F.lit(None).cast("string"), "passed": F.lit(None).cast("array<string>"), "error": F.lit(None).cast("string")}).schema
    return prompts.mapInArrow(run, schema)
