"""Answering whole sets of questions: models behind interfaces, their calls made batch by batch on the executors.

A model is anything with ``complete(system, user)``; what it is asked, what is
wrong with its answers, whether it may try again, and what is kept of them is
decided here. Calls that judge are remembered in a table by a hash of all they
depend on, so that a run that is repeated asks for the missing ones only.
"""

from __future__ import annotations

import functools
import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import text as T
from ..hooks import LLMBackend
from ..operators import answers, ranking, structured
from ..sources import stores
from . import retrieval

# What a judge may say.
VERDICTS = ("supported", "partially_supported", "unsupported")
#: A model's exceptions that are worth another try, by name.
PASSING = ("RateLimitError", "TimeoutError", "ConnectionError", "APIConnectionError", "APITimeoutError", "InternalServerError")


# ---- calls ------------------------------------------------------------------


@dataclass
class Limited:
    """A model whose calls keep a budget a minute and are tried again when what failed may pass.

    One in each worker: give it the budget's share. A delay that the server names (an
    exception's ``retry_after``) counts before the doubled one.
    """

    inner: LLMBackend
    attempts: int = 3
    backoff: float = 1.0
    per_minute: int | None = None
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    calls: list[float] = field(default_factory=list)

    def complete(self, system: str, user: str) -> str:
        for attempt in range(self.attempts):
            self._wait()
            try:
                return self.inner.complete(system, user)
            except Exception as error:
                if attempt + 1 == self.attempts or type(error).__name__ not in PASSING:
                    raise
                self.sleep(float(getattr(error, "retry_after", None) or self.backoff * 2**attempt))
        raise AssertionError("unreachable")

    def _wait(self) -> None:
        if self.per_minute is None:
            return
        now = self.clock()
        self.calls = [t for t in self.calls if now - t < 60.0]
        if len(self.calls) >= self.per_minute:
            self.sleep(60.0 - (now - self.calls[0]))
            now = self.clock()
        self.calls.append(now)


def completed(rows: DataFrame, make: Callable[[], LLMBackend], key: str, system: str = "system", user: str = "user") -> DataFrame:
    """(key, answer, finish_reason, latency_ms, error): a model's answers, made once a worker; a failed call is a row with its error."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            out = []
            for k, s, u in zip(pdf[key], pdf[system], pdf[user]):
                began = time.perf_counter()
                try:
                    got = model.complete(s or "", u or "")
                    text, reason, error = (got, "stop", None) if isinstance(got, str) else (got[0], got[1], None)
                except Exception as failure:  # noqa: BLE001  told in the row
                    text, reason, error = None, None, f"{type(failure).__name__}: {failure}"
                out.append((k, text, reason, (time.perf_counter() - began) * 1000.0, error))
            yield pd.DataFrame(out, columns=[key, "answer", "finish_reason", "latency_ms", "error"])

    return rows.select(key, system, user).mapInPandas(run, f"{key} {kind}, answer string, finish_reason string, latency_ms double, error string")


def repair_prompt(user: Column, answer: Column, failures: Column) -> Column:
    """What a model is asked when its answer failed: the task again, the failures, and the answer."""
    told = F.concat(F.lit("\n\nYour previous answer failed deterministic validation. Return a complete corrected answer only; do not discuss the repair.\nFailures: "), F.to_json(failures))
    return F.concat(user, told, F.lit("\nPrevious answer:\n"), F.coalesce(answer, F.lit("")))


# ---- answers ------------------------------------------------------------------


def answer(prompts: DataFrame, make: Callable[[], LLMBackend], key: str = "query_id", required: Sequence[str] = (), most: int | None = None, narrative: bool = False, ledger: str | None = None) -> DataFrame:
    """(key, answer, structured, finish_reason, final_attempt, failures, retry_count, latency_ms): each question answered, and once more if its answer is not valid.

    prompts: key, system, user, known (the citation numbers of its context). With ``narrative``
    the model answers in JSON, which is checked and rendered. Both attempts are written
    to a ledger before they are judged, so a model is not asked twice for the same;
    one at a path of the caller's choice is known to later runs.
    """
    ledger = ledger or stores.new_path(prompts.sparkSession, "ledger")

    def checked(calls: DataFrame) -> DataFrame:
        rows = calls.join(prompts.select(key, "system", "user", "known"), key)
        draft = F.coalesce("answer", F.lit(""))
        if narrative:
            wrong = structured.narrative_failures(draft, F.col("known"))
            rows = rows.withColumn("structured", F.when(F.size(wrong) == 0, structured.draft(draft))).withColumn("_text", F.when(F.size(wrong) == 0, structured.narrative_markdown(draft)).otherwise(draft))
        else:
            wrong = F.array().cast("array<string>")
            rows = rows.withColumn("structured", F.lit(None).cast("string")).withColumn("_text", draft)
        failed = F.when(F.col("error").isNotNull(), F.array(F.concat(F.lit("model_error:"), F.col("error")))).otherwise(F.array().cast("array<string>"))
        codes = structured.response_failures(F.col("_text"), F.col("finish_reason"), F.col("structured"), F.col("known"), required, most)
        return rows.withColumn("failures", F.array_distinct(F.concat(failed, wrong, codes)))

    first = checked(once(prompts, make, key, ledger))
    again = first.where(F.size("failures") > 0).select(key, "system", repair_prompt(F.col("user"), F.col("answer"), F.col("failures")).alias("user"))
    second = checked(once(again, make, key, ledger))
    columns = [key, F.col("_text").alias("answer"), "structured", "finish_reason", "failures", "latency_ms"]
    good = first.where(F.size("failures") == 0).select(*columns, F.lit("original").alias("final_attempt"), F.lit(0).alias("retry_count"))
    return good.unionByName(second.select(*columns, F.lit("repaired").alias("final_attempt"), F.lit(1).alias("retry_count")))


def _kept(rows: DataFrame) -> DataFrame:
    """Rows, written down so that they are not made again."""
    return stores.kept(rows, "generation")


def once(rows: DataFrame, make: Callable[[], LLMBackend], key: str, ledger: str, model: str = "", system: str = "system", user: str = "user") -> DataFrame:
    """As completed, with each call made once: answers are written to ``ledger``, a store, before any is used.

    A call is what it asks, and of which model; rows that ask the same share one
    answer, and one that the ledger has is not asked again, by this run or a later
    one. Failed calls are told, and asked again by a later run.
    """
    spark = rows.sparkSession
    asked = rows.select(key, F.coalesce(F.col(system), F.lit("")).alias("system"), F.coalesce(F.col(user), F.lit("")).alias("user"))
    asked = asked.withColumn("call", F.sha2(F.to_json(F.struct(F.lit(model).alias("model"), "system", "user")), 256))
    known = stores.latest(spark, ledger, "call")
    todo = asked.dropDuplicates(["call"])
    todo = todo if known is None else todo.join(known.where("error IS NULL").select("call"), "call", "left_anti")
    stores.upsert(completed(todo, make, "call"), ledger, "call")
    return asked.select(key, "call").join(stores.latest(spark, ledger, "call"), "call").drop("call")


def formatted(answered: DataFrame, assembled: DataFrame, key: str = "query_id") -> DataFrame:
    """answered with sources (of the citations in the answer, in their order), unknown_citations, citations_valid and context_chunk_ids.

    assembled: key, citation_number, chunk_id, paper_id, title, section.
    """
    source = F.struct("citation_number", "paper_id", "chunk_id", "title", "section")
    listed = assembled.groupBy(key).agg(F.array_sort(F.collect_list(source)).alias("_s"))
    rows = answered.join(listed, key, "left").withColumn("_s", F.coalesce("_s", F.array().cast(listed.schema["_s"].dataType)))
    rows = rows.withColumn("known", F.transform("_s", lambda x: x["citation_number"].cast("int")))
    checked = answers.check_citations(rows, "answer", "known")
    sources = F.transform(F.array_intersect("cited", "known"), lambda n: F.element_at(F.filter("_s", lambda x: x["citation_number"] == n), 1))
    made = checked.withColumns({"sources": sources, "context_chunk_ids": F.transform("_s", lambda x: x["chunk_id"]), "unknown_citations": F.col("unknown")})
    valid = (F.size("unknown") == 0) & (F.size(T.native_citations("answer")) == 0) & ((F.size("known") == 0) | (F.size("cited") > 0))
    return made.withColumn("citations_valid", valid).drop("_s", "known", "cited", "unknown", "unused", "valid")


def abstains(structured_: Column, n_sources: Column) -> Column:
    """Whether an answer gives up: its structure says so, or it has no sources."""
    status = F.lower(F.get_json_object(structured_, "$.answer_status"))
    return F.coalesce(status == structured.STATUSES[1], F.lit(False)) | (F.coalesce(n_sources, F.lit(0)) <= 0)


def generate(questions: DataFrame, ranked: DataFrame, chunks: DataFrame, make: Callable[[], LLMBackend], system: str, user: str, budget: int = 2500, **options) -> DataFrame:
    """Questions answered from their rankings: contexts assembled, prompts rendered, answers checked, repaired once and formatted.

    user is a template with {{ question }} and {{ context }}.
    """
    # Rankings and contexts are small, and read several times.
    packed = _kept(retrieval.assemble(_kept(ranked), chunks, budget))
    told = packed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.col("citation_number").cast("int"))).alias("known"))
    rows = questions.select("query_id", "text").join(retrieval.contexts(packed), "query_id", "left").join(told, "query_id", "left")
    prompts = rows.select(
        "query_id", F.lit(system).alias("system"), stores.rendered(user, question=F.col("text"), context=F.coalesce("context", F.lit(""))).alias("user"), F.coalesce("known", F.array().cast("array<int>")).alias("known")
    )
    return formatted(answer(prompts, make, **options), packed)


def chat(
    questions: DataFrame, corpus: retrieval.Corpus, titles: DataFrame, make: Callable[[], LLMBackend], system: str, user: str,
    enrich: Callable[[DataFrame], DataFrame | None] | None = None, reranker: retrieval.Reranker | None = None, **options,
) -> DataFrame:
    """Each question routed, answered, and, if its answer abstains, answered once more over a corpus that was enriched for it: answered_by is original or enriched.

    Questions that name several papers are searched paper by paper, the others at once.
    What was fetched is searched with the whole corpus and by itself, and both rankings
    are dealt in turn: however many chunks of the corpus rank before it, copies of what
    did not answer among them, they do not keep it from the second answer.
    """
    def placed(rows: DataFrame, over: retrieval.Corpus) -> DataFrame:
        return retrieval.route(rows, over, titles, reranker=reranker).select("query_id", "chunk_id", F.col("position").alias("rank"))

    def answered(rows: DataFrame, ranked: DataFrame, over: retrieval.Corpus) -> DataFrame:
        return generate(rows, ranked, over.chunks, make, system, user, **options)

    def with_chunks(chunks: DataFrame) -> retrieval.Corpus:
        made = retrieval.Corpus(chunks, None, corpus.embed)
        return made if corpus.vectors is None else made.with_vectors()

    first = _kept(answered(questions, placed(questions, corpus), corpus))
    if enrich is None:
        return first.withColumn("answered_by", F.lit("original"))
    gave_up = first.where(abstains(F.col("structured"), F.size("sources"))).select("query_id")
    poor = questions.join(gave_up, "query_id", "left_semi")
    more = None if poor.isEmpty() else enrich(poor)
    if more is None:
        return first.withColumn("answered_by", F.lit("original"))
    # Fetched once, and read by both searches and for the contexts.
    new = _kept(more.join(corpus.chunks.select("chunk_id"), "chunk_id", "left_anti").dropDuplicates(["chunk_id"]))
    wider = with_chunks(corpus.chunks.unionByName(new, allowMissingColumns=True))
    lists = placed(poor, with_chunks(new)).withColumn("source", F.lit(0)).unionByName(placed(poor, wider).withColumn("source", F.lit(1)))
    dealt = ranking.round_robin(lists, key="chunk_id").select("query_id", "chunk_id", F.col("position").alias("rank"))
    second = answered(poor, dealt, wider)
    return first.join(gave_up, "query_id", "left_anti").withColumn("answered_by", F.lit("original")).unionByName(second.withColumn("answered_by", F.lit("enriched")))


# ---- judges -------------------------------------------------------------------


def verdicts(raw: Column, expected: Column) -> Column:
    """A judge's verdicts (subject_id, check, verdict, rationale) from its JSON; null unless there is exactly one valid one for every expected subject."""
    text = structured.without_fence(raw)
    found = F.from_json(F.get_json_object(text, "$.verdicts"), "array<struct<subject_id: string, check: string, verdict: string, rationale: string>>")
    clean = F.transform(found, lambda v: F.struct(F.trim(v["subject_id"]).alias("subject_id"), v["check"].alias("check"), F.lower(F.trim(v["verdict"])).alias("verdict"), v["rationale"].alias("rationale")))
    subjects = F.transform(clean, lambda v: v["subject_id"])
    whole = F.forall(clean, lambda v: F.coalesce(v["verdict"].isin(*VERDICTS), F.lit(False))) & (F.array_sort(subjects) == F.array_sort(expected))
    return F.when(F.coalesce(whole, F.lit(False)), clean)


def judge(cases: DataFrame, make: Callable[[], LLMBackend], cache: str, model: str, under_test: str, rubric: str = "atomic-evidence-v2", system: str = "Judge by the evidence given, and nothing else. Return JSON with a verdicts array.") -> DataFrame:
    """(case_id, judge_status, verdicts, cached): cases judged once, whatever the number of runs.

    cases: case_id, payload (JSON: question, answer, evidence, subjects), subjects (their
    ids). A case's key is a hash of all that its verdict depends on. A judge that
    answers out of form is asked once more; what still fails is unjudged, and is
    asked again by the next run, as only judged cases are kept below ``cache``.
    """
    if not model.strip() or model.strip() == under_test.strip():
        raise ValueError("the judge must be another model than the one under test")
    spark = cases.sparkSession
    parts = F.to_json(F.struct(F.col("case_id").cast("string").alias("id"), "payload", F.lit(model).alias("judge"), F.lit(under_test).alias("tested"), F.lit(rubric).alias("rubric"), F.lit(system).alias("system")))
    keyed = cases.withColumn("key", F.sha2(parts, 256))
    known = stores.latest(spark, cache, "key")
    found = keyed.join(known, "key") if known is not None else None
    todo = keyed if known is None else keyed.join(known.select("key"), "key", "left_anti")

    def called(rows: DataFrame) -> DataFrame:
        got = completed(rows.select("key", F.lit(system).alias("system"), F.col("payload").alias("user")), make, "key")
        got = _kept(got)
        return rows.join(got.select("key", "answer"), "key").withColumn("verdicts", verdicts(F.col("answer"), F.col("subjects")))

    first = called(todo)
    again = first.where("verdicts IS NULL").drop("answer", "verdicts")
    hint = F.lit("\n\nYour previous response was not valid judge JSON. Return only one JSON object containing a verdicts array; do not include Markdown or commentary.")
    second = called(again.withColumn("payload", F.concat("payload", hint)))
    done = first.where("verdicts IS NOT NULL").select("key", "verdicts").unionByName(second.where("verdicts IS NOT NULL").select("key", "verdicts"))
    stores.upsert(done, cache, "key")
    now = stores.latest(spark, cache, "key")
    before = found.select("case_id", "key", F.lit(True).alias("cached")) if found is not None else keyed.select("case_id", "key", F.lit(True).alias("cached")).limit(0)
    rows = keyed.select("case_id", "key").join(now, "key", "left").join(before.select("key", "cached"), "key", "left")
    status = F.when(F.col("verdicts").isNull(), "unjudged").otherwise("judged")
    return rows.select("case_id", status.alias("judge_status"), "verdicts", F.coalesce("cached", F.lit(False)).alias("cached"))


def support_payload(claims: DataFrame, evidence: DataFrame, key: str = "query_id") -> DataFrame:
    """(case_id, payload, subjects) for a judge of claims: claims (key, claim_id, claim, citations) and the evidence (key, n, text) that they may cite."""
    listed = claims.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("claim_id", "claim", "citations"))).alias("claims"))
    given = evidence.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("n").alias("citation_number"), "text"))).alias("evidence"))
    rows = listed.join(given, key, "left")
    return rows.select(F.col(key).alias("case_id"), F.to_json(F.struct("claims", "evidence")).alias("payload"), F.transform("claims", lambda c: c["claim_id"]).alias("subjects"))


def score_metrics(rows: DataFrame, metrics: Mapping[str, Callable[[], LLMBackend]], log: str, fallback: Callable[[], LLMBackend] | None = None, key: str = "question_id", run: str = "run") -> DataFrame:
    """The log (question_id, metric, status, value, reason, seq) of a run of model-scored metrics, each entry written as soon as its metric is done.

    rows: key, system, user. A metric's model answers {"score": x}; what fails or is out of form
    goes to the fallback judge, and then is unavailable with its reason, not zero.
    Entries that are terminal (completed, unavailable) are not asked for again.
    """
    spark = rows.sparkSession
    for metric, make in metrics.items():
        before = stores.latest(spark, log, "entry")
        entry = F.concat_ws("/", F.lit(run), F.lit(metric), F.col(key).cast("string"))
        todo = rows.withColumn("entry", entry)
        todo = todo if before is None else todo.join(before.select("entry"), "entry", "left_anti")
        number = max(stores.batches(spark, log), default=0) + 1

        def scored(asked: DataFrame, model: Callable[[], LLMBackend]) -> DataFrame:
            got = _kept(completed(asked.select("entry", "system", "user"), model, "entry"))
            value = F.get_json_object(structured.without_fence("answer"), "$.score").try_cast("double")
            reason = F.coalesce("error", F.when(T.is_truncated("finish_reason"), F.lit("truncated")), F.when(T.finite(value).isNull(), F.lit("no valid score")))
            return asked.join(got.select("entry", F.when(reason.isNull(), value).alias("value"), reason.alias("reason")), "entry")

        first = scored(todo, make)
        if fallback is not None:
            other = scored(first.where("value IS NULL").select("entry", key, "system", "user"), fallback)
            out = first.where("value IS NOT NULL").select("entry", key, "value", "reason").unionByName(other.select("entry", key, "value", "reason"))
        else:
            out = first.select("entry", key, "value", "reason")
        status = F.when(F.col("value").isNull(), "unavailable").otherwise("completed")
        made = out.select("entry", F.col(key).alias("question_id"), F.lit(metric).alias("metric"), status.alias("status"), "value", "reason", F.lit(number).cast("long").alias("seq"))
        stores.upsert(made, log, "entry")
    return stores.latest(spark, log, "entry").where(F.col("entry").startswith(f"{run}/")).drop("entry")


# ---- health -------------------------------------------------------------------


def readiness(probes: Mapping[str, Callable[[], object]], limit: float = 1.5, clock: Callable[[], float] = time.monotonic) -> dict[str, object]:
    """Whether every part answers, each within the limit: status ready or degraded, and what each part said."""
    from concurrent.futures import ThreadPoolExecutor

    checks: dict[str, dict[str, object]] = {}
    pool = ThreadPoolExecutor(max(1, len(probes)))
    running = {name: (pool.submit(probe), clock()) for name, probe in probes.items()}
    for name, (future, began) in running.items():
        try:
            got = future.result(timeout=max(0.0, limit - (clock() - began)))
            checks[name] = {"ok": got is not False, "detail": "" if got in (None, True, False) else str(got)}
        except Exception as error:  # noqa: BLE001  what a probe failed with is its answer
            checks[name] = {"ok": False, "detail": type(error).__name__ if not str(error) else f"{type(error).__name__}: {error}"}
    pool.shutdown(wait=False, cancel_futures=True)
    return {"status": "ready" if all(c["ok"] for c in checks.values()) else "degraded", "checks": checks}


def health(checks: Mapping[str, Column]) -> Column:
    """The status that checks add up to, row by row: ready, or degraded if one fails or is not known."""
    good = functools.reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for c in checks.values()), F.lit(True))
    return F.when(good, "ready").otherwise("degraded")


def safe_json(value: Column, schema: str) -> Column:
    """A struct of that schema as JSON; numbers that are not finite become null, as null fields are written."""
    def finite(c: Column, kind: ST.DataType) -> Column:
        if isinstance(kind, (ST.DoubleType, ST.FloatType)):
            return T.finite(c)
        if isinstance(kind, ST.ArrayType):
            return F.transform(c, lambda x: finite(x, kind.elementType))
        if isinstance(kind, ST.StructType):
            return F.when(c.isNotNull(), F.struct(*[finite(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return c

    return F.to_json(finite(value, ST.StructType.fromDDL(schema)), {"ignoreNullFields": "false"})


def json_safe(value: object) -> object:
    """A value as JSON can hold it: numbers that are not finite become null, what has no form its text."""
    return json.loads(json.dumps(value, default=str, allow_nan=True), parse_constant=lambda _: None)
