"""States of a question's turn in its page's context, and the trace of how it was answered.

All are projections: a context's row (see store.CONTEXT), or a trace, goes in and the next state comes out. Times are columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.reading import request_text

TRACE_VERSION = 1
INTERRUPTED = "the answer was interrupted"


def rested() -> Column:
    """The status of a page that answers nothing."""
    return F.when(F.coalesce("is_partial", F.lit(False)), "partial").otherwise("ready")


def _changed(contexts: DataFrame, where: Column, now: Column, **changes: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return contexts.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in {**changes, "updated_at": now.cast("long")}.items()})


def complete_turn(contexts: DataFrame, answer: Column, now: Column) -> DataFrame:
    """An answer (a message, null where there is none) ends the turn: it is appended and the focus is gone."""
    return _changed(contexts, answer.isNotNull(), now, status=rested(), focus=F.lit(None).cast(contexts.schema["focus"].dataType), messages=F.concat("messages", F.array(answer)))


def _marked(question: Column, **changes) -> Column:
    """The messages, with changed fields of the one with this id."""

    def one(m: Column) -> Column:
        out = m
        for name, value in changes.items():
            out = out.withField(name, value(m))
        return F.when(m["id"] == question, out).otherwise(m)

    return F.transform("messages", one)


def set_trace(contexts: DataFrame, question: Column, trace: Column, now: Column) -> DataFrame:
    return _changed(contexts, question.isNotNull(), now, messages=_marked(question, trace=lambda m: trace))


def fail_turn(contexts: DataFrame, question: Column, now: Column) -> DataFrame:
    """The question with this id is in error, the page can be asked again."""
    return _changed(contexts, question.isNotNull(), now, status=rested(), messages=_marked(question, error=lambda m: F.lit(True)))


def recover_turn(contexts: DataFrame, now: Column, interrupted=lambda trace: trace) -> DataFrame:
    """Contexts left answering: the last question is in error, its trace (if any) goes through `interrupted`."""
    last = F.try_element_at(F.filter("messages", lambda m: m["role"] == "user"), F.lit(-1))["id"]
    marked = _marked(last, error=lambda m: F.lit(True), trace=lambda m: F.when(m["trace"].isNotNull(), interrupted(m["trace"])))
    return _changed(contexts, F.col("status") == "answering", now, status=rested(), messages=F.when(last.isNull(), F.col("messages")).otherwise(marked))


def retained_traces(messages: Column, most: int = 10) -> Column:
    """Messages of which only the last questions with a trace keep it; none with most = 0."""
    traced = F.transform(F.filter(messages, lambda m: (m["role"] == "user") & m["trace"].isNotNull()), lambda m: m["id"])
    kept = F.slice(traced, F.greatest(F.size(traced) - most + 1, F.lit(1)), most) if most > 0 else F.array().cast("array<string>")
    return F.transform(messages, lambda m: F.when(m["trace"].isNotNull() & ~F.array_contains(kept, m["id"]), m.withField("trace", F.lit(None).cast("string"))).otherwise(m))


# --- traces ------------------------------------------------------------------------------------------------------


def new_trace(question: Column, article: Column, focus: Column, retrieval: Column, memory: Column, now: Column) -> Column:
    """The trace of a question that is being prepared.

    article: root_kind, readable_characters, block_count, chunk_count, is_partial. focus: type, section, scope, text, or null.
    retrieval: strategy, mode, is_truncated, evidence, budget, needs_planning. memory: counters of the history taken.
    """
    planner = F.when(retrieval["needs_planning"], F.struct(F.lit("pending").alias("outcome"), F.lit("the article is larger than the budget").alias("reason"))).otherwise(F.struct(F.lit("skipped").alias("outcome"), F.lit("article and history fit the budget").alias("reason")))
    seen = F.struct(F.coalesce(focus["type"], F.lit("none")).alias("type"), focus["section"].alias("section"), F.when(focus["type"] == "text", focus["scope"]).alias("scope"), focus["text"].alias("text"), F.coalesce(F.length(focus["text"]), F.lit(0)).alias("selected_characters"))
    found = F.struct(retrieval["strategy"].alias("strategy"), retrieval["mode"].alias("mode"), retrieval["is_truncated"].alias("is_truncated"), retrieval["evidence"].alias("initial_evidence"), retrieval["evidence"].alias("final_evidence"), retrieval["budget"].alias("budget"))
    request = F.lit(None).cast("struct<model: string, message_count: int, text_characters: int, image_count: int, messages: array<struct<role: string, content: string>>>")
    response = F.lit(None).cast("struct<outcome: string, characters: int, error: string, finished_at: bigint>")
    at = now.cast("long")
    return F.struct(F.lit(TRACE_VERSION).alias("version"), at.alias("created_at"), at.alias("updated_at"), F.lit("preparing").alias("status"), question.alias("question"), article.alias("article"), seen.alias("focus"), found.alias("retrieval"), planner.alias("planner"), memory.alias("memory"), request.alias("request"), response.alias("response"))


def _updated(trace: Column, now: Column, **fields: Column) -> Column:
    for name, value in fields.items():
        trace = trace.withField(name, value)
    return trace.withField("updated_at", now.cast("long"))


def with_evidence(trace: Column, retrieval: Column, now: Column) -> Column:
    """What was found after planning; what was found first stays."""
    found = trace["retrieval"]
    for ours, theirs in (("strategy", "strategy"), ("mode", "mode"), ("is_truncated", "is_truncated"), ("final_evidence", "evidence"), ("budget", "budget")):
        found = found.withField(ours, retrieval[theirs])
    return _updated(trace, now, retrieval=found)


def with_memory(trace: Column, memory: Column, now: Column) -> Column:
    return _updated(trace, now, memory=memory)


def with_planner(trace: Column, planner: Column, now: Column) -> Column:
    return _updated(trace, now, planner=planner)


def request_snapshot(model: Column, messages: Column) -> Column:
    """What was asked of a model: its messages (role, content parts) as text, and how many messages, characters and images."""
    texts = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), request_text(m["content"]).alias("t")))
    return F.struct(
        model.alias("model"), F.size(messages).alias("message_count"), F.aggregate(texts, F.lit(0), lambda n, m: n + F.length(m["t"]["text"])).alias("text_characters"),
        F.aggregate(texts, F.lit(0), lambda n, m: n + m["t"]["images"]).alias("image_count"), F.transform(texts, lambda m: F.struct(m["role"].alias("role"), m["t"]["text"].alias("content"))).alias("messages"),
    )


def with_request(trace: Column, model: Column, messages: Column, now: Column) -> Column:
    return _updated(trace, now, status=F.lit("requesting"), request=request_snapshot(model, messages))


def finished(trace: Column, outcome: str, now: Column, answer: Column | None = None, error: Column | None = None) -> Column:
    """outcome: completed (with the answer's length), failed or interrupted (with an error)."""
    said = F.length(answer) if answer is not None else F.lit(None).cast("int")
    wrong = error if error is not None else F.lit(INTERRUPTED if outcome == "interrupted" else None).cast("string")
    response = F.struct(F.lit(outcome).alias("outcome"), said.alias("characters"), wrong.alias("error"), now.cast("long").alias("finished_at"))
    return _updated(trace, now, status=F.lit(outcome), response=response)


def evidence_changed(trace: Column) -> Column:
    """Whether planning changed what is shown as evidence (by chunk id, in order)."""
    ids = lambda name: F.transform(trace["retrieval"][name], lambda e: e["chunk_id"])
    return ~ids("initial_evidence").eqNullSafe(ids("final_evidence"))
