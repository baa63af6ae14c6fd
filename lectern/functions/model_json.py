"""What a language model writes as JSON, read into checked records: query plans and conversation checkpoints."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.urls import let

# Limits of plans and checkpoints.
PLAN_QUERIES = PLAN_NEEDS = 4
QUERY_CHARACTERS, REASON_CHARACTERS = 500, 300
GOAL_CHARACTERS, TOPIC_CHARACTERS, ITEM_CHARACTERS = 600, 400, 200
ITEMS, LIST_ENTRIES, CHECKPOINT_CHARACTERS = 30, 12, 4000
STATUSES = ("pending", "active", "completed")
COVERAGES = ("focused", "multi-section", "document-wide")

PLAN_TYPE = "struct<rewritten_question: string, queries: array<string>, evidence_needs: array<struct<query: string, reason: string>>, coverage: string, use_conversation: boolean>"
CHECKPOINT_TYPE = "struct<goal: string, active_topic: string, items: array<struct<text: string, status: string>>, decisions: array<string>, user_constraints: array<string>, unresolved_references: array<string>>"


def _object(text: str | None) -> dict | None:
    """The JSON object between the first { and the last }."""
    if not text or (start := text.find("{")) < 0 or (end := text.rfind("}")) <= start:
        return None
    try:
        found = json.loads(text[start : end + 1])
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _flat(value: object) -> str | None:
    return re.sub(r"\s+", " ", value).strip() if isinstance(value, str) else None


def _cut(value: object, most: int) -> str:
    return (_flat(value) or "")[:most]


def parse_plan(text: str | None, reason: str = "evidence for the answer") -> dict | None:
    found = _object(text)
    if found is None or not (rewritten := _cut(found.get("rewrittenQuestion"), QUERY_CHARACTERS)):
        return None
    given = found.get("queries") if isinstance(found.get("queries"), list) else []
    wanted = [q for q in (_cut(x, QUERY_CHARACTERS) for x in given) if q] or [rewritten]
    queries = list({q.lower(): q for q in reversed(wanted)}.values())[::-1]
    queries = sorted(queries, key=wanted.index)[:PLAN_QUERIES]
    needs = [
        {"query": q, "reason": _cut(n.get("reason"), REASON_CHARACTERS) or reason}
        for n in (found.get("evidenceNeeds") if isinstance(found.get("evidenceNeeds"), list) else [])
        if isinstance(n, dict) and (q := _cut(n.get("query"), QUERY_CHARACTERS))
    ][:PLAN_NEEDS]
    return {
        "rewritten_question": rewritten,
        "queries": queries,
        "evidence_needs": needs or [{"query": q, "reason": reason} for q in queries],
        "coverage": found["coverage"] if found.get("coverage") in COVERAGES[1:] else COVERAGES[0],
        "use_conversation": found.get("useConversation") is True,
    }


def _checked(value: object, most: int) -> str | None:
    text = _flat(value)
    return text if text is not None and len(text) <= most else None


def _checked_list(value: object) -> list[str] | None:
    if not isinstance(value, list) or len(value) > LIST_ENTRIES:
        return None
    out = [_checked(x, ITEM_CHARACTERS) for x in value]
    return None if None in out else [x for x in out if x]


def parse_checkpoint(text: str | None) -> dict | None:
    """The record, or None if anything is of the wrong kind, too long or too much; nothing is cut."""
    found = _object(text)
    if found is None:
        return None
    goal, topic, items = _checked(found.get("goal"), GOAL_CHARACTERS), _checked(found.get("activeTopic"), TOPIC_CHARACTERS), found.get("items")
    if goal is None or topic is None or not isinstance(items, list) or len(items) > ITEMS:
        return None
    kept = [{"text": _checked(i.get("text"), ITEM_CHARACTERS), "status": i.get("status")} if isinstance(i, dict) else {} for i in items]
    if any(not i.get("text") or i["status"] not in STATUSES for i in kept):
        return None
    lists = [_checked_list(found.get(n)) for n in ("decisions", "userConstraints", "unresolvedReferences")]
    if None in lists:
        return None
    out = {"goal": goal, "active_topic": topic, "items": kept, "decisions": lists[0], "user_constraints": lists[1], "unresolved_references": lists[2]}
    return out if len(json.dumps(out, ensure_ascii=False, separators=(",", ":"))) <= CHECKPOINT_CHARACTERS else None


def _variant(text: Column) -> Column:
    """The JSON object between the first { and the last }, as a variant; null if there is none."""
    return let(F.try_parse_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1)), lambda v: F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v))


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit(kind)), F.lit(False))


def _text(value: Column) -> Column:
    """A variant's string with white space collapsed; null if it is none."""
    flat = F.regexp_replace(F.regexp_replace(F.try_variant_get(value, "$", "string"), r"(?U)\s+", " "), "^ | $", "")
    return F.when(_is(value, "STRING"), flat)


def _field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _items(value: Column) -> Column:
    """A variant's elements; null if it is no array."""
    return F.when(_is(value, "ARRAY"), F.try_variant_get(value, "$", "array<variant>"))


def query_plan(text: Column, reason: str = "evidence for the answer") -> Column:
    """PLAN_TYPE, null for what is no plan; parse_plan() as an expression."""
    cut = lambda v, n: F.left(F.coalesce(_text(v), F.lit("")), F.lit(n))
    some = lambda xs: F.filter(xs, lambda x: x != "")
    none = F.array().cast("array<string>")

    def plan(v: Column, rewritten: Column) -> Column:
        given = let(F.coalesce(some(F.transform(_items(_field(v, "queries")), lambda q: cut(q, QUERY_CHARACTERS))), none), lambda q: F.when(F.size(q) > 0, q).otherwise(F.array(rewritten)))
        queries = let(given, lambda q: F.slice(F.filter(q, lambda x, k: F.array_position(F.transform(q, lambda y: F.lower(y)), F.lower(x)) == k + 1), 1, PLAN_QUERIES))
        need = lambda n: F.struct(cut(_field(n, "query"), QUERY_CHARACTERS).alias("query"), cut(_field(n, "reason"), REASON_CHARACTERS).alias("reason"))
        told = F.filter(F.transform(F.filter(_items(_field(v, "evidenceNeeds")), lambda n: _is(n, "OBJECT")), need), lambda n: n["query"] != "")
        named = F.transform(F.slice(F.coalesce(told, F.array().cast("array<struct<query: string, reason: string>>")), 1, PLAN_NEEDS), lambda n: F.struct(n["query"].alias("query"), F.when(n["reason"] != "", n["reason"]).otherwise(F.lit(reason)).alias("reason")))
        coverage = F.when(_is(_field(v, "coverage"), "STRING") & F.try_variant_get(v, "$.coverage", "string").isin(*COVERAGES), F.try_variant_get(v, "$.coverage", "string")).otherwise(COVERAGES[0])
        use = F.coalesce(_is(_field(v, "useConversation"), "BOOLEAN") & F.try_variant_get(v, "$.useConversation", "boolean"), F.lit(False))
        whole = lambda q, n: F.struct(rewritten.alias("rewritten_question"), q.alias("queries"), F.when(F.size(n) > 0, n).otherwise(F.transform(q, lambda x: F.struct(x.alias("query"), F.lit(reason).alias("reason")))).alias("evidence_needs"), coverage.alias("coverage"), use.alias("use_conversation"))
        return let(queries, lambda q: let(named, lambda n: whole(q, n)))

    return let(_variant(text), lambda v: let(cut(_field(v, "rewrittenQuestion"), QUERY_CHARACTERS), lambda r: F.when(r != "", plan(v, r))))


def checkpoint(text: Column) -> Column:
    """CHECKPOINT_TYPE, null for what isn't valid; parse_checkpoint() as an expression."""
    checked = lambda v, n: let(_text(v), lambda t: F.when(F.length(t) <= n, t))
    whole = lambda xs: F.when(~F.exists(xs, lambda x: x.isNull()), xs)
    few = lambda xs, n: F.when(F.size(xs) <= n, xs)

    def item(v: Column) -> Column:
        status = F.when(_is(_field(v, "status"), "STRING"), F.try_variant_get(v, "$.status", "string"))
        return let(checked(_field(v, "text"), ITEM_CHARACTERS), lambda t: F.when(_is(v, "OBJECT") & (t != "") & status.isin(*STATUSES), F.struct(t.alias("text"), status.alias("status"))))

    def listed(v: Column) -> Column:
        return F.filter(let(F.transform(few(_items(v), LIST_ENTRIES), lambda x: checked(x, ITEM_CHARACTERS)), whole), lambda x: x != "")

    def made(v: Column) -> Column:
        parts = {"goal": checked(_field(v, "goal"), GOAL_CHARACTERS), "active_topic": checked(_field(v, "activeTopic"), TOPIC_CHARACTERS), "items": let(F.transform(few(_items(_field(v, "items")), ITEMS), item), whole)}
        parts |= {n: listed(_field(v, j)) for n, j in (("decisions", "decisions"), ("user_constraints", "userConstraints"), ("unresolved_references", "unresolvedReferences"))}
        return let(F.struct(*(c.alias(n) for n, c in parts.items())), lambda s: F.when(F.forall(F.array(*(s[n].isNotNull() for n in parts)), lambda ok: ok) & (F.length(F.to_json(s)) <= CHECKPOINT_CHARACTERS), s))

    return let(_variant(text), lambda v: F.when(v.isNotNull(), made(v)))
