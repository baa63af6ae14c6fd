"""Windows, fusion and packing as folds against plain functions, and a question's whole context."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import context, memory, packing
from lectern.operators import evidence as E
from lectern.settings import Settings
from tests import plain_evidence

KEY = ["article_id", "query_id"]


def articles(seed, n=12):
    rng = random.Random(seed)
    rows = []
    for a in range(n):
        for k in range(rng.randint(1, 14)):
            rows.append((a, k, f"chunk-{k + 1}", f"S{k // rng.randint(2, 4)}", "x" * rng.randint(1, 60), [f"b{k}"] if rng.random() < 0.8 else [f"b{k}", f"b{k + 1}"]))
    return rows


CHUNK = "article_id long, chunk_idx int, chunk_id string, section string, text string, block_ids array<string>"


def plain_chunks(rows, a):
    return [dict(zip(("article_id", "chunk_idx", "chunk_id", "section", "text", "block_ids"), r, strict=True)) for r in rows if r[0] == a]


@pytest.mark.parametrize("seed", [1, 2])
def test_folds_are_the_plain_choices(spark, seed):
    rng = random.Random(seed)
    rows = articles(seed)
    asks = []
    for a in {r[0] for r in rows}:
        n = len(plain_chunks(rows, a))
        for source, need in [("exact-match", None), ("global-search", None), ("planned-need", 0), ("planned-need", 2)]:
            order = rng.sample(range(n), rng.randint(1, n))
            asks += [(a, 0, source, need, p, k, rng.choice([0, 1]) * 0 + 150 + 40 * a, 3 if source == "planned-need" else 8) for p, k in enumerate(order, 1)]
    ranked = spark.createDataFrame(asks, "article_id long, query_id long, source string, need int, place int, chunk_idx int, budget long, most int")
    held = spark.createDataFrame(rows, CHUNK)
    made = packing.windows(packing.facts(held), ranked, context.OFFER)
    want, folds = {}, {}
    for a, _, source, need, *_ in asks:
        if (a, source, need) in want:
            continue
        own = [x for x in asks if (x[0], x[2], x[3]) == (a, source, need)]
        want[a, source, need] = plain_evidence.pack_windows(plain_chunks(rows, a), [x[5] for x in own], own[0][6], own[0][7])
        folds.setdefault(a, {})[source, need] = want[a, source, need]
    got = {}
    for r in made.orderBy("article_id", "source", "need", "rank").collect():
        got.setdefault((r["article_id"], r["source"], r["need"]), []).append(r)
    assert got.keys() == {k for k, v in want.items() if v}
    for k, windows in want.items():
        assert [(w["chunk"]["chunk_id"], w["chunk"]["cost"], w["chunk"]["length"], w["chunk"]["block_ids"]) for w in got.get(k, [])] == [(w["chunk_id"], E.cost(w), len(w["text"]), w["block_ids"]) for w in windows]
    single = packing.facts(held).filter("chunk_idx % 3 = 1").select("article_id", F.lit(0).cast("long").alias("query_id"), F.when(F.col("article_id") % 2 == 0, "focus-anchor").otherwise("document-coverage").alias("source"), F.lit(None).cast("int").alias("need"), F.floor(F.col("chunk_idx") / 3).cast("int").alias("rank"), "chunk")
    offers = made.select(*context.OFFER, "rank", "chunk").unionByName(single).withColumn("reason", F.concat("source", F.lit("?")))
    fused = packing.fused(offers, KEY)
    packed = {r["article_id"]: r["evidence"] for r in packing.packed(fused.withColumn("needs", F.lit(3)).withColumn("budget", 200 + 30 * F.col("article_id")), KEY, 4).collect()}
    candidates = {r["article_id"]: r["candidates"] for r in fused.collect()}
    for a in candidates:
        plain, own = plain_evidence.Fusion(), plain_chunks(rows, a)
        lists = dict(folds.get(a, {}))
        lists["focus-anchor" if a % 2 == 0 else "document-coverage", None] = [c for c in own if c["chunk_idx"] % 3 == 1]
        for source, need in sorted(lists, key=lambda x: (list(E.WEIGHTS).index(x[0]), -1 if x[1] is None else x[1])):
            plain.channel(lists[source, need], source, source == "focus-anchor", need)
        told = lambda e: (e.chunk["chunk_id"], list(e.sources), round(e.score, 12), e.pinned, sorted(e.needs))
        assert [(c["chunk"]["chunk_id"], c["sources"], round(c["score"], 12), c["pinned"], sorted(c["needs"])) for c in candidates[a]] == [told(e) for e in plain.by_key.values()]
        assert all(c["reasons"] == [f"{s}?" for s in c["sources"]] for c in candidates[a])
        assert [e["chunk"]["chunk_id"] for e in packed[a]] == [e.chunk["chunk_id"] for e in plain_evidence.pack(plain.ranked(), 3, 200 + 30 * a, 4)]


LINES = ["The harbour was built of basalt", "Ships came from the north", "A lighthouse stands on the mole", "Its lamp burned whale oil", "Storms broke the wall twice", "Engineers rebuilt the basalt wall", "The census counted sailors", "Trade fell after the war", "A museum keeps the lamp", "Visitors come in summer"]


def test_question_context(spark):
    rows = [(a, k, f"chunk-{k + 1}", f"Town > {'Port' if k < 5 else 'Later'} > p{k // 2}", text * (1 if a == 0 else 3), [f"b{k}"]) for a in (0, 1) for k, text in enumerate(LINES)]
    chunks = spark.createDataFrame(rows, CHUNK)
    plan = json.dumps({"rewrittenQuestion": "who rebuilt the wall", "queries": ["basalt wall"], "evidenceNeeds": [{"query": "census sailors", "reason": "numbers"}, {"query": "museum lamp", "reason": "today"}], "coverage": "document-wide", "useConversation": True})
    schema = "article_id long, query_id long, conv_id long, question string, focus_type string, focus_text string, focus_section string, focus_scope string, heading_level int, plan_json string, checkpoint_json string, planned boolean"
    asked = [
        (0, 1, 1, "who built it?", None, None, None, None, None, None, None, None),
        (1, 2, 1, "what about the lighthouse lamp?", "text", "lighthouse stands on the mole", "Town > Port > p1", None, None, None, "{}" * 50, None),
        (1, 3, 2, "who rebuilt the basalt wall?", None, None, None, None, None, plan, None, True),
        (1, 4, 9, "and then?", "text", "", "Town > Later", "section", 2, None, None, False),
        (7, 5, None, "an article that isn't there", None, None, None, None, None, "no plan", None, None),
    ]
    said = [(1, m, "user" if m % 2 == 0 else "assistant", f"{'lamp' if m < 2 else 'talk'} {m} " * 3, m, False) for m in range(20)] + [(2, 0, "user", "basalt", 0, False), (2, 1, "assistant", "yes", 1, False)]
    turns = memory.completed_turns(spark.createDataFrame(said, "conv_id long, msg_idx long, role string, content string, created_at long, error boolean"))
    got = {r["query_id"]: r for r in context.question_context(chunks, spark.createDataFrame(asked, schema), turns, Settings(request_budget=760)).collect()}
    assert len(got) == 5 and (got[1]["strategy"], got[1]["mode"], len(got[1]["evidence"]), got[1]["needs_planning"]) == ("full-context", "whole", 10, False)
    assert got[5]["strategy"] == "full-context" and got[5]["evidence"] is None and got[5]["article_characters"] == 0
    two = got[2]
    assert two["evidence"][0]["pinned"] and "focus-anchor" in two["evidence"][0]["sources"] and two["checkpoint_characters"] == 100 and two["needs_planning"]
    for q in (2, 3, 4):
        r = got[q]
        assert r["is_truncated"] and r["history_characters"] + r["article_characters"] + r["checkpoint_characters"] <= 760 and r["article_characters"] == sum(e["cost"] for e in r["evidence"]) > 0
    seen = {s for e in got[3]["evidence"] for s in e["sources"]}
    assert {"exact-match", "global-search", "planned-need"} <= seen and not got[3]["needs_planning"] and [t["how"] for t in got[3]["history"]] == ["all"]
    assert {"numbers", "today"} & {x for e in got[3]["evidence"] for x in e["reasons"]}
    assert all(e["pinned"] for e in got[4]["evidence"][:1]) and got[4]["history"] is None
    assert {t["how"] for t in got[1]["history"]} <= {"recent", "recalled", "all"}


def test_limits_come_from_the_settings(spark):
    rows = [(0, k, f"chunk-{k + 1}", "S", text * 4, [f"b{k}"]) for k, text in enumerate(LINES)]
    asked = spark.createDataFrame([(0, 1, 1, "who rebuilt the basalt wall?")], "article_id long, query_id long, conv_id long, question string").selectExpr("*", *(f"cast(null as {t}) AS {c}" for c, t in (("focus_type", "string"), ("focus_text", "string"), ("focus_section", "string"), ("focus_scope", "string"), ("heading_level", "int"), ("plan_json", "string"), ("checkpoint_json", "string"), ("planned", "boolean"))))
    turns = memory.completed_turns(spark.createDataFrame([(1, 0, "user", "q", 0, False), (1, 1, "assistant", "a", 1, False)], "conv_id long, msg_idx long, role string, content string, created_at long, error boolean"))
    told = lambda given: context.question_context(spark.createDataFrame(rows, CHUNK), asked, turns, Settings.load(given)).first()
    assert told({"request_budget": 900, "windows": 1})["limit"] == 900 and len(told({"request_budget": 900, "windows": 1})["evidence"]) == 1
    assert len(told({"request_budget": 900})["evidence"]) > 1 and told({})["strategy"] == "full-context"


def test_history_is_the_memory_selection(spark):
    """Under one budget for all, the history of a question is what select_memory() takes."""
    rng = random.Random(5)
    said = [(c, m, "user" if m % 2 == 0 else "assistant", " ".join(rng.choice(["oak", "elm", "ash", "fir", "yew"]) for _ in range(rng.randint(1, 20))), m, False) for c in range(6) for m in range(2 * rng.randint(1, 12))]
    turns = memory.completed_turns(spark.createDataFrame(said, "conv_id long, msg_idx long, role string, content string, created_at long, error boolean"))
    asked = spark.createDataFrame([(c, "oak yew", None) for c in range(6)], "conv_id long, question string, focus_text string")
    for budget, recent_budget in ((300, 150), (60, 60), (5000, 10), (0, 0)):
        want = {(r["conv_id"], r["turn_idx"], r["how"]) for r in memory.select_memory(turns, asked, budget, recent_budget, 3, 2).collect() if r["how"] != "omitted"}
        own = asked.withColumn("budget", F.lit(budget)).withColumn("recent_budget", F.lit(recent_budget)).withColumn("q", F.col("conv_id"))
        assert {(r["q"], r["turn_idx"], r["how"]) for r in memory.history_for(turns, own, ["q"], 3, 2).collect()} == want
