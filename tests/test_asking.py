import json

import pytest
from pyspark.sql import functions as F

from lectern.functions import reading as R
from lectern.functions.model_json import checkpoint, parse_checkpoint, parse_plan, query_plan
from lectern.operators import prompts, retrieve, store, turns


def one(spark, column, rows=None, schema=None):
    df = spark.range(1) if rows is None else spark.createDataFrame(rows, schema)
    return df.select(column.alias("x")).first()["x"]


def test_reading_rules(spark):
    arr = lambda *xs: F.array(*map(F.lit, xs))
    assert one(spark, R.outline(arr("A", "A > b", "A", "C"), F.lit("T"), 12)) == "- A\n- A > b"
    assert one(spark, R.outline(arr("toolong"), F.lit("T"), 3)) == "- T"
    blocks = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(s).alias("section")) for t, s in (("one", "P > Abstract"), ("two", "P"), ("three", "摘要"))))
    assert one(spark, R.abstract(blocks, 6)) == "one\nth"
    assert [one(spark, R.is_study_heading(F.lit("heading"), F.lit(k).cast("int"))) for k in (1, 2, None)] == [False, True, True]
    places = [(F.lit(9), "S", 3), (F.lit(-1), "S", 0), (F.lit(None).cast("int"), "B", 2), (F.lit(None).cast("int"), "none", 3)]
    assert all(one(spark, R.media_place(o, F.lit(s), arr("A", "B", "C"))) == want for o, s, want in places)
    assert [one(spark, R.unchanged_translation(F.lit(a), F.lit(b))) for a, b in (("some  word", "Some word"), ("Word", "word"), ("a", "a"), ("it's", "是"))] == [True, False, False, False]
    assert one(spark, R.selection(F.lit(" a \n b c "), 3)) == "a b"
    assert [one(spark, R.selection_scope(F.lit(t), F.lit(k).cast("int"))) for t, k in (("H3", None), ("h2", 5), ("p", 2), ("h2", 9))] == [("section", 3), ("section", 5), None, None]
    assert one(spark, R.default_diagnostics(blocks))["readable_length"] == 11


def test_image_crops(spark):
    rect = lambda *v: F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, ("left", "top", "width", "height"))))
    view = F.struct(F.lit(100.0).alias("width"), F.lit(50.0).alias("height"), F.lit(10.0).alias("offset_left"), F.lit(0.0).alias("offset_top"))
    crop = lambda r: one(spark, R.image_crop(r, view, F.lit(200), F.lit(100)))
    assert tuple(crop(rect(5, 10, 30, 10))) == (0, 20, 50, 20) and tuple(crop(rect(100, 40, 500, 500))) == (180, 80, 20, 20)
    assert crop(rect(300, 0, 5, 5)) is None


def test_answers_and_requests(spark):
    answer = lambda content: json.dumps({"choices": [{"message": {"content": content}}]})
    given = [answer(" yes "), answer([{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]), answer(""), answer(5), "no json", None]
    assert [r["x"] for r in spark.createDataFrame([(k, g) for k, g in enumerate(given)], "k int, g string").orderBy("k").select(R.assistant_text(F.col("g")).alias("x")).collect()] == ["yes", "a\nb", None, None, None, None]
    parts = F.array(*(F.struct(F.lit(t).alias("type"), F.lit(x).cast("string").alias("text"), F.lit(u).cast("string").alias("url")) for t, x, u in (("text", "see", None), ("image_url", None, "data:xyz"))))
    assert one(spark, R.request_text(parts)) == ("see\n[image left out, 8 characters]", 1) and one(spark, R.message_length(parts)) == 11


def test_checkpoints_cover_turns(spark):
    ids = F.array(*map(F.lit, ("a", "b", "c")))
    assert one(spark, R.checkpoint_covers(F.lit(2), F.lit("b"), ids)) == 2 and one(spark, R.checkpoint_covers(F.lit(2), F.lit("a"), ids)) == 0 and one(spark, R.checkpoint_covers(F.lit(9), F.lit("c"), ids)) == 0
    assert tuple(one(spark, R.to_compact(F.lit(2), F.lit("b"), ids))) == (True, ["c"], "c", 3, True)
    assert tuple(one(spark, R.to_compact(F.lit(None).cast("int"), F.lit("b"), ids))) == (False, ["a", "b", "c"], "c", 3, True)
    assert tuple(one(spark, R.to_compact(F.lit(3), F.lit("c"), ids))) == (True, [], "c", 3, False)
    assert one(spark, R.to_compact(F.lit(1), F.lit("a"), F.array().cast("array<string>"))) is None


PLANS = [
    '```json\n{"rewrittenQuestion": " a\\n b ", "queries": ["A", "a", "", 5, "b", "c", "d", "e"], "evidenceNeeds": [{"query": "n", "reason": ""}, {"reason": "x"}, 3, {"query": "m", "reason": "r"}], "coverage": "document-wide", "useConversation": true} end',
    '{"rewrittenQuestion": "q", "queries": "none", "coverage": "odd", "useConversation": "true"}', '{"rewrittenQuestion": 5}', '{"rewrittenQuestion": " "}', "[1]", "{}", "{broken", "", None,
    '{"rewrittenQuestion": "' + "long " * 200 + '", "queries": [], "useConversation": 1}',
]
CHECK = {"goal": " g\n", "activeTopic": "t", "items": [{"text": "x", "status": "active"}, {"text": " y ", "status": "completed"}], "decisions": ["d", " "], "userConstraints": [], "unresolvedReferences": ["u"]}
CHECKPOINTS = [CHECK, CHECK | {"goal": "g" * 601}, CHECK | {"goal": 5}, CHECK | {"items": [{"text": "x", "status": "odd"}]}, CHECK | {"items": [{"text": "x", "status": "active"}] * 31}, CHECK | {"decisions": ["d"] * 13}, CHECK | {"decisions": ["d" * 201]}, CHECK | {"decisions": [3]}, CHECK | {"items": [7]}, CHECK | {"items": [{"text": "w" * 200, "status": "pending"}] * 30}, {k: v for k, v in CHECK.items() if k != "activeTopic"}]


def test_model_json_is_the_plain_reading(spark):
    plain = lambda x: x.asDict(recursive=True) if x is not None else None
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(PLANS)], "k int, t string").orderBy("k").select("t", query_plan(F.col("t")).alias("p")).collect()
    assert [plain(r["p"]) for r in rows] == [parse_plan(r["t"]) for r in rows]
    texts = [json.dumps(c) for c in CHECKPOINTS] + ["x", None, "{}"]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(texts)], "k int, t string").orderBy("k").select("t", checkpoint(F.col("t")).alias("p")).collect()
    assert [plain(r["p"]) for r in rows] == [parse_checkpoint(r["t"]) for r in rows] and plain(rows[0]["p"]) is not None


def test_turn_states(spark):
    said = [("q1", "user", "why", 1, None, None, "t1"), ("a1", "assistant", "so", 2, None, None, None), ("q2", "user", "and", 3, None, None, "t2")]
    rows = spark.createDataFrame([(1, "u", "n", "T", "answering", True, ("text", "x", "S", None, None), said, None, 1), (2, "u", "n", "T", "ready", False, None, said[:2], None, 1), (3, "u", "n", "T", "answering", False, None, [], None, 1)], store.CONTEXT)
    got = {r["tab_id"]: r for r in turns.recover_turn(rows, F.lit(9), lambda t: F.concat(t, F.lit("!"))).collect()}
    assert (got[1]["status"], got[1]["messages"][2]["error"], got[1]["messages"][2]["trace"], got[1]["updated_at"]) == ("partial", True, "t2!", 9)
    assert (got[2]["status"], got[2]["updated_at"], got[3]["status"]) == ("ready", 1, "ready")
    answer = F.when(F.col("tab_id") == 1, F.struct(F.lit("a2").alias("id"), F.lit("assistant").alias("role"), F.lit("so too").alias("content"), F.lit(4).cast("long").alias("created_at"), F.lit(None).cast("boolean").alias("error"), F.lit(None).cast(store.REFERENCE).alias("reference"), F.lit(None).cast("string").alias("trace")))
    done = {r["tab_id"]: r for r in turns.complete_turn(rows, answer, F.lit(9)).collect()}
    assert [m["id"] for m in done[1]["messages"]] == ["q1", "a1", "q2", "a2"] and done[1]["focus"] is None and done[2]["updated_at"] == 1
    failed = turns.fail_turn(rows, F.lit("q1"), F.lit(9)).filter("tab_id = 2").first()
    assert failed["messages"][0]["error"] is True and failed["messages"][1]["error"] is None
    assert [m["trace"] for m in rows.filter("tab_id = 1").select(turns.retained_traces(F.col("messages"), 1).alias("m")).first()["m"]] == [None, None, "t2"]
    assert [m["trace"] for m in rows.filter("tab_id = 1").select(turns.retained_traces(F.col("messages"), 0).alias("m")).first()["m"]] == [None, None, None]


def test_traces(spark):
    s = lambda **kw: F.struct(*(v.alias(k) for k, v in kw.items()))
    evidence = lambda *ids: F.array(*(s(chunk_id=F.lit(i), score=F.lit(1.0)) for i in ids))
    found = lambda *ids: s(strategy=F.lit("fused-retrieval"), mode=F.lit("relevant"), is_truncated=F.lit(True), evidence=evidence(*ids), budget=F.lit(5), needs_planning=F.lit(True))
    focus = s(type=F.lit("text"), section=F.lit("S"), scope=F.lit(None).cast("string"), text=F.lit("abc"))
    first = turns.new_trace(F.lit("why"), s(block_count=F.lit(2)), focus, found("a", "b"), s(recent=F.lit(1)), F.lit(1))
    messages = F.array(prompts.message("system", prompts.part(F.lit("be brief"))), prompts.message("user", prompts.part(F.lit("why"))))
    made = turns.finished(turns.with_request(turns.with_evidence(first, found("a", "c"), F.lit(2)), F.lit("m"), messages, F.lit(3)), "completed", F.lit(4), F.lit("because"))
    row = one(spark, made)
    assert (row["status"], row["created_at"], row["updated_at"], row["planner"]["outcome"], row["focus"]["selected_characters"]) == ("completed", 1, 4, "pending", 3)
    assert (row["request"]["message_count"], row["request"]["text_characters"], row["response"]["characters"]) == (2, 11, 7)
    assert one(spark, turns.evidence_changed(made)) is True and one(spark, turns.evidence_changed(first)) is False
    assert one(spark, turns.finished(first, "interrupted", F.lit(5)))["response"]["error"] == turns.INTERRUPTED


def test_requests(spark):
    chunks = F.array(F.struct(F.lit("S").alias("section"), F.lit("words").alias("text")))
    none = F.slice(chunks, 1, 0)
    focus = F.lit(None).cast("struct<type: string, text: string, section: string, scope: string, alt: string, image_url: string>")
    picture = F.struct(F.lit("image").alias("type"), F.lit("t").alias("text"), F.lit("S").alias("section"), F.lit(None).cast("string").alias("scope"), F.lit("a cat").alias("alt"), F.lit("data:1").alias("image_url"))
    history = F.array(prompts.message("user", prompts.part(F.lit("before"))))
    ask = lambda c, f, mode, partial, cut, state=None: one(spark, prompts.answer_request(F.lit("T"), F.lit("u"), F.lit("why?"), c, history, f, F.lit(state).cast("string"), F.lit(mode), F.lit(partial), F.lit(cut)))
    whole = ask(chunks, focus, "whole", False, False)
    assert [m["role"] for m in whole] == ["system", "user", "user"] and prompts.WORDING["whole"] in whole[0]["content"][0]["text"] and "[S]\nwords" in whole[2]["content"][0]["text"]
    cut = ask(none, picture, "relevant", True, True, '{"goal":1}')
    system, user = cut[0]["content"][0]["text"], cut[2]["content"]
    assert all(prompts.WORDING[w] in system for w in ("partial", "cut", "no evidence")) and prompts.WORDING["read"] not in system
    assert len(user) == 2 and user[1]["url"] == "data:1" and '{"goal":1}' in user[0]["text"] and "a cat" in user[0]["text"] and prompts.WORDING["nothing"] in user[0]["text"]
    turns_ = F.array(*(F.struct(F.lit(k).alias("turn_idx"), F.lit(f"q{k}").alias("question"), F.lit("a" * 9).alias("answer")) for k in range(3)))
    assert one(spark, prompts.recent_history(turns_, 3, 4)) == "Assistant: aaaa\nUser: q2\nAssistant: aaaa"
    plan = one(spark, prompts.plan_request(F.lit("T"), F.lit("- S"), F.lit(""), focus, F.lit(None).cast("string"), F.lit(""), F.lit("why?")))
    assert plan[1]["content"][0]["text"] == "Title: T\n\nSections:\n- S\n\nQuestion: why?"
    assert '<turn index="2">' in one(spark, prompts.checkpoint_request(F.lit(None).cast("string"), turns_))[1]["content"][0]["text"]
    assert prompts.WORDING["retry"] in one(spark, prompts.translation_request(F.lit("T"), F.lit("S"), chunks, F.lit("x"), F.lit(True)))[0]["content"][0]["text"]


@pytest.fixture(scope="module")
def article(spark):
    rows = [(1, k, f"chunk-{k + 1}", s, t, [f"b{k}"]) for k, (s, t) in enumerate([("Intro", "the first words"), ("Method > Data", "birds were counted at dawn"), ("Method > Data", "and again at dusk"), ("Method > Tests", "counts were compared"), ("End", "thanks to all birds")])]
    return spark.createDataFrame(rows, "article_id long, chunk_idx int, chunk_id string, section string, text string, block_ids array<string>")


def test_context_takes_each_branch(spark, article):
    asked = [(1, 1, "summarize the whole article", None, None, None, None, None), (1, 2, "what of it", None, "x", "method", "section", 2), (1, 3, "what is this", None, "counted at dawn", "", None, None), (1, 4, "thanks birds", ["compared counts"], None, None, None, None), (1, 5, "tell", None, "zzz qqq", "nowhere", "section", 3)]
    got = {}
    for r in retrieve.article_context(article, spark.createDataFrame(asked, retrieve.QUESTION)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["mode"], r["branch"], r["chunk_id"]))
    assert [x[2] for x in got[1]] == [f"chunk-{k}" for k in range(1, 6)] and {x[:2] for x in got[1]} == {("whole", "whole")}
    assert got[2] == [("relevant", "section", f"chunk-{k}") for k in (2, 3, 4)]
    assert got[3][0] == ("relevant", "anchor", "chunk-2") and got[3][1][2] == "chunk-3"
    assert {x[1] for x in got[4]} == {"search"} and got[4][0][2] in ("window-chunk-4-chunk-4", "window-chunk-5-chunk-5") and 5 not in got
    few = retrieve.article_context(article, spark.createDataFrame(asked[:1], retrieve.QUESTION), whole_budget=60)
    assert few.count() == 2 and few.first()["truncated"] is True


def test_budgets(spark, article):
    asked = spark.createDataFrame([(1, 1, 50, False, False, None), (1, 2, 50, False, False, "x" * 100), (1, 3, 50, True, True, "x" * 100)], "article_id long, query_id long, history_length int, use_conversation boolean, planned boolean, checkpoint_json string")
    total = sum(len(r["section"]) + len(r["text"]) + 3 for r in article.collect())
    got = {r["query_id"]: r for r in retrieve.budgets(article, asked, total + 30).collect()}
    assert (got[1]["strategy"], got[1]["history_limit"], got[1]["history_characters"], got[1]["needs_planning"]) == ("full-context", 30, 30, False)
    assert (got[2]["strategy"], got[2]["available"], got[2]["history_characters"], got[2]["article_budget"], got[2]["needs_planning"]) == ("fused-retrieval", total - 70, 50, total - 120, True)
    assert got[3]["needs_planning"] is False and got[3]["is_truncated"] is True
    plan = F.struct(F.lit("re").alias("rewritten_question"), F.array(F.lit("x"), F.lit("")).alias("queries"))
    assert one(spark, retrieve.global_queries(F.lit("q"), F.lit(None).cast("string"), plan)) == ["q", "re", "x"]
