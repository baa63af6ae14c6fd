from pyspark.sql import functions as F

from lectern.operators import memory, store
from lectern.settings import Settings
from lectern.streaming import operations

AT = 99


def said(k, role, content, at, error=None, reference=None, trace=None):
    return (k, role, content, at, error, reference, trace)


def context(spark, rows):
    return spark.createDataFrame([(t, u, n, title, "ready", False, None, m, None, at) for t, u, n, title, m, at in rows], store.CONTEXT)


TURN = [said("q1", "user", "why?", 1, trace="t"), said("a1", "assistant", "so", 2), said("q2", "user", "open", 3)]


def test_contexts(spark):
    rows = context(spark, [(1, "https://e.test/a", "https://e.test/a", "A", TURN, 5), (2, "https://e.test/a#x", "https://e.test/a", "A", [], 6), (1, "https://e.test/b", "https://e.test/b", "B", TURN, 7), (None, "u", "n", "bad", [], 1)])
    assert store.contexts_of(rows).count() == 3 and store.contexts_of(rows, 1).count() == 2 and store.contexts_of(rows, 1, "https://e.test/b").count() == 1
    assert store.contexts_of(rows, page="https://e.test/a/?utm_x=1").count() == 2
    new = context(spark, [(1, "https://e.test/b", "https://e.test/b", "new", [], 8)])
    saved = store.save_contexts(rows.filter("tab_id is not null"), new)
    assert {(r["tab_id"], r["title"]) for r in saved.collect()} == {(1, "A"), (2, "A"), (1, "new")}
    cleared = {(r["tab_id"], r["url"]): (len(r["messages"]), r["updated_at"]) for r in store.clear_messages(rows, F.lit(AT)).filter("tab_id is not null").collect()}
    assert cleared == {(1, "https://e.test/a"): (0, 99), (2, "https://e.test/a#x"): (0, 6), (1, "https://e.test/b"): (0, 99)}
    replaced = store.replace_messages(rows, "https://e.test/a", F.filter("messages", lambda m: m["role"] == "user"), F.lit(AT))
    assert [len(r["messages"]) for r in replaced.orderBy("updated_at").collect()] == [0, 3, 2, 0]
    assert store.delete_contexts(rows, 1).filter("tab_id is not null").count() == 1 and store.delete_contexts(rows, 1, "https://e.test/b").count() == 3


def test_archive(spark):
    empty = spark.createDataFrame([], store.CONVERSATION)
    pages = context(spark, [(1, "https://e.test/a", "https://e.test/a", "A", TURN, 5), (2, "https://e.test/b", "https://e.test/b", "B", TURN[2:], 5)])
    first = store.save_conversations(empty, pages, F.lit(50))
    (one,) = first.collect()
    assert (one["normalized_url"], one["created_at"], one["updated_at"], [m["id"] for m in one["messages"]], one["messages"][0]["trace"]) == ("https://e.test/a", 1, 50, ["q1", "a1"], None)
    more = [said("q1", "user", "why now?", 1), said("a9", "assistant", "anew", 2), said("q3", "user", "and?", 0, reference=("image", "x", "S", "alt", "data:")), said("a3", "assistant", "yes", 4)]
    again = store.save_conversations(first, context(spark, [(1, "https://e.test/a", "https://e.test/a", "A2", more, 6)]), F.lit(60))
    (two,) = again.collect()
    assert [m["id"] for m in two["messages"]] == ["q3", "a3", "q1", "a9"] and (two["title"], two["created_at"], two["updated_at"]) == ("A2", 1, 60)
    assert two["messages"][0]["reference"]["image_url"] is None and two["messages"][0]["reference"]["alt"] == "alt"
    assert store.save_conversations(again, pages.limit(0), F.lit(70)).first()["updated_at"] == 60
    old = spark.createDataFrame([("https://Old.test/p/?utm_s=1", 1, " ", [("q", "user", "x", 7, None, None, None), ("a", "assistant", "y", 8, None, None, None), (None, "user", "z", 9, None, None, None)], None, None), ("no address", 1, "t", TURN, 1, 1), ("https://e.test/none", 1, "t", TURN[2:], 1, 1)], store.CONVERSATION)
    (read,) = store.conversations(old).collect()
    assert (read["normalized_url"], read["title"], read["schema_version"], read["created_at"], read["updated_at"], len(read["messages"])) == ("https://old.test/p", "old.test", 2, 7, 8, 2)
    both = again.unionByName(store.conversations(old))
    assert [(r["normalized_url"], r["question_count"], r["last_question"]) for r in store.summaries(both).collect()] == [("https://e.test/a", 2, "why now?"), ("https://old.test/p", 1, "x")]
    assert store.summaries(both, " WHY ").count() == 1 and store.conversation_of(both, "https://old.test/p#x").count() == 1
    assert store.delete_conversations(both, ["https://e.test/a/"]).count() == 1 and store.delete_conversations(both).count() == 0
    assert store.hydrated(context(spark, [(3, "https://e.test/a", "https://e.test/a", "A", [], 1)]), both).first()["messages"][1]["id"] == "a3"
    assert both.agg(store.bytes_in_use(both).alias("n")).first()["n"] > 300


def test_operations_and_closing(spark):
    versions = operations.invalidated(spark.createDataFrame([("a", 2)], operations.VERSIONS), spark.createDataFrame([("a",), ("b",), ("b",)], "key string"))
    assert sorted(map(tuple, versions.collect())) == [("a", 3), ("b", 1)]
    begun = spark.createDataFrame([("a", 3, 0, 1), ("a", 2, 0, 2), ("c", 0, 0, 3), ("b", 1, 1, 4)], "key string, version long, all_version long, n int")
    assert sorted(r["n"] for r in operations.current(begun, versions).collect()) == [1, 3]
    asked = spark.createDataFrame([("a", 5, "y"), ("a", 4, "x"), ("b", 9, "z")], "key string, asked_at long, request_id string")
    assert sorted(r["request_id"] for r in operations.single_flight(asked).collect()) == ["x", "z"]
    empty = spark.createDataFrame([], store.CONVERSATION)
    rows = context(spark, [(1, "https://e.test/a", "https://e.test/a", "A", TURN, 5), (2, "https://e.test/b", "https://e.test/b", "B", TURN, 6)])
    left, kept = operations.close_tab(rows, empty, 1, True, F.lit(AT))
    assert [r["tab_id"] for r in left.collect()] == [2] and [r["normalized_url"] for r in kept.collect()] == ["https://e.test/a"]
    assert operations.close_tab(rows, empty, 1, False, F.lit(AT))[1].count() == 0
    assert operations.retain_all(rows, empty, F.lit(AT)).count() == 2 and operations.retain_all(rows, empty, F.lit(AT), F.col("tab_id") == 2).count() == 1


def test_settings():
    read = Settings.load({"windows": 3, "model": 7, "odd": 1, "retain_conversations": True})
    assert (read.windows, read.model, read.retain_conversations, read.candidates) == (3, "", True, 20) and Settings.load(read.save()) == read and Settings.load(None) == Settings()


def test_memory_reads_focus_and_references(spark):
    ref = lambda t: ("text", t, "S", None, None)
    rows = [(1, 0, "user", "first", 0, None, ref("kestrel")), (1, 1, "assistant", "x", 1, None, None), (1, 2, "user", "second", 2, None, None), (1, 3, "assistant", "y", 3, None, None)]
    turns = memory.completed_turns(spark.createDataFrame(rows, f"conv_id long, msg_idx long, role string, content string, created_at long, error boolean, reference {store.REFERENCE}"))
    asked = spark.createDataFrame([(1, "what about it", "kestrel")], "conv_id long, question string, focus_text string")
    assert [r["turn_idx"] for r in memory.recalled_turns(turns, asked, 1, 2).collect()] == [0]
    assert memory.recalled_turns(turns.drop("reference"), asked, 1, 2).count() == 0
