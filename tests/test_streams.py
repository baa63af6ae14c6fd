"""Keyed state of conversations and pages over several batches, and the log of operations against the operations one after another."""

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from lectern.operators import store
from lectern.streaming import keyed, log

A, B = "https://e.test/a", "https://e.test/b"


def message(conv, idx, role, content, at, url, generation):
    return (conv, idx, role, content, at, False, url, generation)


def run(spark, tmp_path, batches, forget=()):
    """The archive after the batches, one query run each; before those of forget the query's checkpoint is lost."""
    for k, rows in enumerate(batches):
        if k in forget:
            shutil.rmtree(f"{tmp_path}/check")
        spark.createDataFrame(rows, keyed.MESSAGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        keyed.archive_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    return sorted((r["url"], r["ord"], r["question_id"], r["question"], r["answer"]) for r in keyed.archived_turns(spark, f"{tmp_path}/out").collect())


def test_a_conversation_that_moves(spark, tmp_path):
    """Its older generation was on another page; no question meets an answer of another generation."""
    got = run(spark, tmp_path, [
        [message(1, 0, "user", "old question", 1, A, 1), message(1, 1, "assistant", "old answer", 2, A, 1)],
        [message(1, 0, "user", "new question", 3, B, 2)],
        [message(1, 1, "assistant", "new answer", 4, B, 2), message(1, 2, "user", "late", 9, A, 1)],
    ])
    assert got == [(B, 0, "1-0", "new question", "new answer")]


def test_a_lost_checkpoint(spark, tmp_path):
    """A query that begins anew adds to the archive, and what was there stays."""
    batches = [[message(c, 0, "user", f"q{c}", 1, A, 1), message(c, 1, "assistant", f"a{c}", 2, A, 1)] for c in range(3)]
    batches.append([message(0, 1, "assistant", "a0 anew", 3, A, 1), message(7, 0, "user", "q7", 5, A, 1), message(7, 1, "assistant", "a7", 6, A, 1)])
    got = run(spark, tmp_path, batches, forget=(3,))
    assert [x[3:] for x in got] == [("q0", "a0 anew"), ("q1", "a1"), ("q2", "a2"), ("q7", "a7")]


def test_answers_meet_questions_and_deletions_count(spark, tmp_path):
    got = run(spark, tmp_path, [
        [message(7, 0, "user", "q0", 1, A, 1), message(8, 0, "user", "p0", 1, B, 1), message(9, 0, "user", "r0", 1, B, 1), message(9, 1, "assistant", "s0", 2, B, 1)],
        [message(7, 1, "assistant", "a0", 2, A, 1), message(7, 2, "user", "q2", 3, A, 1), message(9, 0, keyed.DELETED, "", 5, B, 1)],
        [message(7, 3, "assistant", "a2", 4, A, 1), message(8, 0, "user", "p0 new", 5, B, 2), message(8, 1, "assistant", "b0", 6, B, 2), message(9, 3, "assistant", "after", 7, B, 1)],
        [message(8, 1, "assistant", "stale", 9, B, 1)],
    ])
    assert got == [(A, 0, "7-0", "q0", "a0"), (A, 1, "7-2", "q2", "a2"), (B, 0, "8-0", "p0 new", "b0")]
    # A batch that runs again writes the same place
    (folder,) = {p.parent for p in (tmp_path / "out").glob("query=*/batch=0")}
    changes = spark.read.parquet(f"file://{folder}/batch=2")
    changes = spark.createDataFrame(changes.collect(), keyed.CHANGE)
    changes.write.mode("overwrite").parquet(f"file://{folder}/batch=2")
    assert keyed.archived_turns(spark, f"{tmp_path}/out").count() == 3


def test_a_message_between_two_others_breaks_their_turn(spark, tmp_path):
    """Also a message that changes, and one that comes again with an older time."""
    got = run(spark, tmp_path, [
        [message(1, 0, "user", "q0", 1, A, 1), message(1, 4, "assistant", "a4", 2, A, 1), message(1, 6, "user", "q6", 3, A, 1), message(1, 7, "assistant", "a7", 4, A, 1)],
        [message(1, 2, "user", "q2", 5, A, 1), message(1, 7, "assistant", "a7 anew", 6, A, 1), message(1, 6, "user", "older", 2, A, 1)],
    ])
    assert got == [(A, 0, "1-6", "q6", "a7 anew"), (A, 1, "1-2", "q2", "a4")]


def test_one_answer_at_a_time(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, 12, 0, 0) + dt.timedelta(seconds=s)
    batches = [
        [("p", "request", "r1", at(0)), ("p", "request", "r2", at(5)), ("q", "request", "s1", at(1))],
        [("p", "answer", "r1", at(20)), ("p", "request", "r3", at(21)), ("p", "request", "r1", at(2)), ("q", "request", "s2", at(30))],
        [("q", "request", "s3", at(50)), ("p", "answer", "r9", at(30)), ("p", "request", "r4", at(40))],
        [("x", "request", "x1", at(4000))],
        [("p", "request", "r5", at(4001)), ("q", "answer", "s1", at(4002)), ("q", "request", "s4", at(4003))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, keyed.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        made = keyed.decisions(spark.readStream.schema(keyed.EVENT).parquet(f"{tmp_path}/in"))
        with keyed.keyed_state(spark):
            query = made.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
    got = {r["request_id"]: (r["accepted"], r["open_request"]) for r in spark.read.parquet(f"{tmp_path}/out").orderBy(F.col("accepted")).collect()}
    assert {k for k, v in got.items() if v[0]} == {"r1", "r3", "s1", "s3", "x1", "r5", "s4"}
    assert got["r2"] == (False, "r1") and got["s2"] == (False, "s1") and got["r4"] == (False, "r3")


def contexts(spark, rows):
    return spark.createDataFrame([(t, u, u, title, "ready", False, None, [("m", "user", "hi", 1, None, None, None)] * n, check, at) for t, u, title, n, check, at in rows], store.CONTEXT)


def plain(df):
    return sorted((r["tab_id"], r["url"], r["title"], r["status"], len(r["messages"]), r["checkpoint"], r["updated_at"]) for r in df.collect())


def test_the_log_gives_what_the_operations_give(spark):
    start = contexts(spark, [(1, A, "one", 2, "c", 5), (2, A, "two", 0, None, 6), (3, B, "three", 1, "k", 7)])
    new = contexts(spark, [(1, B, "new", 3, "x", 8), (3, B, "again", 2, "y", 9)])
    at = F.lit
    # One after another
    now = store.save_contexts(start, new)
    steps = [log.saves(new, at(1))]
    steps.append(log.updates(now.filter(F.col("tab_id") == 1), at(2), at(20), status=F.lit("partial")))
    now = store.update_contexts(now, F.col("tab_id") == 1, at(20), status=F.lit("partial"))
    steps.append(log.clears(now, at(3), at(30)))
    now = store.clear_messages(now, at(30))
    steps.append(log.deletes(now.filter(F.col("tab_id") == 3), at(4)))
    now = store.delete_contexts(now, 3)
    steps.append(log.updates(new.filter(F.col("tab_id") == 3), at(5), at(40), title=F.lit("nowhere")))  # nothing to update
    steps.append(log.updates(now.filter(F.col("url") == A), at(6), at(50), title=F.concat(F.col("title"), F.lit("!")), checkpoint=F.lit("z")))
    now = store.update_contexts(now, F.col("url") == A, at(50), title=F.concat(F.col("title"), F.lit("!")), checkpoint=F.lit("z"))
    last = contexts(spark, [(3, B, "back", 1, None, 60)])
    steps.append(log.saves(last, at(7)))
    now = store.save_contexts(now, last)
    want = plain(now)
    every = steps[0]
    for s in steps[1:]:
        every = every.unionByName(s)
    assert plain(log.applied(start, log.folded(every))) == want
    # In several batches, and with their folds joined before they are applied
    for cut in (1, 3, 5):
        first, rest = every.filter(F.col("seq") <= cut), every.filter(F.col("seq") > cut)
        assert plain(log.applied(log.applied(start, log.folded(first)), log.folded(rest))) == want
        assert plain(log.applied(start, log.joined(log.folded(first), log.folded(rest)))) == want


@pytest.mark.parametrize("kind", ["none", "unknown"])
def test_an_empty_log(spark, kind):
    start = contexts(spark, [(1, A, "one", 2, "c", 5)])
    rows = log.saves(start, F.lit(1)).limit(0) if kind == "none" else log.updates(contexts(spark, [(9, B, "x", 1, None, 1)]), F.lit(1), F.lit(2), title=F.lit("y"))
    assert plain(log.applied(start, log.folded(rows))) == plain(start)
