"""State by key: completed turns of conversations as they come in, and one answer at a time for a page.

Conversations are a keyed state of messages: a row goes to the state of its conversation, wherever it was when it began, so a question and its
answer meet in whatever batches and on whatever page they come. A higher generation clears what lower ones left; what these still send
is passed over, and so is all up to the generation of a deletion. What changes is put out as rows of a log (put or drop of one
turn), and archive() is the log's last word on every turn. A batch's rows are written under the id of the query that made them, so a batch that runs again replaces
itself, and a query that begins anew, with an empty checkpoint, adds to the archive and takes precedence.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta, timezone
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MESSAGE = "conv_id long, msg_idx long, role string, content string, created_at long, error boolean, url string, generation long"
CHANGE = "conv_id long, generation long, revision long, msg_idx long, op string, url string, created_at long, question string, answer string"
#: A row of this role deletes its conversation, up to its generation.
DELETED = "deleted"
#: Kinds of messages by place: questions and answers that aren't in error; 0 is for all others.
QUESTION, ANSWER = 1, 2
EVENT = "key string, kind string, request_id string, at timestamp"
DECISION = "key string, request_id string, at timestamp, accepted boolean, open_request string"
#: How long an answer may take.
TIMEOUT_SECONDS = 45
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Turns(StatefulProcessor):
    """MESSAGE rows of a conversation to CHANGE rows.

    Rows go to the state one by one, in whatever order they come; of two with the same place and generation the one of the later time counts. In memory are
    only the places of a conversation's messages and what kind each is; texts are read for the turns next to a changed place.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "generation long, deleted long, revision long, places binary")
        self.messages = handle.getMapState("messages", "msg_idx long", "role string, content string, created_at long, error boolean, url string")
        self.told = handle.getMapState("told", "msg_idx long", "answer_idx long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        generation, deleted, revision, packed = self.head.get() if self.head.exists() else (-1, -1, 0, b"")
        kinds = {int(x) >> 2: int(x) & 3 for x in np.frombuffer(packed, np.int64)}
        changed: set[int] = set()
        gone: set[int] = set()
        for part in rows:
            for r in part.to_dict("records"):
                own, at = int(r["generation"]), int(r["msg_idx"])
                if own < generation or own <= deleted:
                    continue
                if own > generation or r["role"] == DELETED:
                    gone |= {k[0] for k in self.told.keys()}
                    self.messages.clear()
                    self.told.clear()
                    kinds, changed, generation = {}, set(), own
                if r["role"] == DELETED:
                    deleted = own
                    continue
                new = (r["role"], r["content"], int(r["created_at"]), bool(r["error"]), r["url"])
                old = self.messages.getValue((at,)) if at in kinds else None
                if old is None or (new[2], new[1]) >= (old[2], old[1]):
                    self.messages.updateValue((at,), new)
                    kinds[at] = 0 if new[3] else {"user": QUESTION, "assistant": ANSWER}.get(new[0], 0)
                    changed.add(at)
        order = sorted(kinds)
        self.head.update((generation, deleted, revision + 1, np.array([at * 4 + kinds[at] for at in order], np.int64).tobytes()))
        yield from _frames((key[0], generation, revision + 1, *x) for x in self._changes(order, kinds, changed, gone))

    def _changes(self, order: list[int], kinds: dict[int, int], changed: set[int], gone: set[int]) -> Iterator[tuple]:
        """msg_idx, op and the rest of a CHANGE of all turns that begin at a changed place or before one, and of those that went."""
        drop = ("drop", None, None, None, None)
        yield from ((at, *drop) for at in sorted(gone))
        places = {bisect_left(order, at) for at in changed}
        for k in sorted(places | {k - 1 for k in places if k}):
            at, next_ = order[k], order[k + 1] if k + 1 < len(order) else None
            told = self.told.getValue((at,)) if self.told.containsKey((at,)) else None
            if next_ is not None and (kinds[at], kinds[next_]) == (QUESTION, ANSWER):
                if told is None or told[0] != next_ or not changed.isdisjoint((at, next_)):
                    asked, answer = self.messages.getValue((at,)), self.messages.getValue((next_,))
                    self.told.updateValue((at,), (next_,))
                    yield at, "put", asked[4], asked[2], asked[1], answer[1]
            elif told is not None:
                self.told.removeKey((at,))
                yield at, *drop

    def close(self) -> None:
        pass


def _frames(rows: Iterator[tuple], most: int = 1000) -> Iterator[pd.DataFrame]:
    while part := list(islice(rows, most)):
        yield pd.DataFrame(part, columns=[c.split()[0] for c in CHANGE.split(", ")])


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep keyed state in STATE_STORE; the session's own setting comes back."""
    name, kind = STATE_STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, kind)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def changes(messages: DataFrame) -> DataFrame:
    """CHANGE rows of a stream of MESSAGE rows, to be started inside keyed_state()."""
    return messages.groupBy("conv_id").transformWithStateInPandas(statefulProcessor=Turns(), outputStructType=CHANGE, outputMode="Update", timeMode="None")


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _place(spark: SparkSession, folder: str, checkpoint: str) -> str:
    """The folder of a query's changes: its place among the queries that have written to the archive, and its id."""
    own = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
    where, files = _files(spark, folder)
    there = [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []
    known = [x for x in there if x.endswith(own)]
    return f"{folder}/{known[0] if known else f'query={len([x for x in there if x.startswith('query=')]):06d}-{own}'}"


def archive_stream(spark: SparkSession, source: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Read message files and write each batch's changes; only one query may write to an archive at a time."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{_place(spark, folder, checkpoint)}/batch={number}")

    made = changes(spark.readStream.schema(MESSAGE).parquet(source))
    with keyed_state(spark):
        return made.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def archived_turns(spark: SparkSession, folder: str) -> DataFrame:
    """url, question_id, ord (by time, then place), created_at, question, answer: the log's last word on every turn, of each conversation's highest generation."""
    log = spark.read.schema(f"{CHANGE}, query string, batch long").option("basePath", folder).parquet(folder)
    last = log.groupBy("conv_id", "msg_idx").agg(F.max_by(F.struct("generation", "op", "url", "created_at", "question", "answer"), F.struct("generation", "query", "revision", F.col("op") == "put")).alias("t"))
    newest = log.groupBy("conv_id").agg(F.max("generation").alias("_newest"))
    held = last.join(newest, "conv_id").filter("t.op = 'put' and t.generation = _newest").select("conv_id", "msg_idx", "t.*")
    order = Window.partitionBy("url").orderBy("created_at", "conv_id", "msg_idx")
    return held.select("url", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("msg_idx").cast("string")).alias("question_id"), (F.row_number().over(order) - 1).cast("int").alias("ord"), "created_at", "question", "answer")


class Flights(StatefulProcessor):
    """EVENT rows of a page (kind request or answer) to a DECISION on every request.

    A request is accepted if none is open; an open one ends with its answer, or TIMEOUT_SECONDS after it began. Events of a page in a batch (ids and times)
    are sorted by time; one that comes after a later request was accepted counts at the time it has, so it is refused.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "request_id string, began timestamp, until timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.open.get() if self.open.exists() else None
        before, out = held, []
        for r in pd.concat(list(rows)).sort_values(["at", "kind", "request_id"], kind="stable").to_dict("records"):
            at = r["at"].to_pydatetime()
            if r["kind"] == "answer":
                held = None if held and held[0] == r["request_id"] else held
            elif held is None or at >= held[2]:
                held = (r["request_id"], at, at + timedelta(seconds=TIMEOUT_SECONDS))
                out.append((key[0], r["request_id"], r["at"], True, r["request_id"]))
            else:
                out.append((key[0], r["request_id"], r["at"], r["request_id"] == held[0], held[0]))
        if held != before:
            self._hold(held)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in DECISION.split(", ")])

    def _hold(self, held: tuple | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held is None:
            self.open.clear()
        else:
            self.open.update(held)
            self.handle.registerTimer(int(held[2].replace(tzinfo=held[2].tzinfo or timezone.utc).timestamp() * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.open.clear()
        return iter([])

    def close(self) -> None:
        pass


def decisions(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """DECISION rows of a stream of EVENT rows, which may come late by so much; to be started inside keyed_state()."""
    dated = events.withWatermark("at", late)
    return dated.groupBy("key").transformWithStateInPandas(statefulProcessor=Flights(), outputStructType=DECISION, outputMode="Append", timeMode="EventTime")
