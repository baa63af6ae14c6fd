"""Which operations on pages still count, and what happens when tabs close and settings change, as batch transformations.

Versions are rows of (key, version) with a counter of all keys in every row: an operation that began under another version of
its page, or of all pages, is stale. Changes reach the store one batch after another (foreachBatch runs them in order),
so they are never mixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.store import delete_contexts, save_conversations

VERSIONS = "key string, version long"


def invalidated(versions: DataFrame, keys: DataFrame) -> DataFrame:
    """versions with one more for every key of keys; new ones begin at 1."""
    more = keys.select("key", F.lit(1).cast("long").alias("version")).distinct()
    return versions.unionByName(more).groupBy("key").agg(F.sum("version").alias("version"))


def current(operations: DataFrame, versions: DataFrame, all_version: int = 0) -> DataFrame:
    """The operations (key, version and all_version when they began, and whatever else) that nothing has made stale; a key without a row is at 0."""
    known = versions.withColumnRenamed("version", "_now")
    held = operations.join(known, "key", "left").filter((F.coalesce("_now", F.lit(0)) == F.col("version")) & (F.col("all_version") == all_version))
    return held.select(*operations.columns)


def single_flight(requests: DataFrame) -> DataFrame:
    """Of the requests open for a page (key, asked_at, request_id) the first, which the others wait for."""
    order = Window.partitionBy("key").orderBy("asked_at", "request_id")
    return requests.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def _kept(contexts: DataFrame, fresh: Column | None) -> DataFrame:
    some = contexts.filter(F.size("messages") > 0)
    return some if fresh is None else some.filter(fresh)


def close_tab(contexts: DataFrame, archive: DataFrame, tab: int, retain: bool, now: Column, fresh: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """contexts without the tab's, and the archive with their conversations if these are retained; fresh: which contexts' archive hasn't been cleared since."""
    closed = _kept(contexts.filter(F.col("tab_id") == tab), fresh)
    return delete_contexts(contexts, tab), save_conversations(archive, closed, now) if retain else archive


def retain_all(contexts: DataFrame, archive: DataFrame, now: Column, fresh: Column | None = None) -> DataFrame:
    """The archive when retention is switched on: the conversations of all open contexts come in."""
    return save_conversations(archive, _kept(contexts, fresh), now)
