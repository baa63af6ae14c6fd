"""Operations on contexts as a log, folded by key in the order of their numbers.

A queue that runs one change after another becomes a log: rows of (tab_id, url, seq, kind, row, changed). What a key's operations do together has a
normal form: the last save or delete, and of every field the last change behind it. Two such forms join to one (the later
base wins, and of each field the later change), so the fold is an aggregation that is combined before the shuffle: the operations of a busy key never
meet in one task, and batches folded one after another give what one fold of all gives.

Kinds: save (the whole row), update (the fields that changed names), clear (no messages, no checkpoint) and delete. An update of a context that
isn't there makes none, as after a delete. Of operations with equal numbers the one that compares higher counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.store import is_context

KEY = ["tab_id", "url"]
#: The other columns of a context.
FIELDS = ["normalized_url", "title", "status", "is_partial", "focus", "messages", "checkpoint", "updated_at"]


def saves(contexts: DataFrame, seq: Column) -> DataFrame:
    return contexts.select(*KEY, seq.cast("long").alias("seq"), F.lit("save").alias("kind"), F.struct(*contexts.columns).alias("row"), F.array().cast("array<string>").alias("changed"))


def updates(contexts: DataFrame, seq: Column, now: Column, **changes: Column) -> DataFrame:
    """Updates of the keys of contexts to these values; they are columns of contexts."""
    new = {**changes, "updated_at": now.cast("long")}
    row = F.struct(*KEY, *(new[f].alias(f) if f in new else F.lit(None).cast(contexts.schema[f].dataType).alias(f) for f in FIELDS))
    return contexts.select(*KEY, seq.cast("long").alias("seq"), F.lit("update").alias("kind"), row.alias("row"), F.array(*map(F.lit, new)).alias("changed"))


def clears(contexts: DataFrame, seq: Column, now: Column) -> DataFrame:
    """Clears of the contexts that have messages."""
    some = contexts.filter(F.size("messages") > 0)
    return updates(some, seq, now, messages=F.filter("messages", lambda m: F.lit(False)), checkpoint=F.lit(None).cast("string")).withColumn("kind", F.lit("clear"))


def deletes(contexts: DataFrame, seq: Column) -> DataFrame:
    return saves(contexts, seq).withColumn("kind", F.lit("delete")).withColumn("row", F.when(F.lit(False), F.col("row")))


def folded(log: DataFrame) -> DataFrame:
    """KEY, base (seq, kind, row: the last save or delete, or null) and of every field its last change (seq, value, or null)."""
    whole = F.col("kind").isin("save", "delete")
    base = F.max_by(F.struct("seq", "kind", "row"), F.when(whole, F.struct("seq", "kind")))
    last = lambda f: F.max_by(F.struct("seq", F.col(f"row.{f}").alias("value")), F.when(~whole & F.array_contains("changed", f), F.struct("seq", "kind")))
    return log.filter(F.col("tab_id").isNotNull() & F.col("url").isNotNull()).groupBy(*KEY).agg(base.alias("base"), *(last(f).alias(f"last_{f}") for f in FIELDS))


def joined(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two folds as one; numbers of the second are higher where keys meet."""
    one, two = first.alias("a"), second.alias("b")
    keys = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in KEY]
    later = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}"))
    return one.join(two, keys, "full_outer").select(*(later(c).alias(c) for c in first.columns))


def applied(contexts: DataFrame, fold: DataFrame) -> DataFrame:
    """The contexts as the folded operations leave them."""
    held = contexts.filter(is_context()).alias("c").join(fold.alias("f"), [F.col(f"c.{k}") == F.col(f"f.{k}") for k in KEY], "full_outer")
    based = F.col("base").isNotNull()
    there = F.when(based, F.col("base.kind") == "save").otherwise(F.col("c.tab_id").isNotNull())

    def value(field: str) -> Column:
        start = F.when(based, F.col(f"base.row.{field}")).otherwise(F.col(f"c.{field}"))
        last = F.col(f"last_{field}")
        return F.when(last.isNotNull() & (~based | (last["seq"] > F.col("base.seq"))), last["value"]).otherwise(start)

    return held.filter(F.coalesce(there, F.lit(False))).select(*(F.coalesce(f"c.{k}", f"f.{k}").alias(k) if k in KEY else value(k).alias(k) for k in contexts.columns))
