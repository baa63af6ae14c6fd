"""A question's evidence from channels that are given: the whole article if it fits, else windows, fused and packed; the rest is history's."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.model_json import query_plan
from lectern.functions.text import chunk_cost
from lectern.operators import evidence as E
from lectern.operators import packing
from lectern.sources.batches import by_key

REQUEST_BUDGET, HISTORY_BUDGET, PLANNED_HISTORY_BUDGET = 64_000, 8_000, 16_000
KEY = ["article_id", "query_id"]
#: A channel's list of a question.
OFFER = [*KEY, "source", "need"]
#: Windows for one planned need.
NEED_WINDOWS = 3
#: Channels whose chunks are offered as they are, without windows.
ALONE = ("focus-anchor", "document-coverage")


def packed_windows(chunks: DataFrame, ranked: DataFrame, budget: int, limit: int = E.WINDOWS) -> DataFrame:
    """article_id, query_id, rank, chunk_id, cost: windows around ranked chunks (article_id, query_id, chunk_idx, place)."""
    made = packing.windows(packing.facts(chunks), ranked.select(*KEY, "place", "chunk_idx", F.lit(budget).alias("budget"), F.lit(limit).alias("most")), KEY)
    return made.select(*KEY, (F.col("rank") + 1).alias("rank"), "chunk.chunk_id", F.col("chunk.cost").cast("int").alias("cost"))


def covered(chunks: DataFrame, budget: int = E.WHOLE_BUDGET, limit: int | None = E.WINDOWS) -> DataFrame:
    """article_id, chunk_idx: chunks spread over each document; with limit None as many as fit. Texts stay behind; only their lengths are looked at."""
    kind = chunks.schema["article_id"].dataType.simpleString()
    names = ("chunk_idx", "section", "block_ids", "cost")
    lean = chunks.select("article_id", "chunk_idx", "section", "block_ids", chunk_cost(F.col("section"), F.col("text")).alias("cost"))

    def of_article(rows: list[tuple]) -> list[tuple]:
        own = [dict(zip(names, r[1:], strict=True)) for r in rows]
        return [(rows[0][0], own[k]["chunk_idx"]) for k in E.cover(own, budget, len(own) if limit is None else limit)]

    made = pa.schema([("article_id", pa.string() if kind == "string" else pa.int64()), ("chunk_idx", pa.int32())])
    return by_key(lean, ["article_id"], "chunk_idx", of_article, made, f"article_id {kind}, chunk_idx int")


def assemble(chunks: DataFrame, questions: DataFrame, channels: DataFrame, budget: int = REQUEST_BUDGET) -> DataFrame:
    """article_id, query_id, rank, chunk_id, sources, pinned, score, cost, strategy of every question (article_id, query_id, history_length, plan_json, checkpoint_json).

    channels: article_id, query_id, source, need (null but for planned needs), place, chunk_idx: the ranked chunks of the
    retrieval operators; windows are made here, under the budget that history and checkpoint leave. An article that fits
    as a whole is taken whole, a row a chunk.
    """
    facts = packing.facts(chunks)
    sizes = facts.groupBy("article_id").agg(F.sum("chunk.cost").alias("_full"))
    compact = F.coalesce(F.length(F.to_json(F.try_parse_json("checkpoint_json"))), F.length("checkpoint_json"), F.lit(0))
    asked = questions.join(sizes, "article_id").select(*KEY, F.coalesce("history_length", F.lit(0)).alias("_history"), query_plan(F.col("plan_json")).alias("_plan"), F.greatest(F.lit(1), F.lit(budget) - compact).alias("_room"), "_full")
    share = F.least(F.when(F.coalesce("_plan.use_conversation", F.lit(False)), PLANNED_HISTORY_BUDGET).otherwise(HISTORY_BUDGET), F.col("_room"))
    known = asked.select(*KEY, (F.col("_full") <= F.col("_room")).alias("_fits"), F.greatest(F.lit(1), F.col("_room") - F.least("_history", share)).cast("long").alias("budget"), F.coalesce(F.size("_plan.evidence_needs"), F.lit(0)).alias("needs"))
    rest = known.filter(~F.col("_fits"))
    # A stored table of offers is many times its file's size, by which Spark would send it to every task.
    offered = channels.hint("merge").join(rest.select(*KEY, "budget"), KEY).withColumn("most", F.when(F.col("source") == "planned-need", NEED_WINDOWS).otherwise(E.WINDOWS))
    around = packing.windows(facts, offered.filter(~F.col("source").isin(*ALONE)), OFFER).select(*OFFER, "rank", "chunk")
    order = Window.partitionBy(*OFFER).orderBy("place")
    alone = offered.filter(F.col("source").isin(*ALONE)).withColumn("rank", F.row_number().over(order) - 1).join(facts, ["article_id", "chunk_idx"]).select(*OFFER, "rank", "chunk")
    fused = packing.fused(around.unionByName(alone).withColumn("reason", F.col("source")), KEY)
    chosen = packing.packed(fused.join(rest, KEY), KEY).select(*KEY, F.posexplode("evidence").alias("_k", "e"))
    some = chosen.select(*KEY, (F.col("_k") + 1).alias("rank"), "e.chunk.chunk_id", F.array_join(F.array_sort("e.sources"), ",").alias("sources"), "e.pinned", F.round("e.score", 9).alias("score"), F.col("e.chunk.cost").cast("int").alias("cost"), F.lit("fused-retrieval").alias("strategy"))
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("chunk_idx"))
    whole = known.filter("_fits").select(*KEY).join(facts, "article_id").select(*KEY, place.alias("rank"), "chunk.chunk_id", F.lit("full-article").alias("sources"), F.lit(False).alias("pinned"), F.lit(1.0).alias("score"), F.col("chunk.cost").cast("int").alias("cost"), F.lit("full-context").alias("strategy"))
    return whole.unionByName(some)
