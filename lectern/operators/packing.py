"""Windows around ranked chunks, fusion of what channels offer, and packing under a budget, inside Spark's plan.

Each choice depends on those before it, so each is a fold (aggregate()) over one question's offers in order. What a fold
walks is small by its making: candidates of one article for one question, a row of integers each; texts are never in it. The
offers themselves are relations that joins and windows make, for all questions at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import chunk_cost
from lectern.operators.evidence import RRF, WEIGHTS, WINDOWS

#: A chunk or window as evidence: its cost of a budget, the length of its text, and the blocks it stands for.
CHUNK = "struct<chunk_id: string, cost: bigint, length: bigint, block_ids: array<string>>"
CANDIDATE = f"struct<key: string, chunk: {CHUNK}, sources: array<string>, reasons: array<string>, score: double, pinned: boolean, needs: array<int>>"
PICKED = "struct<left: bigint, out: array<struct<k: int, low: int, high: int, cost: bigint>>>"


def facts(chunks: DataFrame) -> DataFrame:
    """article_id, chunk_idx, chunk (CHUNK), before and after: what is beside a chunk in its section (chunk_idx, chunk)."""
    order = Window.partitionBy("article_id").orderBy("chunk_idx")
    chunk = F.struct("chunk_id", chunk_cost(F.col("section"), F.col("text")).cast("long").alias("cost"), F.length("text").cast("long").alias("length"), "block_ids")
    lean = chunks.select("article_id", "chunk_idx", "section", chunk.alias("chunk"))
    beside = lambda f: F.when(f("section").over(order) == F.col("section"), f(F.struct("chunk_idx", "chunk")).over(order))
    return lean.select("article_id", "chunk_idx", "chunk", beside(F.lag).alias("before"), beside(F.lead).alias("after"))


def windows(held: DataFrame, ranked: DataFrame, key: list[str]) -> DataFrame:
    """key, rank (from 0), chunk_idx (the first), chunk: windows around ranked chunks, best first, that fit and don't overlap.

    held: facts(). ranked: key with article_id, place, chunk_idx, budget, most. A window is a chunk with those beside it in its section
    that no window has and that still fit; a chunk that doesn't fit is passed over.
    """
    own = F.struct("place", "chunk_idx", "chunk", "before", "after")
    lists = ranked.join(held, ["article_id", "chunk_idx"]).groupBy(*key).agg(F.min("budget").cast("long").alias("_budget"), F.min("most").alias("_most"), F.array_sort(F.collect_list(own)).alias("_c"))
    none, free = F.lit(-1), F.lit(0).cast("long")
    index = lambda x: F.coalesce(x["chunk_idx"].cast("int"), none)
    more = lambda x: F.coalesce(x["chunk"]["length"] + 1, free)
    lean = lists.withColumn("_lean", F.transform("_c", lambda c, k: F.struct(k.alias("k"), index(c).alias("at"), c["chunk"]["cost"].alias("cost"), index(c["before"]).alias("b"), more(c["before"]).alias("bn"), index(c["after"]).alias("a"), more(c["after"]).alias("an"))))

    def step(s: Column, c: Column) -> Column:
        taken = lambda i: F.exists(s["out"], lambda w: (w["low"] <= i) & (i <= w["high"]))
        back = (c["b"] >= 0) & ~taken(c["b"]) & (c["cost"] + c["bn"] <= s["left"])
        cost = c["cost"] + F.when(back, c["bn"]).otherwise(free)
        on = (c["a"] >= 0) & ~taken(c["a"]) & (cost + c["an"] <= s["left"])
        total = cost + F.when(on, c["an"]).otherwise(free)
        one = F.struct(c["k"].alias("k"), F.when(back, c["b"]).otherwise(c["at"]).alias("low"), F.when(on, c["a"]).otherwise(c["at"]).alias("high"), total.alias("cost"))
        fits = (F.size(s["out"]) < F.col("_most")) & ~taken(c["at"]) & (c["cost"] <= s["left"])
        return F.when(fits, F.struct((s["left"] - total).alias("left"), F.concat(s["out"], F.array(one)).alias("out"))).otherwise(s).cast(PICKED)

    start = F.struct(F.col("_budget").alias("left"), F.array().alias("out")).cast(PICKED)
    folded = lean.select(*key, "_c", F.posexplode(F.aggregate("_lean", start, step, lambda s: s["out"])).alias("rank", "_w"))
    c = F.get("_c", "_w.k")
    beside = lambda side, end: F.when(F.col(f"_w.{end}") != c["chunk_idx"], F.array(c[side]["chunk"])).otherwise(F.array())
    parts = F.concat(beside("before", "low"), F.array(c["chunk"]), beside("after", "high"))
    made = folded.select(*key, "rank", F.col("_w.low").alias("chunk_idx"), F.col("_w.cost").alias("_cost"), parts.cast(f"array<{CHUNK}>").alias("_p"))
    length = F.aggregate("_p", F.lit(-1).cast("long"), lambda n, p: n + p["length"] + 1)
    chunk = F.struct(F.concat(F.lit("window-"), F.get("_p", F.lit(0))["chunk_id"], F.lit("-"), F.element_at("_p", -1)["chunk_id"]).alias("chunk_id"), F.col("_cost").alias("cost"), length.alias("length"), F.array_distinct(F.flatten(F.transform("_p", lambda p: p["block_ids"]))).alias("block_ids"))
    return made.select(*key, "rank", "chunk_idx", chunk.cast(CHUNK).alias("chunk"))


def fused(offers: DataFrame, key: list[str]) -> DataFrame:
    """key and candidates (array of CANDIDATE): offers in order of channel, need and rank, joined with all candidates that share a block.

    offers: key, source, need (null but for planned needs), rank (from 0), chunk, reason. Scores of what is joined add up; the candidate keeps the key
    of its first part, and is shown by the chunk that is pinned, stands for more blocks, or is longer.
    """
    source = F.array(*map(F.lit, WEIGHTS))
    weight = F.get(F.array(*[F.lit(w) for w in WEIGHTS.values()]), F.array_position(source, F.col("source")).cast("int") - 1)
    one = F.struct(F.array_position(source, F.col("source")).alias("channel"), F.coalesce("need", F.lit(-1)).alias("need"), "rank", F.col("chunk").cast(CHUNK).alias("chunk"), "source", "reason", (weight / (RRF + F.col("rank") + 1)).alias("score"), (F.col("source") == "focus-anchor").alias("pinned"))
    lists = offers.groupBy(*key).agg(F.array_sort(F.collect_list(one)).alias("_offers"))

    def step(held: Column, o: Column) -> Column:
        blocks = o["chunk"]["block_ids"]
        name = F.when(F.size(blocks) > 0, F.array_join(F.array_sort(blocks), "\0")).otherwise(o["chunk"]["chunk_id"])
        touches = lambda c: (c["key"] == name) | F.arrays_overlap(c["chunk"]["block_ids"], blocks)
        touched = F.filter(held, touches)
        shown = lambda chunk, pinned, k: F.struct((~pinned).alias("p"), (-F.size(chunk["block_ids"])).alias("b"), (-chunk["length"]).alias("n"), k.alias("k"), chunk.alias("c"))
        best = F.array_min(F.concat(F.transform(touched, lambda c, k: shown(c["chunk"], c["pinned"], k)), F.array(shown(o["chunk"], o["pinned"], F.size(touched)))))["c"]
        every = lambda f, last: F.array_distinct(F.concat(F.flatten(F.transform(touched, lambda c: c[f])), last))
        joined = F.struct(
            F.coalesce(F.get(touched, F.lit(0))["key"], name).alias("key"), best.alias("chunk"), every("sources", F.array(o["source"])).alias("sources"), every("reasons", F.array(o["reason"])).alias("reasons"),
            (F.aggregate(touched, F.lit(0.0), lambda x, c: x + c["score"]) + o["score"]).alias("score"), (F.exists(touched, lambda c: c["pinned"]) | o["pinned"]).alias("pinned"), every("needs", F.when(o["need"] >= 0, F.array(o["need"])).otherwise(F.array().cast("array<int>"))).alias("needs"),
        )
        return F.concat(F.filter(held, lambda c: ~touches(c)), F.array(joined)).cast(f"array<{CANDIDATE}>")

    return lists.select(*key, F.aggregate("_offers", F.array().cast(f"array<{CANDIDATE}>"), step).alias("candidates"))


def packed(candidates: DataFrame, key: list[str], most: int = WINDOWS) -> DataFrame:
    """key and evidence: candidates by phases, as far as each fits: what is pinned, for each need its best, coverage, and the rest.

    candidates: key, candidates, needs (how many there are; null: none), budget. Of a need only the best candidate that isn't taken is tried.
    """
    by = F.transform("candidates", lambda e: F.struct((~e["pinned"]).alias("p"), (-e["score"]).alias("s"), e["chunk"]["chunk_id"].alias("i"), e.alias("e")))
    ranked = candidates.withColumn("_ranked", F.transform(F.array_sort(by), lambda x, k: F.struct(k.alias("k"), x["e"].alias("e"))))
    of = lambda wanted: F.transform(F.filter("_ranked", lambda x: wanted(x["e"])), lambda x: x["k"])
    needs = F.when(F.col("needs") > 0, F.transform(F.sequence(F.lit(1), F.col("needs")), lambda n: -n)).otherwise(F.array().cast("array<int>"))
    tries = ranked.withColumn("_tries", F.concat(of(lambda e: e["pinned"]), needs, of(lambda e: F.array_contains(e["sources"], "document-coverage")), F.transform("_ranked", lambda x: x["k"])).cast("array<int>"))
    state = "struct<left: bigint, out: array<int>>"

    def step(s: Column, t: Column) -> Column:
        open_ = F.filter("_ranked", lambda x: F.array_contains(x["e"]["needs"], -t - 1) & ~F.array_contains(s["out"], x["k"]))
        k = F.when(t >= 0, t).otherwise(F.get(open_, F.lit(0))["k"])
        cost = F.get("_ranked", k)["e"]["chunk"]["cost"]
        fits = F.coalesce((F.size(s["out"]) < most) & ~F.array_contains(s["out"], k) & (cost <= s["left"]), F.lit(False))
        return F.when(fits, F.struct((s["left"] - cost).alias("left"), F.concat(s["out"], F.array(k)).alias("out"))).otherwise(s).cast(state)

    start = F.struct(F.col("budget").cast("long").alias("left"), F.array().alias("out")).cast(state)
    chosen = tries.withColumn("_picked", F.aggregate("_tries", start, step, lambda s: s["out"]))
    return chosen.select(*key, F.transform("_picked", lambda k: F.get("_ranked", k)["e"]).alias("evidence"))
