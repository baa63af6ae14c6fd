"""A question's whole context in one plan: history and evidence under one budget, with a report of what each takes.

Questions are rows of article_id, query_id, conv_id, question, focus_type, focus_text, focus_section, focus_scope,
heading_level, plan_json, checkpoint_json (compact), planned (whether planning is done). An article that fits beside the checkpoint is
taken whole, and history has the rest. Else history has a share, and what is left goes to evidence from all channels: what is in
focus (its section, or its neighbourhood, or what a search for the question finds), literals, a search with the question and all that
is known of it, a search for each planned need, and a spread over the document.

All searches of all questions are one search: its queries carry question, channel and need as their id, so postings and statistics are
made once. All windows are made in one step, and so are fusion and packing. Chunks are read by column for each of these; they should be a
stored table, as every reader of one derives it anew otherwise. What several steps read is stored between them, without texts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.model_json import query_plan
from lectern.functions.text import chunk_cost, is_whole_article_question, token_set
from lectern.operators import evidence as E
from lectern.operators import memory, packing, search
from lectern.operators.assemble import HISTORY_BUDGET, KEY, NEED_WINDOWS, OFFER, PLANNED_HISTORY_BUDGET
from lectern.operators.retrieve import global_queries
from lectern.settings import Settings
from lectern.sources.batches import by_key
from lectern.sources.scratch import stored

#: Characters of history that are taken for their age.
RECENT_HISTORY = 8_000
DEFAULTS = Settings()
REASONS = {
    "full-article": "the whole article fits beside the history",
    "focus-anchor": "what the question points at, and what is around it",
    "exact-match": "holds words of the question literally",
    "global-search": "found by the question and what is known of it",
    "document-coverage": "shows another part of the document",
}


def requests(chunks: DataFrame, questions: DataFrame, turns: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """The questions with plan, fits, limit, full_article_characters, checkpoint_characters, history_characters and article_budget, and
    the turns of their history (KEY, turn_idx, how).

    turns: completed turns (conv_id, turn_idx, question, answer, turn_length). A question without an article, or without a conversation, has none.
    """
    sizes = chunks.groupBy("article_id").agg(F.sum(chunk_cost(F.col("section"), F.col("text"))).cast("long").alias("_full"))
    limit = F.lit(max(1, settings.request_budget)).cast("long")
    # Stored, so that plans are read once and not for every column that depends on them; the file is many times smaller than its rows, so it must not be sent to every task.
    asked = stored(questions.select("*", query_plan(F.col("plan_json")).alias("plan"), limit.alias("limit"), F.coalesce(F.length("checkpoint_json"), F.lit(0)).cast("long").alias("checkpoint_characters")), "asked").hint("merge")
    held = asked.join(sizes, "article_id", "left").withColumn("full_article_characters", F.coalesce("_full", F.lit(0).cast("long"))).drop("_full")
    available = F.greatest(F.lit(1), F.col("limit") - F.col("checkpoint_characters"))
    share = F.when(F.coalesce(F.col("plan.use_conversation"), F.lit(False)), PLANNED_HISTORY_BUDGET).otherwise(HISTORY_BUDGET)
    held = held.withColumn("_available", available).withColumn("fits", F.col("full_article_characters") <= F.col("_available"))
    held = held.withColumn("_room", F.when(F.col("fits"), F.col("_available") - F.col("full_article_characters")).otherwise(F.least(share, F.col("_available"))).cast("long"))
    history = stored(memory.history_for(turns, held.select(*KEY, "conv_id", "question", "focus_text", F.col("_room").alias("budget"), F.least("_room", F.lit(RECENT_HISTORY)).alias("recent_budget")), KEY, settings.recent_turns, settings.recalled_turns), "history")
    taken = history.groupBy(*KEY).agg(F.sum("turn_length").cast("long").alias("_taken"))
    full = held.join(taken, KEY, "left").withColumn("history_characters", F.coalesce("_taken", F.lit(0).cast("long")))
    room = F.when(F.col("fits"), F.col("full_article_characters")).otherwise(F.greatest(F.lit(1), F.col("_available") - F.col("history_characters")))
    return full.withColumn("article_budget", room.cast("long")).drop("_available", "_room", "_taken"), history


def covered_for(chunks: DataFrame, asked: DataFrame, most: int = E.WINDOWS) -> DataFrame:
    """KEY, chunk_idx: chunks spread over the article of each question (KEY, budget). Texts stay behind; only their lengths are looked at."""
    names = ("chunk_idx", "section", "block_ids", "cost")
    lean = chunks.select("article_id", "chunk_idx", "section", "block_ids", chunk_cost(F.col("section"), F.col("text")).alias("cost"))
    kinds = ", ".join(f"{c} {asked.schema[c].dataType.simpleString()}" for c in KEY) + ", chunk_idx int"

    def of_question(rows: list[tuple]) -> list[tuple]:
        own = [dict(zip(names, r[2:6], strict=True)) for r in rows]
        return [(*rows[0][:2], own[k]["chunk_idx"]) for k in E.cover(own, int(rows[0][6]), most)]

    made = pa.schema([(c, pa.string() if asked.schema[c].dataType.simpleString() == "string" else pa.int64()) for c in KEY] + [("chunk_idx", pa.int32())])
    return by_key(asked.select(*KEY, "budget").join(lean, "article_id").select(*KEY, *names, "budget"), KEY, "chunk_idx", of_question, made, kinds)


def channels(chunks: DataFrame, asked: DataFrame, tokenizer: search.Tokenizer = search.retrieval_terms, settings: Settings = DEFAULTS) -> DataFrame:
    """OFFER, rank, chunk, reason: what every channel has to say of each question of requests() whose article doesn't fit."""
    none, facts = F.lit(None).cast("int"), stored(packing.facts(chunks), "chunk-facts")
    rest = asked.filter(~F.col("fits"))
    focus = rest.filter(F.col("focus_type").isNotNull())
    section = search.section_scope(chunks, focus.filter("focus_type = 'text' and focus_scope = 'section'").select(*KEY, "focus_section", "heading_level", "article_budget"), search.ANCHORS, F.col("article_budget"))
    section = stored(section.withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy("chunk_idx"))), "focus-section")
    left = focus.join(section.select(*KEY).distinct(), KEY, "left_anti")
    pointed = left.filter((F.size(token_set(F.col("focus_text"))) > 0) | (F.size(token_set(F.col("focus_section"))) > 0))
    anchor = stored(search.focus_anchors(chunks, pointed.select(*KEY, "focus_text", "focus_section").hint("merge")), "focus-anchors")
    unplaced = left.join(anchor.select(*KEY).distinct(), KEY, "left_anti")

    ask = lambda df, source, need: df.select("article_id", F.struct("query_id", F.lit(source).alias("source"), need.alias("need")).alias("query_id"), "pos", "text")
    again = unplaced.select(*KEY, F.lit(0).alias("pos"), F.col("question").alias("text"))
    every = rest.select(*KEY, F.posexplode(global_queries(F.col("question"), F.when(F.col("focus_type").isNotNull(), F.col("focus_text")), F.col("plan"))).alias("pos", "text"))
    needs = rest.select(*KEY, F.posexplode("plan.evidence_needs").alias("need", "_n"))
    planned = needs.select(*KEY, "need", F.lit(0).alias("pos"), F.col("_n.query").alias("text"))
    queries = ask(again, "focus-anchor", none).unionByName(ask(every, "global-search", none)).unionByName(ask(planned, "planned-need", F.col("need")))
    found = search.fuse(search.bm25(chunks, search.distinct_queries(queries), settings.candidates, tokenizer=tokenizer)).select("article_id", "query_id.*", "chunk_idx", "place")
    exact = search.literal_matches(chunks, rest.select(*KEY, "question", "focus_text"), F.col("focus_text")).select(*KEY, F.lit("exact-match").alias("source"), none.alias("need"), "chunk_idx", "place")
    most = F.when(F.col("source").isin("global-search", "exact-match"), settings.windows).otherwise(NEED_WINDOWS)
    ranked = stored(found.unionByName(exact).withColumn("most", most), "ranked").join(rest.select(*KEY, F.col("article_budget").alias("budget")), KEY)
    around = packing.windows(facts, ranked, OFFER).select(*OFFER, "rank", "chunk")

    wide = rest.filter((F.col("plan.coverage") == "document-wide") | is_whole_article_question(F.col("question")))
    spread = covered_for(chunks, wide.select(*KEY, F.least("article_budget", F.lit(E.COVERAGE_BUDGET)).alias("budget")), settings.windows).withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy("chunk_idx")))
    alone = lambda df, source: df.join(facts.select("article_id", "chunk_idx", "chunk"), ["article_id", "chunk_idx"]).select(*KEY, F.lit(source).alias("source"), none.alias("need"), (F.col("place") - 1).cast("int").alias("rank"), "chunk")
    offers = around.unionByName(alone(section, "focus-anchor")).unionByName(alone(anchor, "focus-anchor")).unionByName(alone(spread, "document-coverage"))
    told = needs.select(*KEY, F.lit("planned-need").alias("source"), "need", F.col("_n.reason").alias("_reason"))
    fixed = F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair))
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"t.{c}")) for c in OFFER]
    return offers.alias("o").join(told.alias("t"), same, "left").select(*(f"o.{c}" for c in OFFER), "rank", "chunk", F.coalesce("_reason", fixed[F.col("o.source")]).alias("reason"))


def question_context(chunks: DataFrame, questions: DataFrame, turns: DataFrame, settings: Settings = DEFAULTS, tokenizer: search.Tokenizer = search.retrieval_terms) -> DataFrame:
    """KEY, strategy, mode, is_truncated, needs_planning, limit, full_article_characters, article_characters, history_characters, checkpoint_characters,
    history (turn_idx, how: in order) and evidence (chunk_id, sources, reasons, score, pinned, cost: best first, or the article's chunks in order). The limits are those of the settings."""
    asked, history = requests(chunks, questions, turns, settings)
    asked = stored(asked, "requests").hint("merge")  # many times its file's size, by which Spark would send it to every task
    offers = packing.fused(stored(channels(chunks, asked, tokenizer, settings), "offers"), KEY)
    budgets = asked.filter(~F.col("fits")).select(*KEY, F.coalesce(F.size("plan.evidence_needs"), F.lit(0)).alias("needs"), F.col("article_budget").alias("budget"))
    some = packing.packed(offers.join(budgets, KEY), KEY, settings.windows)
    shown = lambda e: F.struct(e["chunk"]["chunk_id"].alias("chunk_id"), e["sources"].alias("sources"), e["reasons"].alias("reasons"), e["score"].alias("score"), e["pinned"].alias("pinned"), e["chunk"]["cost"].alias("cost"))
    whole = F.struct("chunk_idx", F.struct("chunk_id", F.array(F.lit("full-article")).alias("sources"), F.array(F.lit(REASONS["full-article"])).alias("reasons"), F.lit(1.0).alias("score"), F.lit(False).alias("pinned"), chunk_cost(F.col("section"), F.col("text")).cast("long").alias("cost")).alias("e"))
    # What fits has at most the budget's characters, so its chunks are few
    all_ = asked.filter("fits").select(*KEY).join(chunks, "article_id").groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(whole)), lambda x: x["e"]).alias("evidence"))
    evidence = some.select(*KEY, F.transform("evidence", shown).alias("evidence")).unionByName(all_)
    told = history.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("turn_idx", "how"))).alias("history"))
    held = asked.join(evidence, KEY, "left").join(told, KEY, "left")
    characters = F.aggregate(F.transform("evidence", lambda e: e["cost"]), F.lit(0).cast("long"), lambda x, c: x + c)
    return held.select(
        *KEY, F.when(F.col("fits"), "full-context").otherwise("fused-retrieval").alias("strategy"), F.when(F.col("fits"), "whole").otherwise("relevant").alias("mode"), (~F.col("fits")).alias("is_truncated"),
        (~F.col("fits") & ~F.coalesce("planned", F.lit(False))).alias("needs_planning"), "limit", "full_article_characters", F.coalesce(characters, F.lit(0).cast("long")).alias("article_characters"), "history_characters", "checkpoint_characters", "history", "evidence",
    )
