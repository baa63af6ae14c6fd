"""Which chunks of an article answer a question: the choice between the ways to find them, as one plan.

Questions are rows of article_id, query_id, question, search_queries (array), focus_text, focus_section, focus_scope and
heading_level. A whole-article question takes the article as far as it fits. Others take, in this order, the section in focus,
the neighbourhood of the text in focus, or windows around what search finds; a question goes to the next way if one gives nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import chunk_cost, is_whole_article_question, token_set
from lectern.operators import assemble, search
from lectern.operators import evidence as E
from lectern.sources.scratch import stored

QUESTION = "article_id long, query_id long, question string, search_queries array<string>, focus_text string, focus_section string, focus_scope string, heading_level int"
KEY = ["article_id", "query_id"]


def global_queries(question: Column, focus_text: Column, plan: Column) -> Column:
    """The question with what is in focus, the rewritten question and the planned queries, as far as there are any."""
    every = F.concat(F.array(question, focus_text, plan["rewritten_question"]), F.coalesce(plan["queries"], F.array().cast("array<string>")))
    return F.filter(every, lambda q: q.isNotNull() & (q != ""))


def _costed(chunks: DataFrame, rows: DataFrame, branch: str) -> DataFrame:
    """Rows of KEY, chunk_idx and rank, with the chunks' ids and costs."""
    facts = chunks.select("article_id", "chunk_idx", "chunk_id", chunk_cost(F.col("section"), F.col("text")).alias("cost"))
    return rows.join(facts, ["article_id", "chunk_idx"]).select(*KEY, F.lit(branch).alias("branch"), F.col("rank").cast("int"), "chunk_id", F.col("cost").cast("int"))


def relevant_chunks(chunks: DataFrame, questions: DataFrame, limit: int = E.WINDOWS, budget: int = search.RELEVANT_BUDGET, tokenizer: search.Tokenizer = search.retrieval_terms) -> DataFrame:
    """KEY, branch (section, anchor, search), rank, chunk_id, cost. What a way gives is stored, as the next one takes the questions it leaves."""
    from pyspark.sql import Window

    asked = questions.filter((F.col("focus_scope") == "section") & (F.trim(F.coalesce("focus_section", F.lit(""))) != ""))
    section = stored(search.section_scope(chunks, asked.select(*KEY, "focus_section", "heading_level"), limit, budget).withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy("chunk_idx"))), "section-scope")
    left = questions.join(section.select(*KEY).distinct(), KEY, "left_anti")
    pointed = left.filter((F.size(token_set(F.col("focus_text"))) > 0) | (F.size(token_set(F.col("focus_section"))) > 0))
    anchor = stored(search.focus_anchors(chunks, pointed, min(limit, search.ANCHORS)).withColumnRenamed("place", "rank"), "focus-anchors")
    left = stored(left.join(anchor.select(*KEY).distinct(), KEY, "left_anti").select(*KEY, "question", "search_queries"), "searched").hint("merge")
    queries = left.select(*KEY, F.posexplode(F.concat(F.array("question"), F.coalesce("search_queries", F.array().cast("array<string>")))).alias("pos", "text"))
    ranked = stored(search.fuse(search.bm25(chunks, search.distinct_queries(queries), tokenizer=tokenizer)), "ranked")
    found = assemble.packed_windows(chunks, ranked, budget, limit).select(*KEY, F.lit("search").alias("branch"), "rank", "chunk_id", "cost")
    return _costed(chunks, section, "section").unionByName(_costed(chunks, anchor, "anchor")).unionByName(found)


def article_context(chunks: DataFrame, questions: DataFrame, limit: int = E.WINDOWS, budget: int = search.RELEVANT_BUDGET, whole_budget: int = E.WHOLE_BUDGET) -> DataFrame:
    """KEY, mode (whole, relevant), truncated, branch, rank, chunk_id, cost."""
    from pyspark.sql import Window

    whole = is_whole_article_question(F.col("question"))
    questions = stored(questions, "questions").hint("merge")  # many times its file's size, by which Spark would send it to every task
    asked = questions.filter(whole).select(*KEY)
    own = chunks.join(asked.select("article_id").distinct(), "article_id", "left_semi")
    taken = stored(assemble.covered(own, whole_budget, None), "covered")
    cut = own.groupBy("article_id").agg(F.count("*").alias("_all")).join(taken.groupBy("article_id").agg(F.count("*").alias("_taken")), "article_id", "left").select("article_id", (F.coalesce("_taken", F.lit(0)) < F.col("_all")).alias("truncated"))
    spread = asked.join(taken, "article_id").withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy("chunk_idx")))
    all_ = _costed(chunks, spread, "whole").join(cut, "article_id").withColumn("mode", F.lit("whole"))
    some = relevant_chunks(chunks, questions.filter(~whole), limit, budget).withColumn("mode", F.lit("relevant")).withColumn("truncated", F.lit(False))
    return all_.unionByName(some).select(*KEY, "mode", "truncated", "branch", "rank", "chunk_id", "cost")


def budgets(chunks: DataFrame, questions: DataFrame, limit: int = assemble.REQUEST_BUDGET) -> DataFrame:
    """What a request's budget goes to: KEY, limit, full_article_characters, checkpoint_characters, available, history_limit,
    history_characters, article_budget, strategy, mode, is_truncated, needs_planning.

    questions: KEY, history_length (of the history on hand), use_conversation, planned (whether planning is done), checkpoint_json (compact).
    """
    sizes = chunks.groupBy("article_id").agg(F.sum(chunk_cost(F.col("section"), F.col("text"))).cast("long").alias("full_article_characters"))
    most = F.lit(max(1, limit)).cast("long")
    checkpoint = F.coalesce(F.length("checkpoint_json"), F.lit(0)).cast("long")
    held = questions.join(sizes, "article_id").select(*KEY, most.alias("limit"), "full_article_characters", checkpoint.alias("checkpoint_characters"), F.greatest(F.lit(1), most - checkpoint).alias("available"), F.coalesce("history_length", F.lit(0)).cast("long").alias("_history"), F.coalesce("use_conversation", F.lit(False)).alias("_use"), F.coalesce("planned", F.lit(False)).alias("_planned"))
    fits = F.col("full_article_characters") <= F.col("available")
    share = F.when(F.col("_use"), assemble.PLANNED_HISTORY_BUDGET).otherwise(assemble.HISTORY_BUDGET)
    room = F.when(fits, F.col("available") - F.col("full_article_characters")).otherwise(F.least(share, F.col("available")))
    held = held.withColumn("history_limit", room.cast("long")).withColumn("history_characters", F.least("_history", "history_limit"))
    article = F.when(fits, F.col("full_article_characters")).otherwise(F.greatest(F.lit(1), F.col("available") - F.col("history_characters")))
    return held.select(
        *KEY, "limit", "full_article_characters", "checkpoint_characters", "available", "history_limit", "history_characters", article.cast("long").alias("article_budget"),
        F.when(fits, "full-context").otherwise("fused-retrieval").alias("strategy"), F.when(fits, "whole").otherwise("relevant").alias("mode"), (~fits).alias("is_truncated"), (~fits & ~F.col("_planned")).alias("needs_planning"),
    )
