"""Conversation turns and which of them fit a history budget; the archive of conversations by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.reading import reference_text
from lectern.functions.text import clean, overlap_score, token_set

HISTORY_BUDGET, RECENT_BUDGET, RECENT_TURNS, RECALLED_TURNS, TRACES = 48_000, 24_000, 6, 6, 10
QUOTA_BYTES, QUOTA_WARNING = 10 * 1024 * 1024, 0.8


def completed_turns(messages: DataFrame) -> DataFrame:
    """conv_id, turn_idx (the question's place), question, answer, turn_length, and reference if messages have it: questions with an answer right behind, neither in error."""
    more = ["reference"] if "reference" in messages.columns else []
    order = Window.partitionBy("conv_id").orderBy("msg_idx")
    ahead = messages.select("conv_id", "msg_idx", "role", "content", *more, F.coalesce("error", F.lit(False)).alias("_error"), F.lead("role").over(order).alias("_role"), F.lead("content").over(order).alias("answer"), F.coalesce(F.lead("error").over(order), F.lit(False)).alias("_wrong"), (F.row_number().over(order) - 1).alias("turn_idx"))
    done = ahead.filter("role = 'user' and _role = 'assistant' and not _error and not _wrong")
    return done.select("conv_id", "turn_idx", F.col("content").alias("question"), "answer", (F.length("content") + F.length("answer")).alias("turn_length"), *more)


def recent_turns(turns: DataFrame, budget: int = RECENT_BUDGET, most: int = RECENT_TURNS) -> DataFrame:
    """The newest turns of each conversation, as many as fit; the first that doesn't fit ends them. Adds newest (1: the last turn)."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn_idx"))
    used = F.sum("turn_length").over(back.rowsBetween(Window.unboundedPreceding, 0))
    return turns.withColumn("newest", F.row_number().over(back)).withColumn("used", used).filter((F.col("newest") <= most) & (F.col("used") <= budget))


def recalled_turns(turns: DataFrame, questions: DataFrame, skip: int = RECENT_TURNS, most: int = RECALLED_TURNS) -> DataFrame:
    """Older turns by their overlap with a question (conv_id, question, and focus_text if there is any): conv_id, turn_idx, turn_length, score, place.

    What a turn's question refers to counts as its text.
    """
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn_idx"))
    older = turns.withColumn("_newest", F.row_number().over(back)).filter(F.col("_newest") > skip)
    focus = ["focus_text"] if "focus_text" in questions.columns else []
    asked = questions.select("conv_id", token_set(F.concat_ws("\n", "question", *focus)).alias("_asked"))
    told = [reference_text(F.col("reference"))] if "reference" in turns.columns else []
    scored = older.join(asked, "conv_id").withColumn("score", overlap_score(F.col("_asked"), token_set(F.concat_ws("\n", "question", "answer", *told)))).filter("score > 0")
    order = Window.partitionBy("conv_id").orderBy(F.desc("score"), F.desc("turn_idx"))
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("conv_id", "turn_idx", "turn_length", "score", "place")


def fitting(entries: Column, budget: Column) -> Column:
    """Of an array of structs in order (with n, a length), those that fit what the ones before have left; others are passed over."""
    start = F.struct(budget.cast("long").alias("left"), F.filter(entries, lambda e: F.lit(False)).alias("kept"))
    step = lambda s, e: F.when(e["n"] <= s["left"], F.struct((s["left"] - e["n"]).alias("left"), F.concat(s["kept"], F.array(e)).alias("kept"))).otherwise(s)
    return F.aggregate(entries, start, step, lambda s: s["kept"])


def select_memory(turns: DataFrame, questions: DataFrame, budget: int = HISTORY_BUDGET, recent_budget: int = RECENT_BUDGET, recent: int = RECENT_TURNS, recalled: int = RECALLED_TURNS) -> DataFrame:
    """conv_id, turn_idx, how (all, recent, recalled, omitted), compacted: what becomes of each turn under the budget.

    compacted: the turn lies before the first recent one.
    """
    total = turns.groupBy("conv_id").agg(F.sum("turn_length").alias("_total"))
    kept = recent_turns(turns, min(budget, recent_budget), recent).select("conv_id", "turn_idx", F.lit("recent").alias("_how"), "turn_length")
    spent = kept.groupBy("conv_id").agg(F.sum("turn_length").alias("_spent"), F.min("turn_idx").alias("_first"))
    offers = recalled_turns(turns, questions, recent, recalled).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "turn_idx", F.col("turn_length").cast("long").alias("n")))).alias("_offers"))
    chosen = offers.join(spent, "conv_id", "left").select("conv_id", F.explode(fitting(F.col("_offers"), F.lit(budget) - F.coalesce("_spent", F.lit(0)))).alias("e")).select("conv_id", F.col("e.turn_idx").alias("turn_idx"), F.lit("recalled").alias("_how"))
    marks = kept.drop("turn_length").unionByName(chosen)
    every = turns.select("conv_id", "turn_idx").join(total, "conv_id").join(marks, ["conv_id", "turn_idx"], "left").join(spent.select("conv_id", "_first"), "conv_id", "left")
    fits = F.col("_total") <= budget
    if budget <= 0:
        fits = F.lit(False)
    how = F.when(fits, "all").otherwise(F.coalesce("_how", F.lit("omitted")) if budget > 0 else F.lit("omitted"))
    before = ~fits & (F.col("_first").isNull() | (F.col("turn_idx") < F.col("_first"))) if budget > 0 else F.lit(True)
    return every.select("conv_id", "turn_idx", how.alias("how"), before.alias("compacted"))


def history_for(turns: DataFrame, asked: DataFrame, key: list[str], recent: int = RECENT_TURNS, recalled: int = RECALLED_TURNS) -> DataFrame:
    """key, turn_idx, turn_length, how (all, recent, recalled): the turns that go with each question, each under a budget of its own.

    asked: key, conv_id, question, focus_text, budget, recent_budget. All turns go if they fit; else the newest ones up to the first that
    doesn't fit the recent budget, and of those before the last `recent` ones the most alike that fit what is left.
    """
    told = [reference_text(F.col("_reference"))] if "reference" in turns.columns else []
    own = turns.select("conv_id", "turn_idx", F.col("turn_length").cast("long").alias("turn_length"), F.col("question").alias("_question"), F.col("answer").alias("_answer"), *[F.col("reference").alias("_reference")] * len(told))
    back = Window.partitionBy(*key).orderBy(F.desc("turn_idx"))
    tokens = asked.filter("budget > 0").select(*key, "conv_id", "budget", "recent_budget", token_set(F.concat_ws("\n", "question", "focus_text")).alias("_asked"))
    every = tokens.join(own, "conv_id").withColumn("_newest", F.row_number().over(back)).withColumn("_used", F.sum("turn_length").over(back.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_total", F.sum("turn_length").over(Window.partitionBy(*key)))
    fits = F.col("_total") <= F.col("budget")
    new = (F.col("_newest") <= recent) & (F.col("_used") <= F.least("budget", "recent_budget"))
    old = ~fits & (F.col("_newest") > recent)
    score = F.when(old, overlap_score(F.col("_asked"), token_set(F.concat_ws("\n", "_question", "_answer", *told)))).otherwise(0.0)
    marked = every.select(*key, "turn_idx", "turn_length", "budget", F.when(fits, "all").when(new, "recent").alias("how"), score.alias("_score"))
    spent = F.sum(F.when(F.col("how") == "recent", F.col("turn_length")).otherwise(0)).over(Window.partitionBy(*key))
    order = Window.partitionBy(*key).orderBy(F.desc("_score"), F.desc("turn_idx"))
    alike = marked.withColumn("_left", F.col("budget") - spent).filter("_score > 0").withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= recalled)
    offers = alike.groupBy(*key).agg(F.min("_left").alias("_left"), F.array_sort(F.collect_list(F.struct("_place", "turn_idx", F.col("turn_length").alias("n")))).alias("_offers"))
    chosen = offers.select(*key, F.explode(fitting(F.col("_offers"), F.col("_left"))).alias("e")).select(*key, F.col("e.turn_idx").alias("turn_idx"), F.col("e.n").alias("turn_length"), F.lit("recalled").alias("how"))
    return marked.filter("how is not null").select(*key, "turn_idx", "turn_length", "how").unionByName(chosen)


def selection_counts(selected: DataFrame) -> DataFrame:
    """conv_id, recent_turns, recalled_turns, omitted_turns, compacted_turns of select_memory()."""
    how = lambda *names: F.count_if(F.col("how").isin(*names))
    return selected.groupBy("conv_id").agg(how("all", "recent").alias("recent_turns"), how("recalled").alias("recalled_turns"), how("omitted").alias("omitted_turns"), F.count_if("compacted").alias("compacted_turns"))


def question_rail(messages: DataFrame, least: int = 3) -> DataFrame:
    """conv_id, msg_idx, question: the user's questions of conversations that have `least` of them."""
    asked = messages.filter("role = 'user' and not coalesce(error, false)").select("conv_id", "msg_idx", clean(F.col("content")).alias("question")).filter("question <> ''")
    return asked.withColumn("_n", F.count("*").over(Window.partitionBy("conv_id"))).filter(F.col("_n") >= least).drop("_n")


def kept_traces(messages: DataFrame, most: int = TRACES) -> DataFrame:
    """conv_id, msg_idx of the last questions, which keep their trace; none with most = 0."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("msg_idx"))
    return messages.filter("role = 'user'").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).select("conv_id", "msg_idx")


def merge_turns(archived: DataFrame, incoming: DataFrame) -> DataFrame:
    """Both: url, question_id, pos, created_at, question, answer. Of one question the incoming text counts, at the first place;
    adds ord, the order by time (then place)."""
    every = archived.withColumn("_from", F.lit(0)).unionByName(incoming.withColumn("_from", F.lit(1)))
    last = Window.partitionBy("url", "question_id").orderBy(F.desc("_from"), F.desc("pos"))
    place = Window.partitionBy("url", "question_id")
    one = every.withColumn("_at", F.min(F.struct("_from", "pos")).over(place)).withColumn("_n", F.row_number().over(last)).filter("_n = 1")
    order = Window.partitionBy("url").orderBy("created_at", "_at")
    return one.withColumn("ord", (F.row_number().over(order) - 1).cast("int")).select("url", "question_id", "ord", "created_at", "question", "answer")


def summaries(archive: DataFrame) -> DataFrame:
    """archive: url, title, msg_idx, role, content, created_at, one row a message -> one row a conversation."""
    return archive.groupBy("url", "title").agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"), F.count_if(F.col("role") == "user").alias("question_count"), F.max_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("msg_idx"))).alias("last_question"))


def search_archive(archive: DataFrame, query: str) -> DataFrame:
    """Summaries of the conversations whose title, URL or messages hold the query, without regard to case; all for an empty query."""
    wanted = query.strip().lower()
    found = summaries(archive)
    if not wanted:
        return found
    hit = F.contains(F.lower(F.concat_ws("\n", "title", "url")), F.lit(wanted)) | F.contains(F.lower("content"), F.lit(wanted))
    return found.join(archive.filter(hit).select("url").distinct(), "url", "left_semi")


def usage(archive: DataFrame, quota: int = QUOTA_BYTES) -> DataFrame:
    """bytes_in_use, quota_bytes, near_limit: one row."""
    used = archive.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("bytes_in_use"))
    return used.withColumn("quota_bytes", F.lit(quota).cast("long")).withColumn("near_limit", F.col("bytes_in_use") >= QUOTA_WARNING * quota)
