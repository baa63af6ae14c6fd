"""Page contexts and the archive of conversations as tables: reads, upserts and deletions as batch transformations.

A context is a row by (tab_id, url); an archived conversation is a row by normalized_url. Nothing is changed in place:
every operation takes the table and gives the new one, for the caller to write. Rows that aren't valid are as if they
weren't there. Times are columns of milliseconds given by the caller, so that results can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.urls import hostname, let, normalize_page_url
from lectern.operators.memory import QUOTA_WARNING, merge_turns

REFERENCE = "struct<type: string, text: string, section: string, alt: string, image_url: string>"
MESSAGE = f"struct<id: string, role: string, content: string, created_at: bigint, error: boolean, reference: {REFERENCE}, trace: string>"
CONTEXT = f"tab_id long, url string, normalized_url string, title string, status string, is_partial boolean, focus {REFERENCE}, messages array<{MESSAGE}>, checkpoint string, updated_at long"
CONVERSATION = f"normalized_url string, schema_version int, title string, messages array<{MESSAGE}>, created_at long, updated_at long"
SCHEMA_VERSION = 2


def is_context() -> Column:
    return F.col("tab_id").isNotNull() & F.col("url").isNotNull() & F.col("normalized_url").isNotNull() & F.col("messages").isNotNull()


def valid_messages(messages: Column) -> Column:
    """The messages that have an id, a known role, a text and a time."""
    return F.filter(messages, lambda m: m["id"].isNotNull() & m["role"].isin("user", "assistant") & m["content"].isNotNull() & m["created_at"].isNotNull())


def _failed(message: Column) -> Column:
    return F.coalesce(message["error"], F.lit(False))


def _asks(one: Column, next_: Column) -> Column:
    """Whether two neighbouring messages are a question and its answer, neither in error."""
    return F.coalesce((one["role"] == "user") & (next_["role"] == "assistant") & ~_failed(one) & ~_failed(next_), F.lit(False))


def archive_message(message: Column) -> Column:
    """A message without its trace, and without the address of an image it refers to."""
    reference = F.when(message["reference"]["type"] == "text", message["reference"]).otherwise(message["reference"].withField("image_url", F.lit(None).cast("string")))
    return message.withField("trace", F.lit(None).cast("string")).withField("reference", F.when(message["reference"].isNotNull(), reference))


def archived_messages(messages: Column) -> Column:
    """Questions with the answers right behind them, as the archive keeps them."""
    return F.transform(let(messages, lambda all_: F.filter(all_, lambda m, k: _asks(m, F.get(all_, k + 1)) | ((k > 0) & _asks(F.get(all_, k - 1), m)))), archive_message)


# --- contexts ----------------------------------------------------------------------------------------------------


def contexts_of(contexts: DataFrame, tab: int | None = None, url: str | None = None, page: str | None = None) -> DataFrame:
    """The valid contexts: all, of a tab, of a tab and an address, or of all addresses with the normal form of page."""
    out = contexts.filter(is_context())
    if tab is not None:
        out = out.filter(F.col("tab_id") == tab)
    if url is not None:
        out = out.filter(F.col("url") == url)
    return out if page is None else out.filter(F.col("normalized_url") == normalize_page_url(F.lit(page)))


def save_contexts(contexts: DataFrame, incoming: DataFrame) -> DataFrame:
    """Whole rows of incoming take the place of those of the same key; of several the one updated last."""
    every = contexts.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    last = Window.partitionBy("tab_id", "url").orderBy(F.desc("_new"), F.desc("updated_at"))
    return every.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_new")


def update_contexts(contexts: DataFrame, where: Column, now: Column, **changes: Column) -> DataFrame:
    """Contexts for which `where` holds get the changed columns and the time; the others stay, and none is made."""
    hit = F.coalesce(where & is_context(), F.lit(False))
    changed = {**changes, "updated_at": now.cast("long")}
    return contexts.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changed.items()})


def replace_messages(contexts: DataFrame, page: str, messages: Column, now: Column) -> DataFrame:
    """All contexts of a page get these messages and lose their checkpoint."""
    return update_contexts(contexts, F.col("normalized_url") == normalize_page_url(F.lit(page)), now, messages=messages, checkpoint=F.lit(None).cast("string"))


def clear_messages(contexts: DataFrame, now: Column) -> DataFrame:
    return update_contexts(contexts, F.size("messages") > 0, now, messages=F.filter("messages", lambda m: F.lit(False)), checkpoint=F.lit(None).cast("string"))


def delete_contexts(contexts: DataFrame, tab: int, url: str | None = None) -> DataFrame:
    """Without a tab's contexts, or without the one of an address in it."""
    gone = (F.col("tab_id") == tab) & (F.lit(True) if url is None else F.col("url") == url)
    return contexts.filter(~F.coalesce(gone, F.lit(False)))


def can_ask() -> Column:
    """Whether a page's article is there to be asked about."""
    return F.coalesce(F.col("status").isin("ready", "partial"), F.lit(False))


def tabs_of_pages(contexts: DataFrame, pages: DataFrame) -> DataFrame:
    """The contexts whose page is among the normalised addresses of pages."""
    return contexts.join(pages.select("normalized_url").distinct(), "normalized_url", "left_semi")


# --- the archive -------------------------------------------------------------------------------------------------


def conversations(archive: DataFrame) -> DataFrame:
    """CONVERSATION rows read from any version: addresses normalised anew, messages that aren't part of a completed turn dropped,
    a missing title is the host, missing times are those of the first and the last message. Rows without an address or a turn go."""
    given = archive.select(normalize_page_url(F.col("normalized_url")).alias("normalized_url"), "title", archived_messages(valid_messages(F.col("messages"))).alias("messages"), "created_at", "updated_at")
    held = given.filter(F.col("normalized_url").isNotNull() & (F.size("messages") > 0))
    named = F.when(F.trim(F.coalesce("title", F.lit(""))) != "", F.col("title")).otherwise(hostname(F.col("normalized_url")))
    return held.select(
        "normalized_url", F.lit(SCHEMA_VERSION).alias("schema_version"), named.alias("title"), "messages",
        F.coalesce("created_at", F.col("messages")[0]["created_at"]).alias("created_at"), F.coalesce("updated_at", F.try_element_at("messages", F.lit(-1))["created_at"]).alias("updated_at"),
    )


def turns_of(conversations_: DataFrame) -> DataFrame:
    """url, question_id, pos, created_at, question, answer (whole messages) of archived conversations."""
    opened = conversations_.select(F.col("normalized_url").alias("url"), "messages", F.posexplode("messages").alias("pos", "question"))
    asked = opened.filter(F.col("question.role") == "user").withColumn("answer", F.get("messages", F.col("pos") + 1))
    return asked.select("url", F.col("question.id").alias("question_id"), F.col("pos").cast("long").alias("pos"), F.col("question.created_at").alias("created_at"), "question", "answer")


def save_conversations(archive: DataFrame, contexts: DataFrame, now: Column) -> DataFrame:
    """The archive with the completed turns of contexts merged in: of one question the incoming text counts, at its first place.

    created_at stays, updated_at is now where something came in, and pages without a completed turn leave it as it is.
    """
    held = conversations(archive)
    rank = Window.partitionBy("normalized_url").orderBy(F.desc("updated_at"), "tab_id")
    incoming = contexts.filter(is_context()).select("*", archived_messages(valid_messages(F.col("messages"))).alias("_kept")).drop("messages").filter(F.size("_kept") > 0).withColumnRenamed("_kept", "messages")
    titles = incoming.withColumn("_n", F.row_number().over(rank)).filter("_n = 1").select("normalized_url", F.col("title").alias("_title"))
    merged = merge_turns(turns_of(held), turns_of(incoming)).groupBy(F.col("url").alias("normalized_url")).agg(F.array_sort(F.collect_list(F.struct("ord", "question", "answer"))).alias("_turns"))
    pairs = F.flatten(F.transform("_turns", lambda t: F.array(t["question"], t["answer"])))
    old = held.select("normalized_url", "title", "created_at", "updated_at")
    every = merged.join(old, "normalized_url", "left").join(titles, "normalized_url", "left").withColumn("messages", pairs)
    new = F.col("_title").isNotNull()
    return every.select(
        "normalized_url", F.lit(SCHEMA_VERSION).alias("schema_version"), F.coalesce("_title", "title").alias("title"), "messages",
        F.coalesce("created_at", F.col("messages")[0]["created_at"]).alias("created_at"), F.when(new, now.cast("long")).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def conversation_of(archive: DataFrame, page: str) -> DataFrame:
    """The conversation of a page, one row or none; its messages are what is loaded."""
    return conversations(archive).filter(F.col("normalized_url") == normalize_page_url(F.lit(page)))


def hydrated(contexts: DataFrame, archive: DataFrame) -> DataFrame:
    """Contexts without messages get those of their page's conversation."""
    known = conversations(archive).select("normalized_url", F.col("messages").alias("_archived"))
    empty = (F.size("messages") == 0) & F.col("_archived").isNotNull()
    return contexts.join(known, "normalized_url", "left").withColumn("messages", F.when(empty, F.col("_archived")).otherwise(F.col("messages"))).select(*contexts.columns)


def summaries(archive: DataFrame, query: str = "") -> DataFrame:
    """normalized_url, title, created_at, updated_at, question_count, last_question of the conversations whose title, address or
    messages hold the query, without regard to case (all for an empty query), those updated last first."""
    asked = F.filter("messages", lambda m: m["role"] == "user")
    text = F.lower(F.concat_ws("\n", F.concat(F.array("title", "normalized_url"), F.transform("messages", lambda m: m["content"]))))
    found = conversations(archive).filter(F.contains(text, F.lit(query.strip().lower())))
    return found.select("normalized_url", "title", "created_at", "updated_at", F.size(asked).cast("long").alias("question_count"), F.coalesce(F.try_element_at(asked, F.lit(-1))["content"], F.lit("")).alias("last_question")).orderBy(F.desc("updated_at"), "normalized_url")


def delete_conversations(archive: DataFrame, pages: list[str] | None = None) -> DataFrame:
    """Without the conversations of these pages; without any pages named, an empty archive."""
    if pages is None:
        return archive.limit(0)
    gone = F.array(*(normalize_page_url(F.lit(p)) for p in pages)) if pages else F.array().cast("array<string>")
    return archive.filter(~F.coalesce(F.array_contains(gone, normalize_page_url(F.col("normalized_url"))), F.lit(False)))


def bytes_in_use(archive: DataFrame) -> Column:
    """The bytes of a table's rows written as JSON, to be aggregated."""
    return F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*archive.columns)))), F.lit(0)).cast("long")


def usage(archive: DataFrame, quota: int, warning: float = QUOTA_WARNING) -> DataFrame:
    """bytes_in_use, quota_bytes, share, near_limit of an archive's records: one row. Near its limit is an archive that has the warning's share of the quota."""
    used = archive.agg(bytes_in_use(archive).alias("bytes_in_use"))
    share = F.col("bytes_in_use") / F.lit(max(1, quota))
    return used.select("bytes_in_use", F.lit(quota).cast("long").alias("quota_bytes"), F.round(share, 6).alias("share"), (share >= warning).alias("near_limit"))
