"""The engine's entities read from stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import SOLID, clean
from lectern.sources.scratch import stored


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def document_blocks(documents: DataFrame) -> DataFrame:
    """article_id, block_id, type, text, section, ord: a paragraph block for each line that isn't blank, numbered without gaps; lang > source is the section."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(SOLID))
    held = documents.select(F.col("doc_id").alias("article_id"), F.concat_ws(" > ", "lang", "source").alias("section"), F.posexplode(lines).alias("ord", "text"))
    return held.select("article_id", F.concat(F.lit("block-"), F.col("ord") + 1).alias("block_id"), F.lit("paragraph").alias("type"), "text", "section", "ord")


def sectioned_lines(documents: DataFrame, size: int = 5) -> DataFrame:
    """article_id, chunk_idx, chunk_id, section, text, block_ids: a document's lines as chunks, `size` of them a part below lang > source."""
    part = F.concat(F.col("section"), F.lit(" > part "), F.floor(F.col("ord") / size).cast("string"))
    return document_blocks(documents).select("article_id", F.col("ord").alias("chunk_idx"), F.concat(F.lit("chunk-"), F.col("ord") + 1).alias("chunk_id"), part.alias("section"), "text", F.array("block_id").alias("block_ids"))


def document_chunks(documents: DataFrame) -> DataFrame:
    """article_id, chunk_idx, section, text: the sources as articles, their documents as chunks in order of id."""
    return documents.select(F.col("source").alias("article_id"), F.col("doc_id").alias("chunk_idx"), F.col("lang").alias("section"), F.coalesce("text", F.lit("")).alias("text"))


def messages(conversations: DataFrame) -> DataFrame:
    """conv_id, msg_idx, role, content, created_at, error of the rows of users and assistants."""
    return conversations.filter(F.col("role").isin("user", "assistant")).select("conv_id", F.col("turn").alias("msg_idx"), "role", F.coalesce("text", F.lit("")).alias("content"), F.col("turn").cast("long").alias("created_at"), F.lit(False).alias("error"))


def questions(benchmark: DataFrame) -> DataFrame:
    """query_id, question: every benchmark text, in one line."""
    return benchmark.select(F.col("item_id").alias("query_id"), clean(F.col("text")).alias("question"))


def numbered(df: DataFrame, by: str, name: str, parts: int = 16) -> DataFrame:
    """df with its rows numbered from 0 without gaps in the order of a column: places in sorted parts, added to the counts of the parts before."""
    at = F.col("_at")
    placed = stored(df.repartitionByRange(parts, by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright(at, 33))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # as many rows as parts
    counts = placed.groupBy("_part").agg(F.count("*").alias("_rows")).select("_part", before.alias("_before"))
    return placed.join(counts, "_part").select(*df.columns, (F.col("_before") + at - F.shiftleft(F.col("_part"), 33)).alias(name))


def asked_of(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """article_id, query_id, question: every document is asked one question; documents take them in turn, so that all are asked."""
    asked = numbered(questions(benchmark), "query_id", "_turn")
    count = asked.count()
    turn = documents.select(F.col("doc_id").alias("article_id")).select("article_id", F.pmod("article_id", F.lit(max(1, count))).alias("_turn"))
    return turn.join(asked, "_turn").select("article_id", "query_id", "question")


def page_contexts(conversations: DataFrame, per_page: int = 2) -> DataFrame:
    """Contexts (see operators.store) of conversations: tab conv_id, some conversations a page, times are turns."""
    from lectern.operators.store import MESSAGE, REFERENCE

    one = F.struct(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("msg_idx").cast("string")).alias("id"), "role", "content", "created_at", F.lit(None).cast("boolean").alias("error"), F.lit(None).cast(REFERENCE).alias("reference"), F.lit(None).cast("string").alias("trace"),
    )
    held = messages(conversations).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("msg_idx", one.alias("m")))).alias("m"), F.max("created_at").alias("updated_at"))
    page = F.concat(F.lit("https://example.com/p/"), F.floor(F.col("conv_id") / per_page).cast("string"))
    return held.select(
        F.col("conv_id").alias("tab_id"), F.concat(page, F.lit("/?utm_source=tab")).alias("url"), page.alias("normalized_url"), F.concat(F.lit("Page "), F.col("conv_id").cast("string")).alias("title"), F.lit("ready").alias("status"), F.lit(False).alias("is_partial"),
        F.lit(None).cast(REFERENCE).alias("focus"), F.transform("m", lambda x: x["m"]).cast(f"array<{MESSAGE}>").alias("messages"), F.lit(None).cast("string").alias("checkpoint"), "updated_at",
    )
