"""Exact dedup by distributed most-significant-digit radix partitioning of the texts' bytes.

Texts are lower-cased in A-Z only. Round k splits every group that is left by its next digit, a run of bytes that is
eight times as wide as the last one, so that a text of n bytes takes about log8(n / 64) rounds. A group is done when
it holds one row, or when its texts have ended; the members of an ended group are equal byte for byte, and no digest
decides. A round is one aggregation (group, digit) -> (size, least row, largest key), combined before the shuffle, and
one join that hands the new groups to the rows; a hot group is one key of that join, whose partition AQE may split, and is
never gathered. Rows that are alone leave before the join of the next round, so after the first round only the text of
possible copies moves.

Defined results: a null text counts as empty; a null key is less than any other; of rows with the largest key of a
group the first read stays; a repeated row is a copy of its first occurrence; an empty table gives an empty result.
Rows are told apart by their place in the input, which must be a table read from files; other inputs are written to the
shared folder first (table=False).
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import discard, documents_of, fresh, stored

#: Bytes of the first digit, and how much wider each next one is.
FIRST_DIGIT, WIDENING = 64, 8


def normalised(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_row, _key, _body: the rows of docs, numbered in the order of the stored table, with A-Z lower-cased."""
    source = documents_of(docs, key, text).select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_body"))

    def run(parts):
        for part in parts:
            body = pc.fill_null(pc.ascii_lower(part.column(2)), "")
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), body], names=["_row", "_key", "_body"])

    return source.mapInArrow(run, source.schema)


def _digit(start: int, width: int):
    return F.substring(F.col("_body").cast("binary"), start + 1, width)


def copies(rows: DataFrame, first: int = FIRST_DIGIT, widening: int = WIDENING) -> DataFrame:
    """_row, _group (its least row), _keep (largest key), _size of every row that has an equal."""
    start, width = 0, first
    left, done = rows.withColumn("_group", F.lit(0).cast("long")), []
    kept = None
    while True:
        held = left.withColumn("_digit", _digit(start, width))
        # Stored, so that the join deals rows out on its own and a hot group's partition can be split
        groups = stored(held.groupBy("_group", "_digit").agg(F.count("*").alias("_size"), F.min("_row").alias("_next"), F.max("_key").alias("_keep")).filter("_size > 1"), "radix-groups")
        step = stored(
            held.join(groups.hint("merge"), ["_group", "_digit"]).select("_row", "_key", F.col("_next").alias("_group"), "_keep", "_size", (F.octet_length("_digit") < width).alias("_ended"), F.when(F.octet_length("_digit") == width, F.col("_body")).alias("_body")),
            "radix",
        )
        discard(groups)
        discard(kept)
        done.append(step.filter("_ended").select("_row", "_key", "_group", "_keep", "_size"))
        left, kept = step.filter("not _ended").select("_row", "_key", "_body", "_group"), None
        if left.isEmpty():
            break
        start, width = start + width, width * widening
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", table: bool = False, first: int = FIRST_DIGIT, widening: int = WIDENING) -> DataFrame:
    """One row for each row of docs: key, keep_id, group_size, kept, text_sha256 (of the normalised text), _row. table: docs is read from files as it is."""
    docs = docs if table else stored(documents_of(docs, key, text), "radix-input")
    rows = normalised(docs, key, text)
    equal = copies(rows, first, widening)
    stays = equal.filter(F.col("_key").eqNullSafe(F.col("_keep"))).groupBy("_group").agg(F.min("_row").alias("_row")).select("_row", F.lit(True).alias("_stays"))
    marked = equal.select("_row", "_keep", "_size").join(stays, "_row", "left")
    every = rows.select("_row", "_key", F.sha2(F.col("_body").cast("binary"), 256).alias("text_sha256"))
    return every.join(marked, "_row", "left").select(
        F.col("_key").alias(key),
        F.when(F.col("_size").isNull(), F.col("_key")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_size").isNull() | F.col("_stays").isNotNull()).alias("kept"),
        "text_sha256",
        "_row",
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", table: bool = False) -> DataFrame:
    """docs without the rows that exact_dedup() doesn't keep; all columns stay."""
    docs = docs if table else stored(docs, "radix-input")
    row = fresh("_lost", docs)
    lost = exact_dedup(docs, key, text, table=True).filter("not kept").select(F.col("_row").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(lost, row, "left_anti").drop(row)
