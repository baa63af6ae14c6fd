"""Exact ranked search of all documents for each query item, with integer scores.

A document's terms are the runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. The
texts are read once: each document becomes one stored row with its number of terms and its distinct terms with their
counts, so a count needs no shuffle. Postings are that table opened, a row a term of a document with the term's bucket;
they are joined with the items' terms on (bucket, term), each match is scored in 64-bit integers, scores are summed by
(item, document), and row_number() keeps an item's best.

The stored rows are dealt out by document before they are opened. As long as the items' weighted terms are small (at most SMALL_BYTES,
which is counted, not guessed) they go to every task, so a document's postings stay together: its sums
are made where it lies, and only the best of each task are shuffled for an item's final order. Where the items' terms are many, both
sides are dealt out by (bucket, term), and Spark splits the part of a frequent term; the sums then take a shuffle.
A small set of wanted terms also goes to the readers, so that terms no item has are never stored. No posting, document
or term is passed over; a document without a shared term has no row.

Defined results: a null text has no terms; a repeated row is a document of its own, with its own rank; of equal scores the
smaller key comes first, a null key last; item rows of the same id are one item with all their terms; an item without terms that any
document has isn't in the result; empty tables give an empty result. Other columns aren't read. Sums fit 64 bits
up to 10^10 documents of 10^7 terms.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import ascii_lower, discard, documents_of, sliced, stored, tidy

#: Characters of terms: ASCII letters and digits, and all beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same for bytes of UTF-8: what separates terms becomes a space, and A-Z become a-z.
_READ = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes(range(256)).lower())
BUCKETS = 256
#: Item terms that take more bytes than this are joined by a shuffle.
SMALL_BYTES = 8 << 20
TOP = 10


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """_item and _term: the distinct terms of every item."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.lit(f"({TERM})"), 1)
    return items.select(F.col(f"`{item}`").alias("_item"), F.explode(words).alias("_term")).distinct()


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _bytes(terms: DataFrame) -> int:
    return terms.agg(F.coalesce(F.sum(F.octet_length("_term") + 64), F.lit(0))).first()[0]


def read_terms(docs: DataFrame, wanted: frozenset[str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_row, _key, _n (terms with repeats), _terms (distinct ones, of those wanted) and _tf (their counts), one row a document."""
    source = documents_of(docs, key, text).select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_t"))
    kind = source.schema["_key"].dataType.simpleString()
    shared = None if wanted is None else source.sparkSession.sparkContext.broadcast(frozenset(w.encode() for w in wanted))

    def counted(part: pa.RecordBatch) -> pa.RecordBatch:
        known = None if shared is None else shared.value
        sizes, ends, terms, tf = [], [0], [], []
        for raw in part.column(2).cast(pa.binary()).to_pylist():
            words = (raw or b"").translate(_READ).split()
            sizes.append(len(words))
            held: dict[bytes, int] = {}
            for w in words if known is None else filter(known.__contains__, words):
                held[w] = held.get(w, 0) + 1
            terms += held
            tf += held.values()
            ends.append(len(terms))
        at = pa.array(ends, pa.int32())
        columns = [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(at, pa.array(tf, pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["_row", "_key", "_n", "_terms", "_tf"])

    def run(parts):
        yield from tidy(counted(piece) for piece in sliced(parts, 256))

    return source.mapInArrow(run, f"_row long, _key {kind}, _n long, _terms array<string>, _tf array<long>")


def postings(read: DataFrame) -> DataFrame:
    """_bucket, _term, _row, _key, _n, _tf: a row for every term of a document."""
    opened = read.select("_row", "_key", "_n", F.explode(F.arrays_zip("_terms", "_tf")).alias("_p"))
    return opened.select(bucket(F.col("_p._terms")).alias("_bucket"), F.col("_p._terms").alias("_term"), "_row", "_key", "_n", F.col("_p._tf").alias("_tf"))


def weights(held: DataFrame, asked: DataFrame, documents: int) -> DataFrame:
    """_item, _bucket, _term, _w of the items' terms that documents have; rarer terms weigh more."""
    found = held.groupBy("_term").agg(F.count("*").alias("_df"))
    ratio = (F.lit(2 * documents + 2).cast("double")) / (2 * F.col("_df") + 1).cast("double")
    return asked.join(found, "_term").select("_item", bucket(F.col("_term")).alias("_bucket"), "_term", F.floor(1000 * F.ln(ratio)).cast("long").alias("_w"))


def search(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", small: int = SMALL_BYTES) -> DataFrame:
    """item, rank, key, score: the best documents of each item whose score is above 0."""
    asked = stored(item_terms(items, item, item_text), "item-terms")
    distinct = asked.select("_term").distinct()
    few = _bytes(distinct) <= small
    wanted = frozenset(r["_term"] for r in distinct.collect()) if few else None
    read = stored(read_terms(docs, wanted, key, text), "terms-read")
    documents, length = read.agg(F.count_if(F.col("_n") > 0), F.coalesce(F.sum("_n"), F.lit(0))).first()
    weighed = stored(weights(postings(read), asked, documents), "term-weights")
    discard(asked)
    given = F.broadcast(weighed) if _bytes(weighed) <= small else weighed
    # Dealt by document, a sum over one document needs no further shuffle
    rows = postings(read.filter(F.size("_terms") > 0).repartition("_row"))
    norm = 10 + F.expr(f"(90L * _n * {documents}L) div {max(1, length)}L")
    impact = F.expr("(1000000000L * _tf) div (1000L * _tf + 8L * _m)")
    scored = rows.withColumn("_m", norm).join(given, ["_bucket", "_term"]).groupBy("_item", "_row", "_key").agg(F.sum(F.col("_w") * impact).alias("score")).filter("score > 0")
    best = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("_key"), "_row")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select(F.col("_item").alias(item), "rank", F.col("_key").alias(key), "score")
