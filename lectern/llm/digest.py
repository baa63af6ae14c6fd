"""Document fingerprints: a quartile bucket digest of a text's bytes, and how alike two digests are.

Every window of three bytes is hashed to one of BUCKETS counters. The digest states, for each counter, in which
quartile of all the counters it lies (two bits), and before them the length on a logarithmic scale. Two digests are
compared by the sum of the quartile distances and of the capped distance of lengths, divided by the largest sum there
can be: likeness is 1 for equal digests and 0 at the far end.

Defined results: a null text counts as empty; texts under three bytes have all counters at nought; equal texts have
equal digests. Rows of equal keys are ordered by text for "the next document"; a null key comes first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import batches, documents_of

BUCKETS = 512
#: Steps of the length scale for each doubling, and the largest distance of lengths that counts.
LENGTH_STEPS, LENGTH_CAP = 4, 32
#: Bytes hashed at once: what a very long text needs of memory.
CHUNK = 1 << 20

_MIX = np.uint32(2654435761)


def bucket_counts(raw: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """How many of the windows of three bytes fall to each bucket."""
    counts = np.zeros(buckets, np.int64)
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    data = np.frombuffer(raw, np.uint8)
    for at in range(0, max(0, len(data) - 2), CHUNK):
        part = data[at : at + CHUNK + 2].astype(np.uint32)
        triple = part[:-2] | part[1:-1] << np.uint32(8) | part[2:] << np.uint32(16)
        counts += np.bincount((triple * _MIX) >> shift, minlength=buckets)
    return counts


def fingerprint(raw: bytes, buckets: int = BUCKETS) -> str:
    """Hexadecimal: two digits of length, then two bits a bucket, four buckets a byte."""
    counts = bucket_counts(raw, buckets)
    quarters = np.sort(counts)[[buckets // 4 - 1, buckets // 2 - 1, 3 * buckets // 4 - 1]]
    code = (counts[:, None] > quarters[None, :]).sum(axis=1).astype(np.uint8).reshape(-1, 4)
    packed = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    length = min(255, int(round(LENGTH_STEPS * np.log2(len(raw) + 1))))
    return f"{length:02x}" + packed.tobytes().hex()


#: Sum of the four quartile distances of two bytes of a digest.
_DISTANCE = np.abs(((np.arange(256)[:, None] >> np.arange(0, 8, 2)) & 3)[:, None, :].astype(np.int8) - ((np.arange(256)[:, None] >> np.arange(0, 8, 2)) & 3)[None, :, :].astype(np.int8)).sum(axis=2).astype(np.uint8)


def difference(a: str, b: str) -> int:
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    return int(_DISTANCE[x[1:], y[1:]].sum(dtype=np.int64)) + min(LENGTH_CAP, abs(int(x[0]) - int(y[0])))


def likeness(a: str, b: str) -> float:
    """1 - difference / the largest difference that can be, from 0 to 1."""
    return 1.0 - difference(a, b) / (3 * 4 * (len(a) // 2 - 1) + LENGTH_CAP)


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by the first as many code points of the following text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def in_order(docs: DataFrame, key: str, text: str, parts: int) -> DataFrame:
    """key, text, _look: rows dealt to sorted ranges of the (integer) key; each range also has the first row of the next one, marked.

    Bounds come from approximate percentiles of the key, so no range grows with the input while parts does; one row a
    range is sent twice, and the last range gets the first row of all.
    """
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    found = rows.select(F.percentile_approx("_key", [k / parts for k in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else None
    cuts = np.unique(np.array(found or [], np.int64))

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        known = keys.notna()
        return pd.Series(np.where(known, np.searchsorted(cuts, keys.fillna(0).astype("int64"), side="right"), 0).astype("int32"))

    rows = rows.withColumn("_range", place("_key"))
    firsts = {r["_range"]: r["_key"] if r["_all"] else None for r in rows.groupBy("_range").agg(F.min("_key").alias("_key"), F.bool_and(F.col("_key").isNotNull()).alias("_all")).collect()}
    used = sorted(firsts)  # the range before one looks at its first row; before the first is the last
    starts = docs.sparkSession.createDataFrame([(r, firsts[r], used[k - 1]) for k, r in enumerate(used)], "_of int, _first long, _to int")
    looks = rows.join(F.broadcast(starts), (F.col("_range") == F.col("_of")) & F.col("_key").eqNullSafe(F.col("_first"))).select("_key", "_text", F.col("_to").alias("_range"), F.lit(True).alias("_look"))
    dealt = rows.withColumn("_look", F.lit(False)).unionByName(looks)
    return dealt.repartitionById(len(cuts) + 1, "_range").sortWithinPartitions("_range", "_look", F.col("_key").asc_nulls_first(), "_text")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    source = documents_of(docs, key, text)
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = in_order(source, key, text, parts).select("_range", "_look", "_key", "_text")
    kind = source.schema[key].dataType.simpleString()

    def run(taken):
        schema = None

        def pairs():
            held = None
            for part in taken:
                nonlocal schema
                schema = schema or pa.schema([pa.field(key, part.column(2).type), *(pa.field(n, t) for n, t in (("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())))])
                for where, look, k, t in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    now = (where, look, k, t, fingerprint(t.encode("utf-8", "surrogatepass"), buckets))
                    if held is not None and held[0] == where and not held[1]:
                        yield held, now
                    held = now

        def rows():
            for (_, _, k, t, own), (_, _, _, following, its) in pairs():
                raw = edited(t, following).encode("utf-8", "surrogatepass")
                changed = fingerprint(raw, buckets)
                yield k, len(t), hashlib.sha256(raw).hexdigest(), own, changed, likeness(own, changed), likeness(own, its)

        found = rows()
        first = next(found, None)
        if first is not None:
            yield from batches((r for start in ((first,), found) for r in start), schema, weight=lambda r: 600)

    return ordered.mapInArrow(run, f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
