"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set holds the 64-bit hashes of its distinct word runs. Its sketch has COORDINATES coordinates, filled in
rounds: in round i every element falls to one hashed bin with a value that is larger in later rounds, each bin keeps
its least value, and rounds end as soon as all bins are filled; from round COORDINATES on, round COORDINATES + j sends
every element to bin j, so that every coordinate is filled after at most twice as many rounds. Coordinates agree with
the probability of the sets' similarity, concentrated as for independent ones.

Documents of equal sets form one class, stood for by one of its rows. A class's signature is the lowest byte of every
coordinate; a band is ROWS bytes of it, and classes of equal bytes in a band share a bucket. With 32 bands of 4, a pair
of similarity 0.8 shares no bucket with probability 5e-8.

Pairs are never rows of a table. The members of a bucket, in blocks of about BLOCK, go to one task, which compares
their signatures there and keeps the members that have a partner: in the first band the two share, of fitting size, in
another component, and agreeing in LEAST_AGREED coordinates at least (five standard deviations below what a similarity
of 0.8 gives: probability 3e-7). To these the full sets are joined, each pair is confirmed on them unless its ends are
linked already, and a task puts out no more links than members. Buckets of several blocks have every block compared
within itself first; then, with the components that gives, block is set against block. Members of a component that
fills blocks of its own aren't compared with each other again, all other pairs are; no cap leaves any out.

Defined results: a null or blank text has an empty set and is linked with nothing; repeated rows each get their row,
with the same values; a null id counts as larger than any other, and a component of rows without ids has a null id;
rows of one id and different texts are told apart; an empty table gives an empty result. Ids are integers.
Rows are told apart by their place in the input, which must be a table read from files; other inputs are written to
the shared folder first (table=False).
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import batches, discard, documents_of, fresh, sliced, stored, tidy, whole_groups
from lectern.llm.components import components

COORDINATES, ROWS = 128, 4
BANDS = COORDINATES // ROWS
#: In how many of the signature's bytes candidates agree.
LEAST_AGREED = 80
#: Linked if PERCENT_OF * intersection >= PERCENT * union.
PERCENT, PERCENT_OF = 80, 100
#: Members of a bucket that are compared with each other at a time, and those with as many others.
BLOCK = 500
#: Bits of the filter through which texts go before they are shuffled: at most 133,153 words of 63 bits, about two megabytes.
FILTER_BITS = 1 << 23
#: Into how many parts the rows of one set are dealt where their class is looked up.
SALT = 16
#: Words whose hashes a task remembers.
CACHE_WORDS = 200_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, size: int = 2, known: _Words | None = None) -> np.ndarray:
    """Sorted hashes of the distinct runs of `size` words; of the whole sequence if there are fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.frombuffer(array("Q", map((_Words() if known is None else known).__getitem__, words)), np.uint64)
    width = min(size, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out = _mix(out * _A + h[k : len(h) - width + 1 + k] + np.uint64(k + 1))
    if width < size:
        out = _mix(out + np.uint64(width) * _C)  # apart from a pair of the same words
    return np.unique(out)


_seeds = _mix((np.arange(2 * COORDINATES, dtype=np.uint64) + np.uint64(1)) * _A)


def sketch(elements: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The filled coordinates; elements isn't empty."""
    out = np.full(coordinates, ~np.uint64(0))
    begin, step = 0, 1
    while begin < 2 * coordinates:
        end = min(begin + step, coordinates if begin < coordinates else 2 * coordinates)
        rounds = np.arange(begin, end, dtype=np.uint64)
        mixed = _mix(elements[None, :] ^ _seeds[begin:end, None])
        value = (rounds[:, None] << np.uint64(52)) | (mixed >> np.uint64(12))
        if begin < coordinates:
            np.minimum.at(out, (mixed & np.uint64(0xFFF)).astype(np.int64).ravel() % coordinates, value.ravel())
        else:
            bins = np.arange(begin, end) - coordinates
            out[bins] = np.minimum(out[bins], value.min(axis=1))
        if not (out == ~np.uint64(0)).any():
            break
        begin, step = end, max(1, min(2 * step, 65536 // len(elements)))
    return out


def signature(coordinates: np.ndarray) -> np.ndarray:
    """The lowest byte of each coordinate."""
    return (coordinates & np.uint64(0xFF)).astype(np.uint8)


def buckets(sig: np.ndarray) -> np.ndarray:
    """One key a band: the band's number and its bytes."""
    return (np.arange(BANDS, dtype=np.int64) << 32) | sig.view("<u4").astype(np.int64)


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_row (a row's place in the table), _id, _text."""
    return documents_of(docs, key, text).select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_text"))


def sketches(rows: DataFrame, size: int) -> DataFrame:
    """_row, _id, n, s1, s2 (128-bit hash of the set; null without one), sig, keys (the buckets) of every row of numbered()."""
    kinds = "_row long, _id long, n long, s1 long, s2 long, sig binary, keys array<long>"
    schema = pa.schema([("_row", pa.int64()), ("_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sig", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(parts):
        known = _Words()

        def drawn():
            for part in sliced(parts):
                for row, k, t in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    x = shingles(t, size, known)
                    if len(x):
                        s = np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64)
                        sig = signature(sketch(x))
                        yield row, k, len(x), int(s[0]), int(s[1]), sig.tobytes(), buckets(sig)
                    else:
                        yield row, k, 0, None, None, None, None

        yield from tidy(batches(drawn(), schema, weight=lambda r: 8 * BANDS + COORDINATES))

    return rows.mapInArrow(run, kinds)


def _sets(rows: DataFrame, size: int, ids: DataFrame) -> DataFrame:
    """id, elements (packed sorted hashes) of the rows of numbered() that are asked for.

    A bitmap of the ids' hashes, of FILTER_BITS bits at any size, is broadcast first, so that few other texts are shuffled
    where the ids are few; the join with the ids themselves decides.
    """
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    bitmap = ids.groupBy(F.floor(bit / 63).alias("_word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(xxhash64(id), {FILTER_BITS}L) % 63 as int)))").alias("_bits"))
    texts = rows.select(F.col("_row").alias("id"), "_text").withColumn("_bit", bit)
    likely = texts.join(F.broadcast(bitmap), F.floor(F.col("_bit") / 63) == F.col("_word")).filter(F.expr("(shiftright(_bits, cast(_bit % 63 as int)) & 1) = 1"))
    source = likely.select("id", "_text").join(ids.hint("merge"), "id").select("id", "_text")
    schema = pa.schema([("id", pa.int64()), ("elements", pa.binary())])

    def run(parts):
        known = _Words()
        made = ((k, shingles(t, size, known).tobytes()) for part in sliced(parts) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
        yield from tidy(batches(made, schema, weight=lambda r: len(r[1])))

    return source.mapInArrow(run, "id long, elements binary")


GROUP = ["key", "x", "y"]
MEMBER = "key long, x long, y long, id long, component long, n long, sig binary"


def _numbers(part: pa.RecordBatch, name: str) -> np.ndarray:
    return part.column(part.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def candidates(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of MEMBER, sorted by group: pairs of rows of one group that may be linked, and in how many coordinates they agree.

    Rows are compared with those 1, 2, ... places behind them, as long as any group reaches so far.
    """
    key, x, y, component, n = (_numbers(part, c) for c in (*GROUP, "component", "n"))
    sig = np.frombuffer(b"".join(part.column(part.schema.get_field_index("sig")).to_pylist()), np.uint8).reshape(-1, COORDINATES)
    bits = sig.view("<u4")
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    end = np.repeat(np.r_[first[1:], len(key)], np.diff(np.r_[first, len(key)]))
    out, at, step = [], np.arange(len(key)), 0
    while len(at):
        step += 1
        at = at[at + step < end[at]]
        for k in range(0, len(at), 1 << 14):
            a = at[k : k + (1 << 14)]
            b = a + step
            fits = (component[a] != component[b]) & (PERCENT_OF * np.minimum(n[a], n[b]) >= PERCENT * np.maximum(n[a], n[b]))
            a, b = a[fits], b[fits]
            here = (bits[a] == bits[b]).argmax(axis=1) == key[a] >> 32  # else they meet in an earlier band
            a, b = a[here], b[here]
            agreed = (sig[a] == sig[b]).sum(axis=1)
            alike = agreed >= LEAST_AGREED
            if alike.any():
                out.append((a[alike], b[alike], agreed[alike]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def _partnered(members: DataFrame) -> DataFrame:
    """Of rows of MEMBER those that have a partner in their group."""

    def run(parts):
        def kept():
            for part in whole_groups(parts, len(GROUP)):
                a, b, _ = candidates(part)
                if len(a):
                    yield part.take(pa.array(np.unique(np.concatenate([a, b]))))

        yield from tidy(kept())

    return members.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, MEMBER)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough, on all their elements."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return PERCENT_OF * both >= PERCENT * (len(x) + len(y) - both)


def _linked(members: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links that connect what is similar in each group; a row of MEMBER gives one at most."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(parts):
        def links() -> Iterator[tuple[int, int]]:
            for part in whole_groups(parts, len(GROUP)):
                ids, elements = _numbers(part, "id"), part.column(part.schema.get_field_index("elements"))
                root = list(range(part.num_rows))

                def top(k: int, root=root) -> int:
                    while root[k] != k:
                        root[k] = k = root[root[k]]
                    return k

                a, b, agreed = candidates(part)
                order = np.argsort(-agreed, kind="stable")
                own = {k: np.frombuffer(elements[k].as_buffer(), np.uint64) for k in np.unique(np.concatenate([a, b])).tolist()}
                for k, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
                    r, s = top(k), top(j)
                    if r != s and similar(own[k], own[j]):
                        root[max(r, s)] = min(r, s)
                        yield int(ids[k]), int(ids[j])

        yield from tidy(batches(links(), schema))

    held = members.join(sets, "id").select(*(c.split()[0] for c in MEMBER.split(", ")), "elements")
    return held.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, "a long, b long")


def _block(of: str, size: str):
    return F.pmod(F.xxhash64(of), F.ceil(F.col(size) / BLOCK).cast("long"))


def _against(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of MEMBER (without n and sig) that set block against block, for buckets of several blocks and components.

    A component with BLOCK members of a bucket or more has blocks of its own there, which aren't set against each other;
    the others share blocks. Only blocks are paired, never members.
    """
    wide = members.filter(F.col("size") > BLOCK).join(nodes.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "size", F.coalesce("component", "id").alias("component"))
    held = stored(wide.groupBy("key", "component").agg(F.count("*").alias("held")), "held")
    split = held.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key")
    own = F.col("held") >= BLOCK
    placed = stored(
        wide.join(held.join(split, "key"), ["key", "component"]).select("key", "id", "component", F.when(own, F.col("component")).otherwise(-1).alias("u"), F.when(own, _block("id", "held")).otherwise(_block("component", "size")).alias("v")),
        "blocks",
    )
    discard(held)
    each = placed.select("key", "u", "v").distinct()
    a, b = (each.select("key", F.col("u").alias(f"u{s}"), F.col("v").alias(f"v{s}")) for s in "ab")
    pairs = a.join(b, "key").filter("(ua < ub or (ua = ub and va <= vb)) and (ua <> ub or ua = -1)").select("*", F.xxhash64("ua", "va").alias("x"), F.xxhash64("ub", "vb").alias("y"))
    sides = pairs.select("key", F.col("ua").alias("u"), F.col("va").alias("v"), "x", "y").unionByName(pairs.filter("ua <> ub or va <> vb").select("key", F.col("ub").alias("u"), F.col("vb").alias("v"), "x", "y"))
    return placed.join(sides, ["key", "u", "v"]).select(*GROUP, "id", "component")


def classes(rows: DataFrame, size: int = 2) -> tuple[DataFrame, DataFrame]:
    """rows as of numbered() -> of every row: _row, _id, n, rep (the row that stands for its set), least (that row's id);
    and of every rep that is linked: node, least and head (the least id of its component, and the row of it)."""
    drawn = stored(sketches(rows, size), "sketches")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("least"), F.col("_row").alias("rep"))).alias("f")
    copies = drawn.filter("n > 0").groupBy("s1", "s2").agg(first, F.count("*").alias("_n")).filter("_n > 1").select("s1", "s2", "f.rep", "f.least", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"))
    dealt = drawn.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALT)).cast("int"))
    alone = F.col("rep").isNull()
    told = stored(dealt.join(copies.hint("merge"), ["s1", "s2", "_salt"], "left").select("_row", "_id", "n", F.coalesce("rep", "_row").alias("rep"), F.when(alone, F.col("_id")).otherwise(F.col("least")).alias("least"), "sig", "keys"), "classes")
    discard(drawn)
    own = told.filter("n > 0 and _row = rep")
    spread = own.select(F.col("rep").alias("id"), F.explode("keys").alias("key"))
    shared = stored(spread.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "shared")
    members = stored(spread.join(shared.hint("merge"), "key").select("key", "id", "size"), "buckets")
    discard(shared)
    facts = own.select(F.col("rep").alias("id"), "n", "sig")
    place = F.when(F.col("size") > BLOCK, _block("id", "size")).otherwise(0)

    def links_of(groups: DataFrame) -> DataFrame:
        met = stored(_partnered(groups.join(facts, "id").select(*(c.split()[0] for c in MEMBER.split(", ")))), "partnered")
        sets = stored(_sets(rows, size, met.select("id").distinct()), "sets")
        found = stored(_linked(met, sets), "links")
        discard(met)
        discard(sets)
        return found

    links = links_of(members.select("key", place.alias("x"), place.alias("y"), "id", F.col("id").alias("component")))
    nodes = components(links)
    if not members.filter(F.col("size") > BLOCK).isEmpty():
        more = links_of(_against(members, nodes))
        nodes = components(nodes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))  # a component's star and the new links give the same as all links
    discard(members)
    nodes = nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())  # the component's least, too
    ids = own.select(F.col("rep").alias("node"), "_id")
    heads = nodes.join(ids, "node").groupBy("component").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("least"), F.col("node").alias("head"))).alias("f")).select("component", "f.least", "f.head")
    return told.drop("sig", "keys"), stored(nodes.join(stored(heads, "heads"), "component").select("node", "least", "head"), "components")


def _judged(rows: DataFrame, size: int) -> DataFrame:
    """_row, _id, n, component_id, _stays (one row of each component) of every row."""
    told, nodes = classes(rows, size)
    linked = F.col("head").isNotNull()
    return told.join(nodes.withColumnRenamed("least", "_far").withColumnRenamed("node", "rep"), "rep", "left").select(
        "_row", "_id", "n", F.when(linked, F.col("_far")).otherwise(F.col("least")).alias("component_id"), (F.col("_row") == F.coalesce("head", "rep")).alias("_stays")
    )


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 2, table: bool = False) -> DataFrame:
    """key, n_shingles, component_id, kept of every row. table: docs is read from files as it is."""
    docs = documents_of(docs, key, text)
    out = _judged(numbered(docs if table else stored(docs, "near-input"), key, text), size)
    kept = F.when(F.col("_id").isNull(), F.col("_stays")).otherwise(F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)))
    return out.select(F.col("_id").alias(key), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, table: bool = False) -> DataFrame:
    """The rows of docs, with all their columns, that stay: of each component the one of least id (of equal ids the first)."""
    docs = docs if table else stored(docs, "near-input")
    row = fresh("_lost", docs)
    lost = _judged(numbered(docs, key, text), size).filter("not _stays").select(F.col("_row").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(lost, row, "left_anti").drop(row)
