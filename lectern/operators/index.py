"""A stored inverted index of chunks that takes additions and removals as segments, and a search that skips blocks by their bounds.

A folder holds `postings`, in parts named by segment. A posting row is one term in one block of an article's chunks (neighbours by
chunk_idx): entries with counts and lengths, and beside them what is needed to pass the block over without its entries being read: how many
chunks have the term in each field, the highest count and the least length. Rows without a term hold the sizes of articles. Everything is signed: a removal
writes the chunk's entries and sizes with a minus, so the state of the index is the sum of its segments, in any order, and merge() writes that sum as one. A
segment that is written again under its name replaces itself, so a batch may run twice.

search() gives the rows of search.bm25() over the chunks the index stands for. A block's bound for a query is the sum over the query's
terms of the highest weight a chunk of it could have. The blocks with the highest bounds are scored first; the score that the last wanted chunk
has there is a threshold, and of the other blocks only those are read whose bound reaches it. Both readings and the threshold
are relations over all queries at once. Rows lie in folders by bucket of the term, so a query for few terms opens few of them.

What is dealt out is texts, once, when they come in, and in a search for few queries one row a block with what it holds of their terms.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import retrieval_terms
from lectern.operators import entries as E
from lectern.operators.scores import best_scores, numbered_terms, reaching
from lectern.operators.search import CANDIDATES, DELTA, SECTION_BOOST, SMALL_BYTES, TEXT_BOOST, B, K, Tokenizer, _article_of, sent
from lectern.sources.batches import bounded
from lectern.sources.scratch import stored as _stored

#: Chunks of a block, folders of terms, and the folder of the rows of sizes.
BLOCK, BUCKETS, SIZED = 64, 16, -1
FIELDS = {"section": SECTION_BOOST, "text": TEXT_BOOST}
#: What rounding to nine digits may add to a score.
ROUNDING = 1e-8
#: Entries that a posting row must have on average for bounds to be read: with fewer, bounds take as much as entries, and all blocks are scored.
WORTH = 2
#: Thresholds (an article and query each) that go to every task, and facts (an article and term each), of about 40 bytes.
THRESHOLDS, FACTS = 1 << 20, 1 << 19
#: Shuffle files go with the write that made them, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _tidy(spark: SparkSession):
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    with _tidy(df.sparkSession):
        return _stored(df, name)


def bucket(term: Column) -> Column:
    return F.coalesce(F.when(term.isNotNull(), F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")), F.lit(SIZED))


def _kinds(df: DataFrame) -> str:
    return f"article_id {df.schema['article_id'].dataType.simpleString()}, block long, term string, n long, " + ", ".join(f"n_{f} long, top_{f} int, low_{f} int" for f in FIELDS) + ", entries array<int>"


def _write(rows: DataFrame, path: str, segment: str) -> None:
    """Rows stay in the tasks that made them, which write a file of each folder."""
    with _tidy(rows.sparkSession):
        ordered = rows.withColumn("bucket", bucket(F.col("term"))).sortWithinPartitions("bucket")  # inside a folder rows come by block, as they were made
        ordered.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings/segment={segment}")


def add(path: str, segment: str, added: DataFrame, removed: DataFrame | None = None, block: int = BLOCK, tokenizer: Tokenizer = retrieval_terms) -> None:
    """Write a segment: chunks (article_id, chunk_idx, section, text) that come in, and those that go, as they were added. All segments must have the same block."""
    signed = [df.select("article_id", F.floor(F.col("chunk_idx") / block).alias("block"), "chunk_idx", F.lit(sign).alias("sign"), *FIELDS) for df, sign in ((added, 1), (removed, -1)) if df is not None]
    dealt = reduce(DataFrame.unionByName, signed).repartition("article_id", "block").sortWithinPartitions("article_id", "block")
    read = dealt.select("article_id", "block", "chunk_idx", "sign", *(tokenizer(F.col(f)).alias(f) for f in FIELDS))
    _write(bounded(read).mapInArrow(E.made(block), _kinds(added)), path, segment)


def merge(spark: SparkSession, path: str, to: str, block: int = BLOCK) -> None:
    """Write the sum of all segments to another folder, as one."""
    every = spark.read.parquet(f"{path}/postings")
    dealt = every.filter(F.col("bucket") != SIZED).select("article_id", "block", "term", "entries").repartition("article_id", "block").sortWithinPartitions("article_id", "block")
    live = bounded(dealt).mapInArrow(E.merged, _kinds(every))
    sizes = _sizes(every).select("article_id", F.col("chunks").alias("n"), *(F.col(f).alias(f"n_{f}") for f in FIELDS))
    _write(live.unionByName(sizes, allowMissingColumns=True), to, "merged")


def _sizes(postings: DataFrame) -> DataFrame:
    return postings.filter(F.col("bucket") == SIZED).groupBy("article_id").agg(F.sum("n").alias("chunks"), *(F.sum(f"n_{f}").alias(f) for f in FIELDS)).filter("chunks > 0")


def _live(entries: DataFrame, by: list[str]) -> DataFrame:
    """Of signed entries those that no removal has cancelled."""
    return entries.groupBy(*by, "chunk_idx", *(f"{x}_{f}" for f in FIELDS for x in ("tf", "len"))).agg(F.sum("sign").alias("sign")).filter("sign > 0")


def _opened(rows: DataFrame, block: int) -> DataFrame:
    """article_id, term, block and entries (chunk_idx, sign, tf and len by field) of posting rows."""
    at = lambda k, i: F.get("entries", k * E.INTS + i)
    names = ["sign", *(f"{x}_{f}" for f in FIELDS for x in ("tf", "len"))]
    one = lambda k: F.struct((F.col("block") * block + at(k, 0)).alias("chunk_idx"), *(at(k, i + 1).alias(x) for i, x in enumerate(names)))
    each = F.transform(F.sequence(F.lit(0), (F.size("entries") / E.INTS).cast("int") - 1), one)
    return rows.select("article_id", "term", "block", F.explode(each).alias("e")).select("article_id", "term", "block", "e.*")


def _weight(field: str, tf: Column, length: Column, k: float, b: float, delta: float) -> Column:
    return F.col(f"idf_{field}") * (delta + tf * (k + 1) / (tf + k * (1 - b + b * length / F.col(f"avg_{field}"))))


class Search:
    """A search of the index for queries (query_id, pos, text; article_id if asked of one article), in steps that can be looked at."""

    def __init__(self, spark: SparkSession, path: str, queries: DataFrame, most: int = CANDIDATES, block: int = BLOCK, k: float = K, b: float = B, delta: float = DELTA, tokenizer: Tokenizer = retrieval_terms) -> None:
        self.most, self.own, self.size = most, _article_of(queries), block
        self.key = ["article_id", "query_id", "pos"]
        self.weigh = lambda f, tf, length: F.when(tf > 0, _weight(f, tf, length, k, b, delta)).otherwise(0.0)
        every = spark.read.parquet(f"{path}/postings")
        self.postings = every.filter((F.col("bucket") != SIZED) & F.col("block").isNotNull() & F.col("article_id").isNotNull())
        asked = queries.select(*self.own, "query_id", "pos", F.array_distinct(tokenizer(F.col("text"))).alias("_terms"))
        self.terms = stored(asked.select(*self.own, "query_id", "pos", F.size("_terms").alias("_wanted"), F.explode("_terms").alias("term")).withColumn("bucket", bucket(F.col("term"))), "index-terms")
        # Few queries of all articles go to every task; then nothing is dealt out by query, whose rows would be many times the postings.
        few = not self.own and (self.terms.agg(F.sum(F.octet_length(F.to_json(F.struct("query_id", "pos", "_wanted", "term"))))).first()[0] or 0) <= SMALL_BYTES
        self.numbers = numbered_terms(self.terms) if few else None
        if few:
            folders = [r["bucket"] for r in self.terms.select("bucket").distinct().collect()]
            self.wanted = self.postings.filter(F.col("bucket").isin(folders)).join(self.numbers, "term")
        else:
            self.wanted = self.postings.join(self.terms.select(*self.own, "bucket", "term").distinct(), [*self.own, "bucket", "term"], "left_semi")
        of_field = lambda: (x for f in FIELDS for x in (F.sum(f"n_{f}").alias(f"n_{f}"), F.max(f"top_{f}").alias(f"top_{f}"), F.min(f"low_{f}").alias(f"low_{f}")))
        self.heads = self.wanted.groupBy("article_id", "term", "block").agg(F.sum("n").alias("n"), *of_field())
        term = ["term", "tid"] if few else ["term"]
        if not few:
            self.heads = stored(self.heads, "index-heads")
        # The rows of a term are counted with it: they show how many entries a row has.
        held = (self.wanted if few else self.heads).groupBy("article_id", *term).agg(F.count("*").alias("_rows"), F.sum("n").alias("_n"), *(F.sum(f"n_{f}").alias(f"n_{f}") for f in FIELDS))
        idf = lambda f, boost: boost * F.log(1 + (F.col("chunks") - F.col(f"n_{f}") + 0.5) / (F.col(f"n_{f}") + 0.5))
        facts = [x for f, boost in FIELDS.items() for x in (idf(f, boost).alias(f"idf_{f}"), (F.col(f) / F.col("chunks")).alias(f"avg_{f}"))]
        self.weights = stored(held.join(_sizes(every), "article_id").select("article_id", *term, "_rows", "_n", *facts), "index-weights")
        if few:
            size, rows, n, articles = self.weights.agg(F.count("*"), F.sum("_rows"), F.sum("_n"), F.count_distinct("article_id")).first()
            few = size <= FACTS and articles * self.terms.select("query_id", "pos").distinct().count() <= THRESHOLDS
        self.few = few
        if few:
            names = ["article_id", "tid", *(f"{x}_{f}" for f in FIELDS for x in ("idf", "avg"))]
            self.facts = spark.sparkContext.broadcast(E.Weights(self.weights.select(*names).toArrow()))
            self.opened = E.scored(block, self.facts, k, b, delta)
            self.weights = sent(self.weights.select(*names))
            self._choose_of_few(-(-2 * most // block) + 1, (n or 0) >= WORTH * (rows or 0))
        else:
            self.weights = sent(self.weights.select("article_id", "term", *(f"{x}_{f}" for f in FIELDS for x in ("idf", "avg"))))
            self._choose(-(-2 * most // block) + 1)

    def _bound(self) -> Column:
        return reduce(Column.__add__, (self.weigh(f, F.col(f"top_{f}"), F.col(f"low_{f}")) for f in FIELDS))

    def _packed(self, rows: DataFrame, *columns: Column) -> DataFrame:
        """article_id, block, posts: a row a block. What a task has of a block goes together before it is dealt out."""
        return rows.groupBy("article_id", "block").agg(F.collect_list(F.struct("tid", *columns)).alias("posts"))

    def _choose_of_few(self, first: int, bounded_: bool) -> None:
        """Bounds of blocks, one row a block for all queries; scores of the first ones, and the blocks that may still hold something better."""
        if not bounded_:
            self.first = self.later = None
            self.early = stored(self._top(best_scores(self._packed(self.wanted, F.col("entries")), self.terms, self.numbers, self.most, self.opened)), "index-early")
            return
        # Rounded up, as a bound need not be exact.
        bound = (self._bound() * (1 + 2**-22)).cast("float").alias("bound")
        rows = self.wanted.drop("term").join(self.weights, ["article_id", "tid"]).select("article_id", "block", "tid", bound)
        self.bounds = stored(self._packed(rows, F.col("bound")).sortWithinPartitions("article_id", "block"), "index-bounds")
        order = Window.partitionBy(*self.key).orderBy(F.desc("_bound"), "block")
        ranked = best_scores(self.bounds, self.terms, self.numbers, first, E.bounds).select(*self.key, F.col("chunk_idx").alias("block"), F.col("score").alias("_bound"))
        self.first = stored(ranked.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= first).select(*self.key, "block"), "index-first")
        early = sent(self.first.select("article_id", "block").distinct())
        self.early = stored(self._top(self._scored_of_few(early)), "index-early")
        best = Window.partitionBy(*self.key).orderBy(F.desc("score"), "chunk_idx")
        self.least = self.early.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") == self.most).select(*self.key, (F.col("score") - ROUNDING).alias("_least"))
        self.rest = stored(reaching(self.bounds, self.terms, self.numbers, self.least, E.bounds, False).join(early, ["article_id", "block"], "left_anti"), "index-later")
        self.later = reaching(self.bounds, self.terms, self.numbers, self.least, E.bounds, True).join(self.first, [*self.key, "block"], "left_anti")

    def _top(self, scores: DataFrame) -> DataFrame:
        order = Window.partitionBy(*self.key).orderBy(F.desc("score"), "chunk_idx")
        return scores.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= self.most).drop("_n")

    def _scored_of_few(self, blocks: DataFrame) -> DataFrame:
        """The best scores of all queries in blocks (article_id, block): a small table of blocks goes to the entries, to a large one they come packed."""
        return best_scores(self._packed(self.wanted.join(blocks, ["article_id", "block"], "left_semi"), F.col("entries")), self.terms, self.numbers, self.most, self.opened)

    def _choose(self, first: int) -> None:
        """Bounds of blocks; scores of the first ones; the blocks that may still hold something better."""
        bounds = self.heads.join(self.weights, ["article_id", "term"]).select("article_id", "term", "block", self._bound().alias("_bound"))
        blocks = bounds.join(self.terms, [*self.own, "term"]).groupBy(*self.key, "block").agg(F.sum("_bound").alias("_bound"), F.count("*").alias("_terms"), F.first("_wanted").alias("_wanted"))
        possible = blocks.filter(F.col("_terms") >= F.when(F.col("_wanted") >= 3, 2).otherwise(1))
        order = Window.partitionBy(*self.key).orderBy(F.desc("_bound"), "block")
        ranked = stored(possible.withColumn("_n", F.row_number().over(order)), "index-blocks")
        self.first = ranked.filter(F.col("_n") <= first).select(*self.key, "block")
        self.early = stored(self.scored(self.first), "index-early")
        best = Window.partitionBy(*self.key).orderBy(F.desc("score"), "chunk_idx")
        least = self.early.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") == self.most).select(*self.key, (F.col("score") - ROUNDING).alias("_least"))
        self.later = ranked.filter(F.col("_n") > first).join(least, self.key, "left").filter(F.col("_least").isNull() | (F.col("_bound") >= F.col("_least"))).select(*self.key, "block")

    def entries(self, blocks: DataFrame) -> DataFrame:
        """article_id, term, block and live entries of the queries' terms in blocks (key, block); each is read once, whatever the number of queries."""
        asked = blocks.join(self.terms, [*self.own, "query_id", "pos"]).select("article_id", "bucket", "term", "block").distinct()
        return _live(_opened(self.postings.join(asked, ["article_id", "bucket", "term", "block"], "left_semi"), self.size), ["article_id", "term", "block"])

    def scored(self, blocks: DataFrame) -> DataFrame:
        """key, chunk_idx, matched, score of the chunks in blocks that have terms enough."""
        weighed = self.entries(blocks).join(self.weights, ["article_id", "term"]).select("article_id", "term", "block", "chunk_idx", reduce(Column.__add__, (self.weigh(f, F.col(f"tf_{f}"), F.col(f"len_{f}")) for f in FIELDS)).alias("_w"))
        sums = weighed.join(self.terms, [*self.own, "term"]).join(blocks, [*self.key, "block"], "left_semi").groupBy(*self.key, "chunk_idx", "_wanted").agg(F.count("*").alias("matched"), F.round(F.sum("_w"), 9).alias("score"))
        return sums.filter(F.col("matched") >= F.when(F.col("_wanted") >= 3, 2).otherwise(1)).drop("_wanted")

    def best(self) -> DataFrame:
        """article_id, query_id, pos, chunk_idx, matched, score, rank, as search.bm25() gives them."""
        order = Window.partitionBy(*self.key).orderBy(F.desc("score"), "chunk_idx")
        if self.few:
            every = self.early if self.later is None else self.early.unionByName(self._scored_of_few(sent(self.rest)))
        else:
            every = self.early.unionByName(self.scored(self.later)).dropDuplicates([*self.key, "chunk_idx"])  # a block may be read early for one query and later for another
        return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= self.most)

    def reads(self) -> DataFrame:
        """query_id, blocks (that have the query's terms), blocks_read, postings, postings_read: what the bounds have saved each query."""
        sizes = self.heads.join(self.terms, [*self.own, "term"]).groupBy(*self.key, "block").agg(F.sum("n").alias("_n"))
        read = (sizes if self.later is None else self.first.unionByName(self.later)).select(*self.key, "block").withColumn("_read", F.lit(True))
        marked = sizes.join(read, [*self.key, "block"], "left")
        return marked.groupBy("query_id").agg(F.count("*").alias("blocks"), F.count("_read").alias("blocks_read"), F.sum("_n").alias("postings"), F.coalesce(F.sum(F.when(F.col("_read"), F.col("_n"))), F.lit(0)).alias("postings_read"))
