"""Ranking chunks for questions: inverted index, BM25+, fusion of several queries, literal matches, focus anchors.

All is relational: postings are one aggregation of exploded terms, a search is a join of query terms with postings on
(article, term), and ranks are windows per (article, query), which Spark cuts to the best while it sorts.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from ahocorasick import Automaton
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import UNEVEN, clean, exact_literals, normalize_literal, overlap_score, retrieval_terms, token_set
from lectern.operators.scores import best_scores, numbered_terms
from lectern.sources.batches import SLICE, bounded
from lectern.sources.scratch import stored

CANDIDATES, RRF, SECTION_BOOST, TEXT_BOOST = 20, 60, 3.0, 1.0
K, B, DELTA = 1.2, 0.7, 0.5
WINDOWS, RELEVANT_BUDGET, ANCHORS = 8, 24_000, 3
#: Literals that are looked for at a time, and their bytes.
LITERALS, LITERAL_BYTES = 50_000, 4 << 20
#: A term that no text has.
NONE = "\0"


Tokenizer = Callable[[Column], Column]


#: Bytes of a table, as JSON, up to which it is sent to every task.
SMALL_BYTES = 8 << 20


def sent(table: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """The table, to be sent to every task if it is small, which is counted; else as it is, to be joined by a shuffle."""
    size = table.agg(F.sum(F.octet_length(F.to_json(F.struct(*table.columns))))).first()[0] or 0
    return F.broadcast(table) if size <= most else table


def overlaps(documents: DataFrame, questions: DataFrame, most: int) -> DataFrame:
    """query_id, doc_id, score, rank: the documents that have the greatest share of each question's tokens.

    Documents' tokens are dealt out by document before they are opened, so as long as the questions' tokens are few, a document's counts are
    made where it lies, and only the best of each task move.
    """
    asked = questions.select("query_id", token_set(F.col("question")).alias("_t")).select("query_id", F.size("_t").alias("_n"), F.explode("_t").alias("token"))
    tokens = documents.select("doc_id", token_set(F.col("text")).alias("_t")).repartition("doc_id").select("doc_id", F.explode("_t").alias("token"))
    shared = tokens.join(sent(asked), "token").groupBy("query_id", "doc_id", "_n").agg(F.count("*").alias("shared"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    scored = shared.select("query_id", "doc_id", F.round(F.col("shared") / F.col("_n"), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def postings(chunks: DataFrame, tokenizer: Tokenizer = retrieval_terms, asked: DataFrame | None = None) -> DataFrame:
    """article_id, chunk_idx, field, term, tf, len (distinct terms of the field). asked: a table of the terms that are wanted (column term).

    Terms that nobody asks for go before anything is counted or moved. tokenizer: text -> array of terms, in order.
    """
    # The length is made before the terms are opened; made after, it would be counted anew for every term.
    field = lambda c: F.struct(F.lit(c).alias("field"), F.size(F.array_distinct(tokenizer(F.col(c)))).alias("len"), tokenizer(F.col(c)).alias("terms"))
    fields = chunks.select("article_id", "chunk_idx", F.explode(F.array(field("section"), field("text"))).alias("f"))
    sized = fields.select("article_id", "chunk_idx", F.col("f.field").alias("field"), F.col("f.len").alias("len"), F.explode("f.terms").alias("term"))
    wanted = sized if asked is None else sized.join(asked.select(*_article_of(asked), "term").distinct(), [*_article_of(asked), "term"], "left_semi")
    return wanted.groupBy("article_id", "chunk_idx", "field", "term", "len").agg(F.count("*").alias("tf"))


def field_stats(chunks: DataFrame, tokenizer: Tokenizer = retrieval_terms) -> DataFrame:
    """article_id, field, chunks, avglen."""
    of = lambda c: F.size(F.array_distinct(tokenizer(F.col(c))))
    sums = chunks.groupBy("article_id").agg(F.count("*").alias("chunks"), F.avg(of("section")).alias("section"), F.avg(of("text")).alias("text"))
    return sums.select("article_id", "chunks", F.explode(F.array(F.struct(F.lit("section").alias("field"), F.col("section").alias("avglen")), F.struct(F.lit("text").alias("field"), F.col("text").alias("avglen")))).alias("s")).select("article_id", "chunks", "s.*")


def _article_of(queries: DataFrame) -> list[str]:
    return ["article_id"] if "article_id" in queries.columns else []


def distinct_queries(queries: DataFrame) -> DataFrame:
    """query_id, pos, text (and article_id, if there is one): white space collapsed, empty ones dropped, of equal ones (but for case) the first."""
    own = _article_of(queries)
    tidy = queries.select(*own, "query_id", "pos", clean(F.col("text")).alias("text")).filter("text <> ''")
    first = Window.partitionBy(*own, "query_id", F.lower("text")).orderBy("pos")
    return tidy.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def bm25(chunks: DataFrame, queries: DataFrame, most: int = CANDIDATES, k: float = K, b: float = B, delta: float = DELTA, tokenizer: Tokenizer = retrieval_terms) -> DataFrame:
    """article_id, query_id, pos, chunk_idx, matched, score, rank (from 1) of the best chunks of each article for each query.

    With an article_id, a query is asked of that article alone, where its chunks are (_bm25_of_own). A query of three distinct terms or more needs two of them in a chunk,
    others one. Of queries of all articles, how many chunks have a term is an aggregation that is combined before the shuffle, so a frequent term's postings never meet in one task.
    Few of them (SMALL_BYTES of terms) go to every task, where a block of chunks is scored for all of them at once (scores.best_scores).
    """
    order = Window.partitionBy("article_id", "query_id", "pos").orderBy(F.desc("score"), "chunk_idx")
    ranked = lambda scored: scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    fit = lambda scored: scored.filter(F.col("matched") >= F.when(F.col("_wanted") >= 3, 2).otherwise(1)).drop("_wanted")
    if _article_of(queries):
        return ranked(fit(_bm25_of_own(chunks, queries, k, b, delta, tokenizer)))
    if (few := _sent_terms(queries, tokenizer)) is not None:
        return ranked(_bm25_of_few(chunks, few, most, k, b, delta, tokenizer))
    terms = queries.select("query_id", "pos", F.array_distinct(tokenizer(F.col("text"))).alias("_terms")).select("query_id", "pos", F.size("_terms").alias("_wanted"), F.explode("_terms").alias("term"))
    asked = postings(chunks, tokenizer, terms)
    held = asked.groupBy("article_id", "field", "term").agg(F.count("*").alias("n")).join(field_stats(chunks, tokenizer), ["article_id", "field"])
    weighed = asked.join(held, ["article_id", "field", "term"]).groupBy("article_id", "chunk_idx", "term").agg(F.sum(_part(k, b, delta)).alias("w"))
    return ranked(fit(weighed.join(terms, "term").groupBy("article_id", "query_id", "pos", "chunk_idx", "_wanted").agg(F.count("*").alias("matched"), F.round(F.sum("w"), 9).alias("score"))))


def _part(k: float, b: float, delta: float) -> Column:
    """What a term of a field (field, tf, len) adds to a chunk's score, by n, chunks and avglen."""
    idf = F.log(1 + (F.col("chunks") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    boost = F.when(F.col("field") == "section", SECTION_BOOST).otherwise(TEXT_BOOST)
    return boost * idf * (delta + F.col("tf") * (k + 1) / (F.col("tf") + k * (1 - b + b * F.col("len") / F.col("avglen"))))


def _bm25_of_own(chunks: DataFrame, queries: DataFrame, k: float, b: float, delta: float, tokenizer: Tokenizer) -> DataFrame:
    """bm25() before ranking, for queries of one article each.

    Chunks are dealt out once, by article; all that follows stays there. Each is read once, next to the queries of its article, and only terms
    that these ask for leave its row. Of texts and terms nothing is kept behind that row, so the sorts that follow are of numbers and few words.
    """
    key = ["article_id", "query_id", "pos", "_wanted", "_copies"]
    given = queries.select("article_id", "query_id", "pos", F.array_distinct(tokenizer(F.col("text"))).alias("_terms"))
    # Queries given more than once count as often; the chunks of their article don't.
    asked = given.groupBy("article_id", "query_id", "pos", "_terms").agg(F.count("*").alias("_copies")).withColumn("_wanted", F.size("_terms"))
    own = chunks.select("article_id", "chunk_idx", "section", "text").join(queries.select("article_id").distinct().hint("merge"), "article_id", "left_semi")
    read = own.select("article_id", "chunk_idx", tokenizer(F.col("section")).alias("_s"), tokenizer(F.col("text")).alias("_t"))
    sized = read.select("*", F.size(F.array_distinct("_s")).alias("_ns"), F.size(F.array_distinct("_t")).alias("_nt"))
    hits = lambda field, c: F.transform(F.array_intersect("_terms", c), lambda w: F.struct(F.lit(field).alias("field"), w.alias("term"), F.size(F.filter(c, lambda x: x == w)).alias("tf")))
    met = sized.join(asked.hint("merge"), "article_id").select(*key, "chunk_idx", "_ns", "_nt", F.concat(hits("section", "_s"), hits("text", "_t")).alias("_hits"))
    every = Window.partitionBy(*key)
    counted = met.select("*", F.count("*").over(every).alias("chunks"), F.avg("_ns").over(every).alias("_as"), F.avg("_nt").over(every).alias("_at")).select("*", F.explode("_hits").alias("h"))
    of = lambda section, text: F.when(F.col("h.field") == "section", F.col(section)).otherwise(F.col(text))
    posted = counted.select(*key, "chunk_idx", "h.*", "chunks", of("_ns", "_nt").alias("len"), of("_as", "_at").alias("avglen"))
    merged = posted.groupBy(*key, "chunk_idx", "field", "term", "len", "chunks", "avglen").agg(F.sum("tf").alias("tf"))
    weighed = merged.withColumn("n", F.count("*").over(Window.partitionBy(*key, "field", "term"))).groupBy(*key, "chunk_idx", "term").agg(F.sum(_part(k, b, delta)).alias("w"))
    sums = weighed.groupBy(*key, "chunk_idx").agg(F.count("*").alias("_n"), F.sum("w").alias("_w"))
    return sums.select("article_id", "query_id", "pos", "chunk_idx", "_wanted", (F.col("_n") * F.col("_copies")).alias("matched"), F.round(F.col("_w") * F.col("_copies"), 9).alias("score"))


def _sent_terms(queries: DataFrame, tokenizer: Tokenizer) -> DataFrame | None:
    """query_id, pos, _wanted, term of the queries, if they are a small table, which is counted."""
    terms = queries.select("query_id", "pos", F.array_distinct(tokenizer(F.col("text"))).alias("_terms")).select("query_id", "pos", F.size("_terms").alias("_wanted"), F.explode("_terms").alias("term"))
    size = terms.agg(F.sum(F.octet_length(F.to_json(F.struct(*terms.columns))))).first()[0] or 0
    return terms if size <= SMALL_BYTES else None


def _bm25_of_few(chunks: DataFrame, terms: DataFrame, most: int, k: float, b: float, delta: float, tokenizer: Tokenizer) -> DataFrame:
    """bm25() before ranking: texts are read once, and what they hold of the queries' terms is stored as numbers; NONE is in every field, so fields are counted too."""
    numbers = numbered_terms(terms)
    field = lambda n, c: F.struct(F.lit(n).alias("field"), F.size(F.array_distinct(c)).alias("len"), F.concat(F.array(F.lit(NONE)), F.col(c)).alias("terms"))
    read = chunks.select("article_id", "chunk_idx", tokenizer(F.col("section")).alias("_s"), tokenizer(F.col("text")).alias("_t"))
    fields = read.select("article_id", "chunk_idx", F.explode(F.array(field("section", "_s"), field("text", "_t"))).alias("f"))
    opened = fields.select("article_id", "chunk_idx", (F.col("f.field") == "text").alias("in_text"), F.col("f.len").alias("len"), F.explode("f.terms").alias("term"))
    known = numbers.unionByName(chunks.sparkSession.createDataFrame([(NONE, -1)], numbers.schema))
    held = stored(opened.join(F.broadcast(known), "term").groupBy("article_id", "chunk_idx", "in_text", "len", "tid").agg(F.count("*").alias("tf")), "term-counts")
    stats = held.filter("tid = -1").groupBy("article_id", "in_text").agg(F.sum("tf").alias("chunks"), (F.sum(F.col("len") * F.col("tf")) / F.sum("tf")).alias("avglen"))
    n = held.filter("tid >= 0").groupBy("article_id", "in_text", "tid").agg(F.count("*").alias("n")).join(stats, ["article_id", "in_text"])
    idf = F.log(1 + (F.col("chunks") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    facts = n.select("article_id", "in_text", "tid", (F.when(F.col("in_text"), TEXT_BOOST).otherwise(SECTION_BOOST) * idf).alias("_idf"), "avglen")
    facts = sent(stored(facts, "term-weights"))
    part = F.col("_idf") * (delta + F.col("tf") * (k + 1) / (F.col("tf") + k * (1 - b + b * F.col("len") / F.col("avglen"))))
    weighed = held.filter("tid >= 0").join(facts, ["article_id", "in_text", "tid"]).select("article_id", "chunk_idx", "tid", part.alias("w"))
    return best_scores(weighed, terms, numbers, most)


def fuse(ranked: DataFrame, constant: int = RRF) -> DataFrame:
    """article_id, query_id, chunk_idx, fused, best_rank, place: reciprocal ranks summed over the queries of a question."""
    sums = ranked.groupBy("article_id", "query_id", "chunk_idx").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 12).alias("fused"), F.min("rank").alias("best_rank"))
    order = Window.partitionBy("article_id", "query_id").orderBy(F.desc("fused"), "best_rank", "chunk_idx")
    return sums.withColumn("place", F.row_number().over(order))


def literal_matches(chunks: DataFrame, questions: DataFrame, focus: Column | None = None) -> DataFrame:
    """article_id, query_id, chunk_idx, longest, matches, place: chunks that hold a question's literals; with an article_id, of that article alone.

    Questions of one article meet its chunks by an equal join, and each chunk is tried for the question's own literals.
    """
    literals = questions.select(*_article_of(questions), "query_id", exact_literals(F.col("question"), focus).alias("literals"))
    if not _article_of(questions):
        return matches_of(chunks, literals.select("query_id", F.explode("literals").alias("literal")))
    content = normalize_literal(F.concat("section", F.lit("\n"), "text"))
    own = chunks.select("article_id", "chunk_idx", content.alias("_content")).join(literals.hint("merge"), "article_id")
    # Opened, not filtered: a filter would look for the literals in every chunk once more.
    held = own.select("article_id", "query_id", "chunk_idx", F.explode(F.filter(F.array(F.filter("literals", lambda w: F.contains("_content", w))), lambda h: F.size(h) > 0)).alias("held"))
    return _placed(held.select("article_id", "query_id", "chunk_idx", F.array_max(F.transform("held", lambda w: F.length(w))).alias("longest"), F.size("held").cast("long").alias("matches")))


def containing(chunks: DataFrame, literals: DataFrame, block: int = LITERALS) -> DataFrame:
    """article_id, chunk_idx, literal of all chunks whose section and text (normalised) hold a literal.

    The distinct literals, the small side, are taken in blocks of about `block` and of LITERAL_BYTES, as many blocks as there need to be; one pass of
    an automaton over a chunk finds all literals of a block, so no chunk meets them one by one.
    """
    content = chunks.select("article_id", "chunk_idx", normalize_literal(F.concat("section", F.lit("\n"), "text")).alias("_content"))
    kind = ", ".join(f"{c} {content.schema[c].dataType.simpleString()}" for c in ("article_id", "chunk_idx")) + ", literal array<string>"
    asked = literals.select("literal").distinct()
    number, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("literal")), F.lit(0))).first()
    count = max(-(-number // block), -(-size // LITERAL_BYTES))

    def of_block(given: list[str]) -> DataFrame:
        shared = chunks.sparkSession.sparkContext.broadcast(given)

        def run(parts):
            found = Automaton()
            for w in shared.value:
                found.add_word(w, w)
            found.make_automaton()
            for part in parts:
                for own in (part.slice(at, SLICE) for at in range(0, part.num_rows, SLICE)):
                    held = [sorted({w for _, w in found.iter(t)}) for t in own.column(2).to_pylist()]
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(held, pa.list_(pa.string()))], names=["article_id", "chunk_idx", "literal"])

        return bounded(content).mapInArrow(run, kind)

    out = content.select("article_id", "chunk_idx", F.array().cast("array<string>").alias("literal")).limit(0)
    for k in range(count):
        own = [r["literal"] for r in asked.filter(F.pmod(F.xxhash64("literal"), F.lit(count)) == k).collect()]
        made = of_block(own)
        out = made if k == 0 else out.unionByName(made)
    return out.select("article_id", "chunk_idx", F.explode("literal").alias("literal"))


def matches_of(chunks: DataFrame, literals: DataFrame) -> DataFrame:
    """literal_matches() for literals given as query_id, literal."""
    found = containing(chunks, literals).join(literals, "literal")
    return _placed(found.groupBy("article_id", "query_id", "chunk_idx").agg(F.max(F.length("literal")).alias("longest"), F.count("*").alias("matches")))


def _placed(sums: DataFrame) -> DataFrame:
    order = Window.partitionBy("article_id", "query_id").orderBy(F.desc("longest"), F.desc("matches"), "chunk_idx")
    return sums.withColumn("place", F.row_number().over(order))


def focus_anchors(chunks: DataFrame, foci: DataFrame, most: int = ANCHORS) -> DataFrame:
    """article_id, query_id, chunk_idx, place: the chunk nearest to a focus (query_id, article_id, focus_text, focus_section) and its neighbours.

    Neighbours follow in the order +1, -1, +2, -2, if of the same section or, where the path has three parts, the same parent.
    """
    # What a chunk or a focus has alone is made before they meet; made after, it would be made anew for every pair.
    both = F.concat("section", F.lit("\n"), "text")
    read = chunks.join(foci.select("article_id").distinct(), "article_id", "left_semi")
    own = read.select("article_id", "chunk_idx", "section", token_set(both).alias("_tokens"), token_set(F.col("section")).alias("_section_tokens"), F.regexp_replace(F.lower(both), UNEVEN, " ").alias("_content"))
    asked = foci.select("article_id", "query_id", "focus_section", token_set(F.col("focus_text")).alias("_focus_tokens"), token_set(F.col("focus_section")).alias("_given_tokens"), normalize_literal(F.col("focus_text")).alias("_focus"))
    pairs = own.join(asked, "article_id")
    section, given = F.lower("section"), F.lower(F.trim(F.coalesce("focus_section", F.lit(""))))
    score = (
        overlap_score(F.col("_focus_tokens"), F.col("_tokens"))
        + overlap_score(F.col("_given_tokens"), F.col("_section_tokens")) * 0.5
        + F.when((F.col("_focus") != "") & F.contains("_content", "_focus"), 0.5).otherwise(0.0)
        + F.when((given != "") & (section == given), 0.5).otherwise(0.0)
    )
    exact = (given != "") & (section == given)
    order = Window.partitionBy("article_id", "query_id").orderBy(exact.desc(), F.desc("_score"), "chunk_idx")
    anchor = pairs.withColumn("_score", score).withColumn("_n", F.row_number().over(order)).filter("_n = 1 and _score > 0").select("article_id", "query_id", F.col("chunk_idx").alias("_at"), F.col("section").alias("_section"))
    offsets = F.posexplode(F.array(*[F.lit(x) for x in (0, 1, -1, 2, -2)])).alias("_order", "_offset")
    near = anchor.select("*", offsets).withColumn("chunk_idx", F.col("_at") + F.col("_offset"))
    path = F.split("_section", " > ", -1)
    parent = F.when(F.size(path) >= 3, F.concat(F.array_join(F.slice(path, 1, F.size(path) - 1), " > "), F.lit(" > ")))
    found = near.join(chunks.select("article_id", "chunk_idx", "section"), ["article_id", "chunk_idx"]).filter((F.col("_order") == 0) | (F.col("section") == F.col("_section")) | F.coalesce(F.startswith("section", parent), F.lit(False)))
    place = F.row_number().over(Window.partitionBy("article_id", "query_id").orderBy("_order"))
    return found.withColumn("place", place).filter(F.col("place") <= most).select("article_id", "query_id", "chunk_idx", "place")


def section_scope(chunks: DataFrame, foci: DataFrame, most: int = WINDOWS, budget: int | Column = RELEVANT_BUDGET) -> DataFrame:
    """article_id, query_id, chunk_idx: the section in focus and those below it, in order, up to the limit and the budget.

    foci: article_id, query_id, focus_section, heading_level; level 1 takes the whole article. budget may be a column of foci.
    """
    given = F.lower(F.trim("focus_section"))
    inside = (F.col("heading_level") == 1) | (F.lower("section") == given) | F.startswith(F.lower("section"), F.concat(given, F.lit(" > ")))
    held = chunks.join(foci.filter(F.coalesce(given, F.lit("")) != ""), "article_id").filter(F.coalesce(inside, F.lit(False)))
    order = Window.partitionBy("article_id", "query_id").orderBy("chunk_idx")
    used = F.sum(F.length("section") + F.length("text") + 3).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn("_used", used).withColumn("_n", F.row_number().over(order)).filter((F.col("_used") <= budget) & (F.col("_n") <= most)).select("article_id", "query_id", "chunk_idx")


def neighbours(chunks: DataFrame) -> DataFrame:
    """article_id, chunk_idx, before, after: the next chunks on either side, if of the same section."""
    order = Window.partitionBy("article_id").orderBy("chunk_idx")
    same = lambda f: F.when(f("section").over(order) == F.col("section"), f("chunk_idx").over(order))
    return chunks.select("article_id", "chunk_idx", same(F.lag).alias("before"), same(F.lead).alias("after"))


def coverage_groups(chunks: DataFrame) -> DataFrame:
    """article_id, chunk_idx, group_key: the first part of the section path, or the first two if all share the first."""
    path = F.filter(F.transform(F.split("section", " > ", -1), lambda p: F.trim(p)), lambda p: p != "")
    parts = chunks.select("article_id", "chunk_idx", "section", path.alias("_path")).withColumn("_first", F.coalesce(F.get("_path", F.lit(0)), F.lit("Article")))
    whole = parts.groupBy("article_id").agg((F.min("_first") == F.max("_first")).alias("_one"), F.max(F.size("_path")).alias("_deep"))
    second = F.array_join(F.slice("_path", 1, 2), " > ")
    key = F.when(F.col("_one") & (F.col("_deep") > 1), F.when(second != "", second).otherwise(F.col("section"))).otherwise(F.coalesce(F.get("_path", F.lit(0)), F.col("section")))
    return parts.join(whole, "article_id").select("article_id", "chunk_idx", key.alias("group_key"))
