"""The best chunks for each of a few queries, from weighed terms, without a row for each chunk and query.

Rows of chunks come in sorted parts that Spark deals out by chunk. A task adds the weights of a block of chunks into one table of chunks by
queries of bounded size, and puts out only those scores that reach the last wanted one of what it has seen of an article.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.batches import bounded, runs_of_batches

#: Scores that a task holds at a time, and sums that it makes at a time.
CELLS, SUMS = 1 << 21, 1 << 20
#: What rounding to nine digits may change in a comparison.
SLACK = 1e-8


class Held(NamedTuple):
    """Chunks, those of an article in a row, and their weighed terms: the terms of chunk k are at starts[k] to starts[k + 1], sorted by tid."""

    articles: pa.Array
    chunks: pa.Array
    starts: np.ndarray
    tid: np.ndarray
    w: np.ndarray


Opened = Callable[[pa.RecordBatch], Held]


def numbered_terms(terms: DataFrame) -> DataFrame:
    """term, tid of the distinct terms of a small table, to be sent to every task."""
    words = sorted({r["term"] for r in terms.select("term").distinct().collect()})
    return F.broadcast(terms.sparkSession.createDataFrame(list(zip(words, range(len(words)), strict=True)), "term string, tid int"))


def _shared(terms: DataFrame, numbers: DataFrame) -> tuple:
    """The queries (query_id, pos, wanted) of a small table, and for every task: the queries of each term, and how many terms a query needs."""
    asked = terms.join(numbers, "term").select("query_id", "pos", "_wanted", "tid").collect()
    queries = list(dict.fromkeys((r["query_id"], r["pos"], r["_wanted"]) for r in asked))
    at = {q: k for k, q in enumerate(queries)}
    order = sorted((r["tid"], at[r["query_id"], r["pos"], r["_wanted"]]) for r in asked)
    tids = np.array([t for t, _ in order], np.int64)
    begin = np.searchsorted(tids, np.arange(tids.max(initial=-1) + 2))
    return queries, terms.sparkSession.sparkContext.broadcast((begin, np.array([q for _, q in order], np.int64), np.array([2 if w >= 3 else 1 for *_, w in queries])))


def _weighed(part: pa.RecordBatch) -> Held:
    """Sorted rows article_id, chunk_idx, tid, w."""
    code, chunk = (part.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in (0, 1))
    tid, w = (part.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
    at = np.flatnonzero(np.r_[True, (chunk[1:] != chunk[:-1]) | (code[1:] != code[:-1])])
    return Held(part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), np.append(at, len(tid)), tid, w)


def _tables(held: Held, begin: np.ndarray, of_term: np.ndarray, need: np.ndarray) -> Iterator[tuple]:
    """The article, first and end of a block of its chunks, matched terms and scores (-inf if too few match) of these chunks for all queries."""
    articles, _, starts, tid, w = held
    if not len(articles):
        return
    width, article = len(need), articles.dictionary_encode()
    code = article.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    new = np.zeros(len(tid), bool)
    new[starts[:-1]] = True
    first = new | np.r_[True, tid[1:] != tid[:-1]]
    cuts = np.flatnonzero(np.r_[True, np.diff(code) != 0, True])  # where articles begin, in chunks
    rows = max(1, CELLS // max(1, width))
    for a, b in ((x, min(x + rows, e)) for s, e in zip(cuts[:-1], cuts[1:], strict=True) for x in range(s, e, rows)):
        score, matched = np.zeros((b - a, width)), np.zeros((b - a, width), np.int64)
        fan = np.cumsum(begin[tid[starts[a] : starts[b]] + 1] - begin[tid[starts[a] : starts[b]]])
        done = a
        while done < b:  # as many chunks as SUMS allows, one at least
            base = fan[starts[done] - starts[a] - 1] if done > a else 0
            upto = starts[a] + np.searchsorted(fan, base + SUMS, "right")
            end = min(b, max(done + 1, int(np.searchsorted(starts, upto, "right")) - 1))
            own = slice(starts[done], starts[end])
            row = np.cumsum(new[own]) - 1
            count = begin[tid[own] + 1] - begin[tid[own]]
            rep = np.repeat(np.arange(len(row)), count)
            query = of_term[np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[tid[own]], count)]
            cell = row[rep] * width + query
            score[done - a : end - a] = np.bincount(cell, w[own][rep], (end - done) * width).reshape(-1, width)
            matched[done - a : end - a] = np.bincount(cell[first[own][rep]], minlength=(end - done) * width).reshape(-1, width)
            done = end
        score[matched < need] = -np.inf
        yield article.dictionary[int(code[a])].as_py() if code[a] >= 0 else None, a, b, matched, score


def _dealt(df: DataFrame, terms: DataFrame, queries: list[tuple]) -> DataFrame:
    spark, schema = df.sparkSession, terms.schema
    numbered = F.broadcast(spark.createDataFrame([(k, *q[:2]) for k, q in enumerate(queries)], f"_q int, query_id {schema['query_id'].dataType.simpleString()}, pos {schema['pos'].dataType.simpleString()}"))
    return df.join(numbered, "_q")


def best_scores(weighed: DataFrame, terms: DataFrame, numbers: DataFrame, most: int, opened: Opened | None = None) -> DataFrame:
    """article_id, query_id, pos, chunk_idx, matched, score (to nine digits): of every article at least the best chunks for every query, and all that tie with them.

    weighed: article_id, chunk_idx, tid, w; of equal ones the weights add up. terms: query_id, pos, _wanted, term, a small table. numbers: numbered_terms().
    With opened, weighed has other rows (first article_id, then the block or chunk as a long), no chunk in two of them, that it opens in the task.
    """
    queries, shared = _shared(terms, numbers)
    kinds = ", ".join(f"{c} {weighed.schema[k].dataType.simpleString()}" for k, c in enumerate(("article_id", "chunk_idx"))) + ", _q int, matched long, score double"

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, of_term, need = shared.value
        width, floors = len(need), {}
        for held in map(opened, parts) if opened else map(_weighed, runs_of_batches(parts, 2)):
            for key, a, b, matched, score in _tables(held, begin, of_term, need):
                floor = floors.get(key, np.full(width, -np.inf))
                if b - a >= most:
                    floor = np.maximum(floor, np.partition(score, b - a - most, axis=0)[b - a - most])
                    floors[key] = floor
                    if len(floors) * width > CELLS:
                        floors.pop(next(iter(floors)))
                r, q = np.nonzero((score >= floor - SLACK) & (score > -np.inf))
                if len(r):
                    at = pa.array(a + r)
                    yield pa.RecordBatch.from_arrays([held.articles.take(at), held.chunks.take(at), pa.array(q, pa.int32()), pa.array(matched[r, q]), pa.array(score[r, q])], names=["article_id", "chunk_idx", "_q", "matched", "score"])

    given = bounded(weighed) if opened else weighed.select("article_id", "chunk_idx", "tid", "w").repartition("article_id", "chunk_idx").sortWithinPartitions("article_id", "chunk_idx", "tid")
    return _dealt(given.mapInArrow(run, kinds), terms, queries).select("article_id", "query_id", "pos", "chunk_idx", "matched", F.round("score", 9).alias("score"))


def reaching(rows: DataFrame, terms: DataFrame, numbers: DataFrame, least: DataFrame, opened: Opened, each: bool) -> DataFrame:
    """Of what best_scores() would score those that reach the least score (article_id, query_id, pos, _least, a small table) of a query, or any if it has none.

    article_id, block, and if each, query_id and pos of every query that it reaches; else a block is a row, whatever the number of queries.
    """
    queries, shared = _shared(terms, numbers)
    at = {q[:2]: k for k, q in enumerate(queries)}
    floors: dict = {}
    for r in least.select("article_id", "query_id", "pos", "_least").collect():
        floors.setdefault(r["article_id"], np.full(len(queries), -np.inf))[at[r["query_id"], r["pos"]]] = r["_least"]
    limits = rows.sparkSession.sparkContext.broadcast(floors)

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, of_term, need = shared.value
        for held in map(opened, parts):
            for key, a, _, _, score in _tables(held, begin, of_term, need):
                good = (score >= limits.value.get(key, -np.inf)) & (score > -np.inf)
                r, q = np.nonzero(good) if each else (np.flatnonzero(good.any(axis=1)), None)
                if len(r):
                    at = pa.array(a + r)
                    yield pa.RecordBatch.from_arrays([held.articles.take(at), held.chunks.take(at)] + ([pa.array(q, pa.int32())] if each else []), names=["article_id", "block"] + ["_q"] * each)

    found = bounded(rows).mapInArrow(run, f"article_id {rows.schema[0].dataType.simpleString()}, block long" + ", _q int" * each)
    return _dealt(found, terms, queries).drop("_q") if each else found
