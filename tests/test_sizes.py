"""What is sent to the driver, held by a task or written is bounded, whatever the number of rows."""

import gc
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.functions.dom import Element
from lectern.operators import context, extract, index, scores, search
from lectern.plans import catalogue
from lectern.sources import batches

SMALLEST = "/root/testdata/sf0.001"


def test_questions_of_all_documents_are_not_stored(spark, monkeypatch):
    """A file of repeated questions is a hundredth of its rows, so Spark would send it to every task by way of the driver."""
    kept, real = [], catalogue.stored
    monkeypatch.setattr(catalogue, "stored", lambda df, name: kept.append(df.columns) or real(df, name))
    made = catalogue.queries()["evidence_pack"](spark, SMALLEST)
    assert kept and not any("question" in columns for columns in kept)
    assert made.count() > 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_page_leaves_nothing_to_the_collector():
    gc.collect()
    gc.disable()
    try:
        extract.extract_article("<article><h1>T</h1>" + "<p>some words of a page</p>" * 50 + "</article>", "https://example.com/")
        assert not any(isinstance(x, Element) for x in gc.get_objects())
    finally:
        gc.enable()


@pytest.mark.parametrize("name", ["page_diagnostics", "page_blocks", "exact_match_rank"])
def test_texts_go_to_python_in_small_batches(spark, name):
    spark.conf.set(batches.SETTING, "10000")
    catalogue.queries()[name](spark, SMALLEST)
    assert int(spark.conf.get(batches.SETTING)) <= batches.ROWS


@pytest.mark.parametrize("name", ["chunks", "chunk_bounds", "document_coverage"])
def test_no_data_frame_is_made_for_each_article(spark, name):
    plan = _plan(catalogue.queries()[name](spark, SMALLEST))
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan


def test_runs_go_on_across_batches():
    parts = [pa.RecordBatch.from_pydict({"k": k, "x": x}) for k, x in (([1, 1], [1, 2]), ([], []), ([1, 2], [3, 4]), ([2, None], [5, 6]), ([None], [7]))]
    assert list(batches.runs(parts, 1)) == [[(1, 1), (1, 2), (1, 3)], [(2, 4), (2, 5)], [(None, 6), (None, 7)]]


def test_few_queries_are_scored_by_blocks_as_by_joins(spark, monkeypatch):
    """No row is made for each chunk and query: these grow with their product, and filled a task's memory."""
    rng = random.Random(5)
    word = lambda: rng.choice(["common"] * 6 + [f"w{rng.randint(0, 40)}" for _ in range(6)])
    chunks = [(a, c, rng.choice(["Sec one", "w1 w2", ""]), " ".join(word() for _ in range(rng.randint(0, 12)))) for a in ("x", "y", None) for c in range(90)]
    chunks += [("x", 3, "w1", "w1 w1 common again"), ("y", None, "w2", "w1 w2 w3"), ("y", None, "w2", "common w2")]
    held = spark.createDataFrame(chunks, "article_id string, chunk_idx long, section string, text string").repartition(3)
    asked = spark.createDataFrame([(q, p, " ".join(word() for _ in range(rng.randint(0, 5)))) for q in range(9) for p in (0, 1)], "query_id long, pos int, text string")
    got = lambda: sorted(map(tuple, search.bm25(held, asked, 4).select("article_id", "query_id", "pos", "chunk_idx", "matched", "score", "rank").collect()), key=str)
    monkeypatch.setattr(scores, "CELLS", 200)
    monkeypatch.setattr(scores, "SUMS", 30)
    blocks = got()
    assert "MapInArrow" in _plan(search.bm25(held, asked, 4))
    monkeypatch.setattr(search, "SMALL_BYTES", -1)
    assert "MapInArrow" not in _plan(search.bm25(held, asked, 4)) and blocks == got() != []


def test_an_index_stores_the_best_scores_of_few_queries_alone(spark, tmp_path, monkeypatch):
    """Stored scores of all chunks for all queries grow with their product, and filled the disk."""
    rng = random.Random(3)
    chunks = [("x", c, "s", " ".join(rng.choice(["common", "also", "w%d" % rng.randint(0, 9)]) for _ in range(8))) for c in range(120)]
    held = spark.createDataFrame(chunks, "article_id string, chunk_idx long, section string, text string")
    asked = spark.createDataFrame([(q, 0, f"common also w{q}") for q in range(4)], "query_id long, pos int, text string")
    index.add(str(tmp_path), "one", held, block=8)
    made = index.Search(spark, str(tmp_path), asked, 3, block=8)
    got = lambda df: sorted(map(tuple, df.select("query_id", "chunk_idx", "matched", "score", "rank").collect()))
    few = got(made.best())
    assert made.early.count() <= 4 * 3 * 4 and few == got(search.bm25(held, asked, 3)) != []
    monkeypatch.setattr(index, "SMALL_BYTES", -1)
    assert few == got(index.Search(spark, str(tmp_path), asked, 3, block=8).best())


def test_chunks_are_read_once_for_the_queries_of_their_article(spark, monkeypatch):
    """Terms of all chunks, made three times and dealt out one by one, took most of the time; repeated chunks and queries count as they do by joins."""
    rng = random.Random(7)
    word = lambda: rng.choice(["common"] * 3 + [f"w{rng.randint(0, 12)}" for _ in range(6)])
    rows = [(a, c, rng.choice(["Sec one", "w1 w2", ""]), " ".join(word() for _ in range(rng.randint(0, 12)))) for a in range(5) for c in range(30)]
    rows += [(0, 3, "w1", "w1 w1 common again"), (0, 4, *rows[4][2:]), (None, 1, "w1", "w1 w2"), (9, 0, "w1", "w1 w2")]
    chunks = spark.createDataFrame(rows, "article_id long, chunk_idx int, section string, text string").repartition(3)
    asked = [(a, q, p, " ".join(word() for _ in range(rng.randint(0, 5)))) for a in range(6) for q in range(2) for p in (0, 1)]
    asked += [asked[0], (1, 7, 0, "w3 w4 common"), (1, 7, 0, "w3 w4 common"), (None, 0, 0, "w1"), (2, 8, 0, None)]
    queries = spark.createDataFrame(asked, "article_id long, query_id long, pos int, text string")
    seen = spark.sparkContext.accumulator(0)
    words = F.udf(lambda t: seen.add(1) or (t or "").split(), "array<string>")
    columns = ("article_id", "query_id", "pos", "chunk_idx", "matched", "score", "rank")
    got = sorted(map(tuple, search.bm25(chunks, queries, 4, tokenizer=words).select(*columns).collect()))
    assert seen.value <= 2 * len(rows) + len(asked)
    monkeypatch.setattr(search, "SMALL_BYTES", -1)
    plain = lambda a: search.bm25(chunks.filter(F.col("article_id") == a), queries.filter(F.col("article_id") == a).drop("article_id"), 4, tokenizer=lambda t: F.filter(F.split(F.coalesce(t, F.lit("")), " "), lambda w: w != ""))
    assert got == sorted(tuple(r) for a in range(6) for r in plain(a).select(*columns).collect()) != []


def test_white_space_is_collapsed_but_for_lone_blanks(spark):
    given = ["", " ", "a b", " a  b ", "a\tb", "a \t b ", "　\n", "﻿a   b c  ", None, "a\u0085b", "​"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(given)], "k int, t string").orderBy("k")
    old = F.trim(F.regexp_replace(F.coalesce("t", F.lit("")), text.SPACE, " "))
    for want, got, solid in rows.select(old, text.clean(F.col("t")), F.coalesce(F.col("t"), F.lit("")).rlike(text.SOLID)).collect():
        assert got == want and solid == (want != "")


def test_literals_and_plans_are_read_once(spark, monkeypatch):
    """Named in several places of an expression, they were made anew for each place, and for each literal of a question."""
    found = _plan(spark.createDataFrame([("say `a` and b-c",)], "q string").select(text.exact_literals(F.col("q")).alias("x")))
    assert found.count("regexp_extract_all") <= 2 * (len(text.QUOTED) + 1)
    kept, real = {}, context.stored
    monkeypatch.setattr(context, "stored", lambda df, name: kept.setdefault(name, _plan(df)) and real(df, name))
    made = catalogue.queries()["question_context"](spark, SMALLEST)
    assert [name for name, plan in {**kept, "": _plan(made)}.items() if "$.evidenceNeeds" in plan] == ["asked"]


def test_anchors_are_looked_for_in_their_articles_alone(spark, monkeypatch):
    """Tokens of all chunks were made, though few articles have a focus."""
    seen = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(search, "token_set", F.udf(lambda t: seen.add(1) or (t or "").split(), "array<string>"))
    chunks = spark.createDataFrame([(a, c, "s", f"word{c} some") for a in range(50) for c in range(4)], "article_id long, chunk_idx int, section string, text string")
    foci = spark.createDataFrame([(3, 0, "word2", None)], "article_id long, query_id long, focus_text string, focus_section string")
    got = search.focus_anchors(chunks, foci).orderBy("place").collect()
    assert [(r["article_id"], r["chunk_idx"]) for r in got] == [(3, 2), (3, 3), (3, 1)] and seen.value < 50
