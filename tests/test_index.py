"""The stored index against a search of the chunks themselves: at first, after deltas, merged, and with blocks passed over."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import index, search

CHUNK = "article_id long, chunk_idx int, section string, text string"


def chunks(spark, seed, ids, articles=2):
    rng = random.Random(seed)
    words = ["common", "often", "alpha", "beta", "gamma", "词语文章"] + [f"w{k}" for k in range(40)]
    row = lambda a, k: (a, k, f"part {k // 7} {rng.choice(words[:4])}", " ".join(rng.choice(words) if rng.random() < 0.6 else "common" for _ in range(rng.randint(0, 30))))
    return spark.createDataFrame([row(a, k) for a in range(articles) for k in ids], CHUNK)


def asked(spark, bound=False):
    texts = ["alpha beta w3", "common", "rare w7 w8 often", "词语 文章", "nothing here zzz", "", "common often gamma w1 w2"]
    rows = [(k, 0, t) for k, t in enumerate(texts)]
    return spark.createDataFrame([(k % 2, *r) for k, r in enumerate(rows)] if bound else rows, ("article_id long, " if bound else "") + "query_id long, pos int, text string")


def plain(rows):
    return sorted((r["article_id"], r["query_id"], r["pos"], r["chunk_idx"], r["matched"], round(r["score"], 6), r["rank"]) for r in rows.collect())


@pytest.mark.parametrize("bound", [False, True])
def test_search_of_the_index_is_that_of_the_chunks(spark, tmp_path, bound):
    first, queries = chunks(spark, 1, range(60)), asked(spark, bound)
    path = f"{tmp_path}/index"
    index.add(path, "a", first, block=8)
    found = lambda p: plain(index.Search(spark, p, queries, 5, block=8).best())
    assert found(path) == plain(search.bm25(first, queries, 5)) != []
    # Some chunks go, some get another text, some are new; then the batch runs again
    other = chunks(spark, 2, range(50, 80))
    gone = first.filter((F.col("chunk_idx") % 5 == 0) | (F.col("chunk_idx") >= 50))
    now = first.join(gone.select("article_id", "chunk_idx"), ["article_id", "chunk_idx"], "left_anti").select(*first.columns).unionByName(other)
    for _ in range(2):
        index.add(path, "b", other, gone, block=8)
    want = plain(search.bm25(now, queries, 5))
    assert found(path) == want
    index.merge(spark, path, f"{tmp_path}/merged", block=8)
    assert found(f"{tmp_path}/merged") == want
    assert spark.read.parquet(f"{tmp_path}/merged/postings").filter("n <= 0").count() == 0


def test_rare_queries_read_little(spark, tmp_path):
    rng = random.Random(3)
    rows = [(0, k, "s", " ".join(["common"] * rng.randint(1, 2) + [f"w{rng.randint(0, 400)}" for _ in range(12)] + ["quartz", "gneiss"] * (k in (70, 71, 900, 1500)))) for k in range(2000)]
    held = spark.createDataFrame(rows, CHUNK)
    queries = spark.createDataFrame([(0, 0, "quartz gneiss"), (1, 0, "common quartz gneiss"), (2, 0, "common")], "query_id long, pos int, text string")
    index.add(f"{tmp_path}/index", "a", held, block=16)
    made = index.Search(spark, f"{tmp_path}/index", queries, 3, block=16)
    assert plain(made.best()) == plain(search.bm25(held, queries, 3))
    reads = {r["query_id"]: r for r in made.reads().collect()}
    assert reads[1]["postings"] > 2000 and reads[1]["postings_read"] < reads[1]["postings"] / 10 and reads[0]["blocks_read"] == reads[0]["blocks"] == 3


def test_empty(spark, tmp_path):
    none = chunks(spark, 1, range(3)).limit(0)
    index.add(f"{tmp_path}/index", "a", chunks(spark, 1, range(3)), none)
    assert index.Search(spark, f"{tmp_path}/index", asked(spark).limit(0)).best().count() == 0


@pytest.mark.parametrize("worth", [0, 10**9])
def test_few_queries_store_no_row_for_each_block_and_query(spark, tmp_path, monkeypatch, worth):
    """Bounds of all blocks for all queries, and a row for each term and block, were stored and dealt out, and filled the disk; with bounds and without, removals and repeated chunks count as in a search of the chunks."""
    monkeypatch.setattr(index, "WORTH", worth, raising=False)
    keep, sizes = index.stored, {}
    monkeypatch.setattr(index, "stored", lambda df, name: (out := keep(df, name), sizes.update({name: out.count()}))[0])
    first, other = chunks(spark, 5, range(80), 1), chunks(spark, 6, range(70, 100), 1)
    again = first.filter("chunk_idx = 3")
    queries = spark.createDataFrame([(q, 0, f"common often alpha w{q}") for q in range(12)], "query_id long, pos int, text string")
    index.add(f"{tmp_path}/index", "a", first.unionByName(again), block=2)
    index.add(f"{tmp_path}/index", "b", other, first.filter("chunk_idx >= 70"), block=2)
    want = search.bm25(first.filter("chunk_idx < 70").unionByName(again).unionByName(other), queries, 3)
    assert plain(index.Search(spark, f"{tmp_path}/index", queries, 3, block=2).best()) == plain(want) != []
    assert max(n for name, n in sizes.items() if name not in ("index-terms", "index-weights")) <= 100
