from lectern.plans import catalogue
from lectern.sources import tables


def test_packing_and_anchors_answer_every_question(spark, tmp_path):
    """Every document is asked one question, every question is asked, and the answer is the line with its words."""
    words = "amber basil cedar dune ember fjord grove heron".split()
    text = "\n".join(f"{w} {w}field {w}stone " + f"filler{k} " * 60 for k, w in enumerate(words))
    docs = spark.createDataFrame([(k, text, "en", "web") for k in range(16)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, f"{w} {w}field {w}stone") for k, w in enumerate(words)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    every = {(a, a % len(words)) for a in range(16)}
    for name in ("window_pack", "evidence_pack", "focus_anchor", "select_context"):
        got = catalogue.queries()[name](spark, str(tmp_path)).collect()
        assert {(r["article_id"], r["query_id"]) for r in got} == every, name
    best = {r["article_id"]: r["chunk_id"] for r in catalogue.queries()["window_pack"](spark, str(tmp_path)).filter("rank = 1").collect()}
    for a, found in best.items():
        first, last = (int(x) for x in found.replace("window-chunk-", "").split("-chunk-"))
        assert first <= a % 8 + 1 <= last


def test_questions_with_gaps_in_their_ids(spark):
    """Every document is asked one question, whatever the numbers of the questions."""
    docs = spark.range(30).selectExpr("id AS doc_id")
    benchmark = spark.createDataFrame([(k, f"question {k}") for k in (2, 3, 7, 40, 41, 1000, -5)], "item_id long, text string")
    got = {r["article_id"]: r["query_id"] for r in tables.asked_of(docs, benchmark).collect()}
    assert got == {a: [-5, 2, 3, 7, 40, 41, 1000][a % 7] for a in range(30)}
    assert tables.asked_of(docs, benchmark.limit(0)).count() == 0


def test_queries_of_empty_tables(spark, tmp_path):
    kinds = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "benchmark": "item_id long, text string", "conversations": "conv_id long, turn long, role string, text string", "pages": "page_id long, url string, html string"}
    for name, kind in kinds.items():
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("bm25_topk", "exact_match_rank", "select_context", "question_context", "evidence_pack", "document_coverage", "conversation_archive", "chunks", "outline"):
        assert catalogue.queries()[name](spark, str(tmp_path)).count() == 0, name
