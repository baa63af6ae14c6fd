import corpus_pipeline


def test_near_copies_are_told_by_five_words(spark):
    words = [f"word{k}" for k in range(100)]
    changed = [f"other{k}" if k % 20 == 10 else w for k, w in enumerate(words)]  # two-word likeness 0.82, five-word 0.6
    near = ["last" if k == 99 else w for k, w in enumerate(words)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate((words, changed, near))], "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert len(kept) == 2 and 1 in kept
