import random

import numpy as np
import pyarrow as pa

from lectern.llm import class_lm

DOC = "doc_id long, text string"


def corpus(spark, n=600):
    """Words of one shape in two kinds: the first goes between x and y, the second between p and q."""
    rng = random.Random(5)
    names = [f"{a}{b}ow" for a in "bcdfghjklm" for b in "aeiou"]
    one, two = names[:25], names[25:]
    texts = [" ".join(f"x {rng.choice(one)} y" if rng.random() < 0.5 else f"p {rng.choice(two)} q" for _ in range(12)) for _ in range(n)]
    texts += ["rare1 rare2 bare rare1", None, "", "never1 x never2 never3 " * 3]
    return spark.createDataFrame(list(enumerate(texts)), DOC), one, two


def test_words_of_batches_and_their_slices():
    texts = [None, "", " A\tb\x0bÄ\x1cÖ  b", "\n", "x\u00a0Y z", "last"] * 3
    for given in (pa.array(texts), pa.array(texts, pa.large_string()).slice(2, 11), pa.array(texts).slice(5)):
        t = class_lm.Coded(given)
        want = [(x or "").encode().lower().split() + [b""] for x in given.to_pylist()]
        assert [t.words[k] for k in t.at] == [w for ws in want for w in ws] and t.sizes.tolist() == list(map(len, want))


def test_every_word_has_its_own_class(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "UNIT_WORDS", 20)  # some words of either kind; the others share a shape
    docs, one, two = corpus(spark)
    texts = docs.select("text")
    _, vocabulary = class_lm.fit(texts, class_lm.word_counts(texts))
    found = {bytes(r["word"]).decode(): r["class"] for r in vocabulary.collect()}
    counts = {bytes(r["word"]): r["c"] for r in class_lm.word_counts(texts).collect()}
    assert {bytes(r["word"]): r["c"] for r in vocabulary.collect()} == counts
    assert not {found[w] for w in one} & {found[w] for w in two}


def test_words_outside_the_head_score_alike(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "UNIT_WORDS", 5)
    docs, _, _ = corpus(spark, 80)
    got = []
    for head in (1000, 6, 0):
        monkeypatch.setattr(class_lm, "HEAD", head)
        got.append(sorted((r["doc_id"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in class_lm.train_and_score(docs).collect()))
    assert got[0] == got[1] == got[2] and np.isfinite([r[3] for r in got[0]]).all()


def test_scores_are_those_of_a_plain_class_model(spark, monkeypatch):
    """Transitions, emissions and unseen words' share, counted again word by word from the classes that were found."""
    monkeypatch.setattr(class_lm, "UNIT_WORDS", 12)
    monkeypatch.setattr(class_lm, "HEAD", 15)
    docs, _, _ = corpus(spark, 120)
    docs = docs.unionAll(docs.filter("doc_id < 5")).unionAll(spark.createDataFrame([(None, "x y"), (9001, "P  q\tunheard\nwords")], DOC)).selectExpr("*", "1 AS score", "2 AS word", "3 AS _row")
    texts = docs.filter(~class_lm.held_out("doc_id")).select("text")
    counted = class_lm.stored(class_lm.word_counts(texts), "words")
    model, vocabulary = class_lm.fit(texts, counted)
    found = {bytes(r["word"]): (r["c"], r["class"]) for r in vocabulary.collect()}
    size, split = model.size, lambda t: (t or "").encode().lower().split() + [b""]
    unseen = lambda w: int(model.own[model.units.of(pa.array([w], pa.large_binary()))[0][0]])
    cls = lambda w: found[w][1] if w in found else unseen(w)
    grid, tokens, types = np.zeros((size, size)), np.zeros(size), np.zeros(size)
    for c, k in found.values():
        tokens[k] += c
        types[k] += 1
    for r in texts.collect():
        before = 0
        for w in split(r["text"]):
            grid[before, cls(w)] += 1
            before = cls(w)
    once, twice = (sum(c == n for c, _ in found.values()) for n in (1, 2))
    discount = min(max(once / (once + 2 * twice), 0.1), 0.95)
    share = (grid.sum(axis=0) + 1) / (grid.sum() + size)
    want = []
    for r in docs.collect():
        total, before = 0.0, 0
        for w in split(r["text"]):
            k = cls(w)
            total += np.log10((grid[before, k] + class_lm.TRANSITION_WEIGHT * share[k]) / (grid[before].sum() + class_lm.TRANSITION_WEIGHT))
            total += np.log10((found[w][0] - discount if w in found else discount * types[k]) / tokens[k])
            before = k
        want.append((str(r["doc_id"]), round(total, 6)))
    got = [(str(r["doc_id"]), round(r["score"], 6)) for r in class_lm.score(docs, model, vocabulary).collect()]
    assert sorted(got) == sorted(want)


def test_inputs_that_are_no_tables_keep_their_rows(spark):
    """Rows are numbered once, in whatever partitions a shuffle deals them out."""
    docs, _, _ = corpus(spark, 200)
    held = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2k")
    try:
        got = class_lm.train_and_score(docs.repartition(9, "doc_id")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", held)
    want = {r["doc_id"]: len((r["text"] or "").split()) + 1 for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want and len(got) == len(want)
