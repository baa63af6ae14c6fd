import random
import zlib

import numpy as np
import pyarrow as pa

import corpus_pipeline
from lectern.llm import lexical, mixing, quality, queries, toxicity
from lectern.llm.lexical import train_softmax

DOC, LABELS = "doc_id long, text string, lang string, source string", "doc_id long, quality int, toxic int"


def corpus(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice("alpha beta gamma delta omega sigma kappa theta".split()) + str(rng.randint(0, 40)) for _ in range(rng.randint(5, 60))]
        toxic, junk = rng.random() < 0.2, rng.random() < 0.2
        if toxic:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(["idiot", "vexx" + rng.choice("abcdef"), "moron"]))
        text = " ".join(f"{w}%%%" for w in words) if junk else ". ".join(words)
        rows.append((k, text, "en", f"src{k % 3}"))
        labels.append((k, int(not junk), int(toxic)))
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, LABELS), {k: (q, t) for k, q, t in labels}


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = corpus(spark)
    got = toxicity.train_and_score(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["predicted"] == truth[r["doc_id"]][1] for r in held]) > 0.95
    none = labels.filter("toxic = 0")
    assert {r["predicted"] for r in toxicity.train_and_score(docs, none).collect()} == {0}
    assert toxicity.train_and_score(docs.limit(0), labels).count() == 0
    assert toxicity.train_and_score(docs, labels.limit(0)).count() == docs.count()


def test_label_model_trusts_good_voters():
    rng = np.random.default_rng(0)
    y = rng.random(600) < 0.3
    votes = np.stack([y & (rng.random(600) < 0.9), y & (rng.random(600) < 0.8), ~y & (rng.random(600) < 0.9)], axis=1).astype(np.int8)
    start, given = np.where(np.arange(600) < 100, np.where(y, 0.99, 0.01), 0.3), np.arange(600) < 100
    p = toxicity.LabelModel(votes, start, given).posterior(votes)
    voted = votes.any(axis=1)
    assert ((p > 0.5) == y)[voted].mean() > 0.97


def test_quality_and_its_filter(spark):
    docs, labels, truth = corpus(spark)
    half = labels.filter("doc_id % 2 = 0")
    got = {r["doc_id"]: r for r in quality.score(docs, quality.fit(docs, half)).collect()}
    assert np.mean([got[k]["accepted"] == bool(q) for k, (q, _) in truth.items() if k % 2]) > 0.97
    extra = docs.selectExpr("*", "1 AS quality", "2 AS dense", "3 AS _source").unionByName(spark.createDataFrame([(None, None, None, None)], DOC).selectExpr("*", "1 AS quality", "2 AS dense", "3 AS _source"))
    kept = quality.accepted(extra, half)
    assert kept.columns == extra.columns and kept.filter("doc_id is not null").count() == sum(r["accepted"] for r in got.values())
    assert quality.accepted(docs, labels.limit(0)).count() == docs.count()
    assert quality.accepted(docs.limit(0), labels).count() == 0


def test_mixing_meets_its_targets(spark):
    docs, labels, truth = corpus(spark)
    got = mixing.mix(docs, mixing.label_domains(labels), {"clean": 0.9, "junk": 0.05, "toxic": 0.05}).collect()
    rate = {d: sum(r[f"p_{d}"] * r["n_tokens"] * r["rate"] for r in got) for d in ("clean", "junk", "toxic")}
    there = sum(r["p_clean"] * r["n_tokens"] for r in got)
    for d in ("junk", "toxic"):
        assert abs(rate[d] - there * 0.05 / 0.9) < 0.02 * there
    assert all(r["copies"] == 1 for r in got if truth[r["doc_id"]] == (1, 0))
    assert all(0 <= r["rate"] <= 1 for r in got)
    out = mixing.mixed(docs.selectExpr("*", "1 AS rate", "2 AS copies"), mixing.label_domains(labels), {"clean": 0.9, "junk": 0.05, "toxic": 0.05})
    assert out.count() == sum(r["copies"] for r in got)
    assert mixing.mix(docs.limit(0), mixing.label_domains(labels)).count() == 0
    assert mixing.mix(docs, mixing.label_domains(labels.limit(0))).count() == docs.count()


def test_features_of_a_batch_are_those_of_its_tokens():
    texts = ["Idiot, idiot!! IDIOT", "x" * 40 + " a.b-c_d12 Don't...", "é É ß ẞ 中文 中文字!! ª", "", None, "i.d.i.o.t " + "z" * 300, "the-whole-of-a-very-long-token-" * 20 + "vexxing", "q" + "." * 40]
    names = sorted({f for t in texts for w in (t or "").split() for f in lexical.token_features(w)})
    given = pa.array(["before", *texts, "behind"]).slice(1, len(texts))
    found = lexical.Features(names).of(given)
    for k, t in enumerate(texts):
        assert {names[j] for j in np.flatnonzero(found[k])} == {f for w in (t or "").split() for f in lexical.token_features(w)}
    assert "w:vexxing" in names and "w:idiot" in lexical.token_features("i.d.i.o.t")


def test_softmax_separates():
    rows = [np.array([k % 2, 2 + k % 5]) for k in range(200)]
    target = np.eye(2)[[k % 2 for k in range(200)]]
    w, b = train_softmax(rows, 7, target)
    assert all((w[r].sum(axis=0) + b).argmax() == k % 2 for k, r in enumerate(rows))


def test_pipeline_keeps_columns_and_clean_documents(spark, tmp_path):
    docs, labels, truth = corpus(spark, 200)
    copies = docs.filter("doc_id < 10").selectExpr("doc_id + 1000 AS doc_id", "upper(text) AS text", "lang", "source")
    docs.unionByName(copies).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = read
        out = stage(spark, read, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == read.columns
            out.write.parquet(f"{tmp_path}/stage-{k}")
            read = spark.read.parquet(f"{tmp_path}/stage-{k}")
    kept = {r["doc_id"] for r in out.collect()}
    assert out.count() == before.count() == len(kept)
    clean = {k for k, (q, t) in truth.items() if q and not t}
    assert {k if k >= 10 else k + 1000 for k in clean} <= kept | {k + 1000 for k in range(10)}
    assert not any(k < 10 for k in kept)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_samples_are_bounded_by_rows(spark):
    """A labelled id that many rows share gives one row where all would be too many."""
    docs = spark.createDataFrame([(k % 3 if k < 300 else k, f"text {k:03d}") for k in range(310)], "doc_id long, text string")
    chosen = spark.createDataFrame([(k, 1) for k in [0, 1, 2, *range(300, 310)]], "doc_id long, toxic int")
    found = lexical.sampled(docs, chosen, "doc_id", ["text"], 20)
    assert sorted((r["doc_id"], r["text"], r["toxic"]) for r in found.collect()) == [(0, "text 000", 1), (1, "text 001", 1), (2, "text 002", 1), *((k, f"text {k}", 1) for k in range(300, 310))]
    assert lexical.sampled(docs, chosen.filter("doc_id >= 300"), "doc_id", ["text"], 20).count() == 10
