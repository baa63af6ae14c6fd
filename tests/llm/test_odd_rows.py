"""Nulls, ties, repeated rows, clashing names, long and empty texts, for the operators whose own tests don't have them."""

import random

import numpy as np

import corpus_pipeline
from lectern.llm import digest, mixing, quality, toxicity

DOC, LABELS = "doc_id long, text string, lang string, source string", "doc_id long, quality int, toxic int"


def corpus(spark, n=240, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice("alpha beta gamma delta omega sigma".split()) + str(rng.randint(0, 30)) for _ in range(rng.randint(8, 40))]
        toxic, junk = k % 5 == 0, k % 5 == 1
        text = " ".join(f"{w}%%%" for w in words) if junk else ". ".join(words + ["idiot", "moron"] * 2 * toxic)
        rows.append((k, text, "en", f"src{k % 3}"))
        labels.append((k, int(not junk), int(toxic)))
    odd = [(None, None, None, None), (None, "alpha1 beta2", "en", None), (1000, None, None, "src1"), (1001, "", None, None), (1002, "beta1. " * 40_000, "en", "src1"), (3, rows[3][1], "en", "src0"), (3, "another text under the same id", "en", "src0")]
    clash = ["'a' AS score", "1 AS _toxic", "2 AS _good", "3 AS dense", "4 AS p", "5 AS n_tokens", "6 AS copies", "7 AS rate", "8 AS _row", "9 AS _lost", "10 AS kept"]
    return spark.createDataFrame(rows + odd, DOC).selectExpr("*", *clash), spark.createDataFrame([*labels, (3, 0, 1), (None, 1, 1), (4, None, None)], LABELS), len(rows) + len(odd)


def test_toxicity(spark):
    docs, labels, n = corpus(spark)
    got = toxicity.train_and_score(docs, labels).collect()
    assert len(got) == n and all(0 <= r["score"] <= 1 for r in got)
    same = [r["score"] for r in got if r["doc_id"] == 3]
    assert len(same) == 3 and len(set(same)) == 2 and len([r for r in got if r["doc_id"] is None]) == 2
    assert all(not r["held_out"] for r in got if r["doc_id"] is None) and all(r["predicted"] == 0 for r in got if r["doc_id"] in (1000, 1001, 1002))


def test_quality(spark):
    docs, labels, n = corpus(spark)
    scorer = quality.fit(docs, labels)
    assert quality.score(docs, scorer).count() == n
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id % 5 = 1 and doc_id < 240").count() == 0 and kept.filter("doc_id % 5 = 2 and doc_id < 240").count() == 48


def test_mixing(spark):
    docs, labels, n = corpus(spark)
    domains = mixing.label_domains(labels)
    got = mixing.mix(docs, domains).collect()
    assert len(got) == n and all(r["n_tokens"] == 0 for r in got if r["doc_id"] in (1000, 1001)) and [r["n_tokens"] for r in got if r["doc_id"] == 1002] == [40_000]
    for r in got:
        assert abs(r["p_clean"] + r["p_junk"] + r["p_toxic"] - 1) < 1e-9 and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1)
    out = mixing.mixed(docs, domains)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)


def plain_fingerprint(raw):
    """The digest, one triplet after another."""
    counts = [0] * digest.BUCKETS
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        counts[((a | b << 8 | c << 16) * 2654435761 & 0xFFFFFFFF) >> 23] += 1
    ordered = sorted(counts)
    cuts = [ordered[len(counts) * k // 4 - 1] for k in (1, 2, 3)]
    codes = [sum(n > q for q in cuts) for n in counts]
    packed = bytes(sum(codes[4 * k + j] << 2 * j for j in range(4)) for k in range(len(codes) // 4))
    return f"{min(255, int(round(4 * np.log2(len(raw) + 1)))):02x}" + packed.hex()


def plain_likeness(a, b):
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    apart = sum(abs((p >> s & 3) - (q >> s & 3)) for p, q in zip(x[1:], y[1:]) for s in (0, 2, 4, 6)) + min(32, abs(x[0] - y[0]))
    return 1 - apart / (12 * (len(x) - 1) + 32)


def test_digests_are_the_plain_ones(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcé \n") for _ in range(rng.randint(0, 400))) for _ in range(25)] + ["", "ab", "same", "same"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS fingerprint", "2 AS _range", "3 AS _key", "4 AS n_chars")
    got = {r["doc_id"]: r for r in digest.fingerprints(docs, parts=3).collect()}
    own = [plain_fingerprint(t.encode()) for t in texts]
    for k, t in enumerate(texts):
        following = texts[(k + 1) % len(texts)]
        changed = plain_fingerprint((t[: len(t) - len(t) // 4] + following[: len(t) // 4]).encode())
        assert (got[k]["fingerprint"], got[k]["edited_fingerprint"]) == (own[k], changed)
        assert abs(got[k]["near_next"] - plain_likeness(own[k], own[(k + 1) % len(texts)])) < 1e-12 and abs(got[k]["near_edited"] - plain_likeness(own[k], changed)) < 1e-12


def test_pipeline(spark, tmp_path):
    """Stage by stage over odd rows, and over no rows: columns stay, one of equal texts stays, and nothing crashes."""
    docs, labels, n = corpus(spark)
    for name, some in (("odd", docs), ("none", docs.limit(0))):
        folder = f"{tmp_path}/{name}"
        some.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        read = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
            f(spark, read, folder).write.parquet(f"{folder}/stage-{k}")
            after = spark.read.parquet(f"{folder}/stage-{k}")
            assert k == len(corpus_pipeline.STAGES) - 1 or after.columns == docs.columns
            if stage == "exact copies":
                low = [(t["text"] or "").encode().lower() for t in read.collect()]
                assert sorted((r["text"] or "").encode().lower() for r in after.collect()) == sorted(set(low))
            if stage == "near copies" and name == "odd":
                assert after.filter("doc_id is null").count() == read.filter("doc_id is null").count() and after.filter("doc_id = 3").count() == read.filter("doc_id = 3").count()
            read = after
        assert read.columns[:3] == ["doc_id", "n_tokens", "ids"] and (name == "odd") == (read.count() > 0)
        assert corpus_pipeline.run(spark, folder).count() == read.count()
