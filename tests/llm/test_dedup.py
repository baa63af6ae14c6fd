import hashlib
import random

import numpy as np

from lectern.llm import radix_dedup, sketch_dedup

DOC = "doc_id long, text string, source string"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "s") for k, t in rows], DOC)


def test_exact_dedup_is_brute_force(spark):
    rng = random.Random(3)
    base = ["", "É stays É", "short", "x" * 64, "x" * 65, "y" * 600 + "tail", "y" * 600 + "TAIL", "z" * 5000]
    rows = [(k, rng.choice(base)) for k in range(40)] + [(100, None), (101, "A" * 64), (102, "a" * 64), (103, "É Stays É"), (104, "é stays é")]
    got = {r["doc_id"]: r for r in radix_dedup.exact_dedup(frame(spark, rows), first=4, widening=4).collect()}
    low = {k: (t or "").encode().lower() for k, t in rows}
    for k, t in low.items():
        same = [j for j, u in low.items() if u == t]
        r = got[k]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(same), len(same), k == max(same), hashlib.sha256(t).hexdigest())


def test_exact_dedup_of_odd_rows(spark):
    assert radix_dedup.exact_dedup(frame(spark, [])).count() == 0
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, None)]
    got = radix_dedup.exact_dedup(frame(spark, rows)).collect()
    assert len(got) == 5 and sum(r["kept"] for r in got) == 3
    clash = frame(spark, rows[:2]).selectExpr("*", "1 AS kept", "2 AS _row", "3 AS _body", "4 AS keep_id")
    kept = radix_dedup.drop_copies(clash)
    assert kept.count() == 1 and kept.columns == clash.columns
    shuffled = frame(spark, [(k, f"text {k % 7}") for k in range(60)]).repartition(5, "doc_id").sample(0.9, 3)
    assert {r["text"] for r in radix_dedup.drop_copies(shuffled).collect()} == {f"text {k}" for k in range(7)} and radix_dedup.drop_copies(shuffled).count() == 7


def brute(rows, percent=80):
    sets = {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        sets[k] = set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()
    link = {k: k for k in sets}

    def top(x):
        while link[x] != x:
            x = link[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                link[y] = x
    return {k: (len(s), top(k)) for k, s in sets.items()}


def test_near_dedup_is_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for _ in range(12):
        text = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(6):
            copy = [rng.choice(words) if rng.random() < 0.04 else w for w in text]
            rows.append((len(rows), " ".join(copy).title() if rng.random() < 0.3 else "\n".join(copy)))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", None, " \n", "one", "ONE", "one one", "one two", "One  two"])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in sketch_dedup.near_dedup(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_buckets_of_several_blocks_are_brute_force(spark, monkeypatch):
    """Many texts share most words, some are linked; block is set against block."""
    monkeypatch.setattr(sketch_dedup, "BLOCK", 5)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(w if rng.random() > (0.15 if k % 3 else 0.02) else f"x{rng.randint(0, 9999)}" for w in base)) for k in range(80)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in sketch_dedup.near_dedup(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_pairs_at_the_limit_are_candidates():
    """Of pairs of similarity 0.80 to 0.82 at least 99 of 100 share a bucket and agree in enough coordinates."""
    rng = random.Random(11)
    met = every = 0
    for k in range(600):
        size = (5, 9, 20, 60, 200)[k % 5]
        texts = [rng.getrandbits(64) for _ in range(size)], [rng.getrandbits(64) for _ in range(size)]
        shared = next(s for s in range(size + 1) if 100 * s >= 80 * (2 * size - s))
        x, y = (np.unique(np.array(t, np.uint64)) for t in (texts[0], texts[0][:shared] + texts[1][shared:]))
        a, b = (sketch_dedup.signature(sketch_dedup.sketch(s)) for s in (x, y))
        assert sketch_dedup.similar(x, y)
        met += (a == b).sum() >= sketch_dedup.LEAST_AGREED and (sketch_dedup.buckets(a) == sketch_dedup.buckets(b)).any()
        every += 1
    assert met >= 0.99 * every


def test_near_dedup_tells_rows_apart(spark):
    rows = [(None, "a b c"), (1, "a b c"), (None, "x y z"), (None, None), (7, "one two three"), (7, "four five six"), (None, "x y z")]
    kept = sorted((str(r["doc_id"]), str(r["text"])) for r in sketch_dedup.drop_near_copies(frame(spark, rows), size=2).collect())
    assert kept == [("1", "a b c"), ("7", "four five six"), ("7", "one two three"), ("None", "None"), ("None", "x y z")]
    near = " ".join(f"w{k}" for k in range(40))
    both = [(None, near), (None, near), (None, near + " end")]
    assert sketch_dedup.drop_near_copies(frame(spark, both), size=2).count() == 1
    assert {r["component_id"] for r in sketch_dedup.near_dedup(frame(spark, both)).collect()} == {None}
    long = [(1, "word " * 60_000), (2, "Word " * 60_000), (3, " ".join(map(str, range(60_000))))]
    assert {r["doc_id"]: r["component_id"] for r in sketch_dedup.near_dedup(frame(spark, long)).collect()} == {1: 1, 2: 1, 3: 3}


def test_near_dedup_of_odd_rows(spark):
    assert sketch_dedup.near_dedup(frame(spark, [])).count() == 0
    clash = frame(spark, [(1, "a b c"), (2, "a b c"), (3, None)]).selectExpr("*", "0 AS component_id", "0 AS kept", "0 AS n", "0 AS id")
    kept = sketch_dedup.drop_near_copies(clash)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3] and kept.columns == clash.columns


def test_sketch_fills_and_estimates():
    rng = random.Random(1)
    words = [f"w{k}" for k in range(5000)]
    text = [rng.choice(words) for _ in range(1000)]
    other = text[:900] + [rng.choice(words) for _ in range(100)]
    a, b = (sketch_dedup.shingles(" ".join(t)) for t in (text, other))
    same = len(set(a) & set(b)) / len(set(a) | set(b))
    x, y = sketch_dedup.sketch(a), sketch_dedup.sketch(b)
    assert abs((x == y).mean() - same) < 0.08
    for n in (1, 2, 3, 50):
        assert (sketch_dedup.sketch(a[:n]) != 2**64 - 1).all()
