"""Ranked search against a brute-force version, in both ways of joining, with odd rows."""

import math
import random
import re
from collections import Counter

import pytest

from lectern.llm import ranked_search

ITEMS = [(1, "the rare quartz of the cave"), (2, "THE the common word"), (3, ""), (4, None), (5, "ünïcode, é! 漢字 x1-y2"), (6, "nothing-has-this zzzzz"), (7, "common"), (7, "rare"), (None, "cave")]


def rows(seed=1, n=150):
    rng = random.Random(seed)
    words = ["the", "common", "word", "rare", "quartz", "cave", "Ünïcode", "ünïcode", "漢字", "x1", "y2", "of"] + [f"w{k}" for k in range(60)]
    made = [(k, " ".join(rng.choice(words) if rng.random() < 0.5 else rng.choice(words[:3]) for _ in range(rng.randint(0, 60))) + rng.choice(["", ".", "\x7f\x00 É"])) for k in range(n)]
    return made + [(200, None), (201, ""), (202, "... --- \n"), (203, "the cave " * 20_000), (204, made[3][1]), (204, made[3][1]), (None, "rare quartz cave"), (205, "rare quartz cave"), (3, "another under the same id: quartz")]


def plain(docs, items, top=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(key, terms(t)) for key, t in docs]
    n_docs, length = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df = Counter(w for _, ws in held for w in set(ws))
    asked = {}
    for item, t in items:
        asked.setdefault(item, set()).update(terms(t))
    out = {}
    for item, wanted in asked.items():
        scored = []
        for key, ws in held:
            tf, m = Counter(ws), 10 + 90 * len(ws) * n_docs // max(1, length)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m)) for w in wanted if tf[w])
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out[item] = [(k + 1, key, -s) for k, (s, _, _, key) in enumerate(sorted(scored)[:top])]
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("small", [ranked_search.SMALL_BYTES, 0])
def test_search_is_the_plain_one(spark, small):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").repartition(5).selectExpr("*", "1 AS _n", "2 AS score", "3 AS rank", "4 AS _term")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS _item", "2 AS doc_id")
    got = {}
    for r in ranked_search.search(docs, items, small=small).orderBy("item_id", "rank").collect():
        got.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    want = plain(rows(), ITEMS)
    assert got == want and {1, 2, 5, 7, None} <= want.keys() and not {3, 4, 6} & want.keys()


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(rows(), "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.search(docs.limit(0), items).count() == 0 and ranked_search.search(docs, items.limit(0)).count() == 0


def test_few_items_shuffle_no_sums(spark):
    """As long as the items' terms are few, documents' sums are made without a shuffle of their own."""
    docs, items = spark.createDataFrame(rows(), "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = ranked_search.search(docs, items)._jdf.queryExecution().sparkPlan().toString()
    full = ranked_search.search(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and full.count("Exchange hashpartitioning") == 2
