"""The filter audit against filters applied one after another, with odd rows."""

import random
import re
from itertools import permutations

from lectern.llm import filter_audit

LABELS = [(k, k % 2, int(k % 7 == 0)) for k in range(0, 120, 2)] + [(4, 0, 1), (6, None, None), (None, 1, 1), (500, 1, 1)]


def rows(seed=2):
    rng = random.Random(seed)
    made = []
    for k in range(140):
        words = [rng.choice(["lorem", "ipsum", "Dolor", "SIT", "amet"]) + (str(rng.randint(0, 500)) if rng.random() < 0.9 else "") for _ in range(rng.choice([5, 99, 100, 101, 180]))]
        made.append((k, rng.choice([" ", "\n", " \t "]).join(words) + rng.choice(["", "", " & co", " #1"]), rng.choice(["en", "de", None, ""])))
    made += [(200 + k, made[k][1], "en") for k in range(40)] + [(1000 - k, "the same text " * 3, "fr") for k in range(60)]
    return made + [(300, None, "en"), (301, "", "de"), (302, None, None), (7, made[7][1], "de"), (7, made[7][1], made[7][2]), (None, made[3][1], "en"), (None, None, None), (303, "É x " * 30_000, "xx"), (3, "another under the same id", "en")]


def plain(docs, labels):
    body = {}
    for key, text, _ in docs:
        if key is not None:
            body[text or ""] = min(body.get(text or "", key), key)
    good, toxic = {k for k, q, _ in labels if q == 1 and k is not None}, {k for k, _, t in labels if t == 1 and k is not None}
    parts = {}
    for key, text, part in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": key is not None and body[t] < key}
        parts.setdefault(part or "", []).append((key, {f for f in fails if fails[f]}))
    out = {}
    for part, held in parts.items():
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = held
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                total[f] += len(gone)
                failing = sum(f in x[1] for x in held)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(x[1] == {f} for x in held), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), f]
        for (p, _, _), row in out.items():
            if p == part:
                row[-1] = total[row[-1]] if row[-1] in total else row[-1]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_is_the_plain_one(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string").repartition(4).selectExpr("*", "1 AS _mask", "2 AS part", "3 AS quality", "4 AS kept")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS lang", "1 AS _good")
    got = filter_audit.audit(docs, labels).collect()
    own = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in got}
    assert own == plain(rows(), LABELS) and len(got) == len(own) == 600 * len({(p or "") for _, _, p in rows()})
    assert {dict(filter_audit.audit(docs, labels).dtypes)[c] for c in ("kept", "removed", "shapley")} == {"bigint"}


def test_no_rows(spark):
    docs, labels = spark.createDataFrame(rows(), "doc_id long, text string, lang string"), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum"}).first() == (0, 0)


def test_shapley_adds_up(spark):
    """An order's filters remove together what their Shapley values sum to."""
    docs, labels = spark.createDataFrame(rows(), "doc_id long, text string, lang string"), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    sums = filter_audit.audit(docs, labels).groupBy("part", "filter_order").agg({"removed": "sum", "shapley": "sum"}).collect()
    assert all(120 * r["sum(removed)"] == r["sum(shapley)"] for r in sums)
