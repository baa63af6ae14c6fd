import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lectern.llm import bpe, class_lm, digest, html_templates, pii

DOC = "doc_id long, text string, source string"
ODD = ["", None, " ", "A\nb", "naïve Ünï 𝄞 text", "x" * 3000, "the " * 2000, "123 4567 !!"]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], DOC)


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_the_librarys(spark, library):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("abcdeté -_/%#\n\t\x1c\x85 ") for _ in range(rng.randint(0, 1500))) for _ in range(20)]
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    got = {r["doc_id"]: r for r in bpe.encode(frame(spark, texts), path, pattern, decoded=True).collect()}
    for k, t in enumerate(texts):
        assert np.frombuffer(got[k]["ids"], "<u4").tolist() == library.encode_ordinary(t or "")
        assert bytes(got[k]["decoded"]) == (t or "").encode()
    told = {r["doc_id"]: r for r in bpe.digests(frame(spark, texts), path, pattern).collect()}
    assert told[4]["n_tokens"] == len(library.encode_ordinary(texts[4])) and told[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.digests(frame(spark, []), path, pattern).count() == 0


def test_long_pieces_are_the_librarys(library):
    """Pieces of more bytes than a matrix row holds are merged another way, to the same ids."""
    rng = random.Random(12)
    own = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for k in range(150):
        letters = rng.choice(["ab", "the", "etaoinshrdlu", "aä中é", "=", "-_"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(257, 1400)))
        (ids,) = own.encode_batch([text])
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_ids_of_odd_rows(spark, library):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = spark.createDataFrame([("a", "x y"), ("a", "x y"), (None, None)], "name string, body string").selectExpr("*", "1 AS ids", "2 AS decoded", "3 AS n_tokens")
    got = bpe.digests(rows, path, pattern, "name", "body", ids=True).collect()
    assert sorted((str(r["name"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == [("None", []), ("a", library.encode_ordinary("x y")), ("a", library.encode_ordinary("x y"))]


def test_digests_look_at_the_next_document(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 300))) for _ in range(30)] + ODD
    got = {r["doc_id"]: r for r in digest.fingerprints(frame(spark, texts), parts=4).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        t, following = t or "", texts[(k + 1) % len(texts)] or ""
        cut = len(t) // 4
        changed = t[: len(t) - cut] + following[:cut]
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert got[k]["fingerprint"] == digest.fingerprint(t.encode()) and got[k]["near_next"] == digest.likeness(digest.fingerprint(t.encode()), digest.fingerprint(following.encode()))
        assert 0 <= got[k]["near_edited"] <= 1
    assert digest.fingerprints(frame(spark, [])).count() == 0
    odd = spark.createDataFrame([(None, "n"), (1, "a"), (1, "b"), (1, "b")], "doc_id long, text string")
    assert digest.fingerprints(odd, parts=3).count() == 4
    assert digest.likeness(digest.fingerprint(b"same"), digest.fingerprint(b"same")) == 1.0


def plain_spans(t):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        out += [(2, m.start(), m.end())] if 16 <= len(d) <= 19 and pii.luhn(d) else []
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_are_the_plain_patterns():
    rng = random.Random(6)
    for _ in range(20000):
        t = "".join(rng.choice("01234567890....@@a-+ ()bé") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == plain_spans(t)
    assert pii.base_spans("4111 1111 1111 1111") == [(2, 0, 19)]
    assert pii.base_spans("9" * 50000) == []


def test_tagger_learns_and_keeps_base_spans(spark):
    x, y = pii.made_windows(1500)  # five kinds and their look-alikes
    model = pii.train(x, y)
    path = np.array([pii.viterbi(model, s) for s in pii.emissions(model, x[:200])])
    assert (path == y[:200]).mean() > 0.9
    texts = ["mail a.b@c.de now", "nothing here", None, "", "call +49 30 1234567, ip 10.0.0.1", "long " * 3000 + "x@y.org"]
    got = {r["doc_id"]: r for r in pii.find(frame(spark, texts), model).collect()}
    for k, t in enumerate(texts):
        base = [(pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in got[k]["base"]]
        spans = [(pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in got[k]["spans"]]
        assert base == plain_spans(t or "") and set(base) <= set(spans)
    assert got[1]["spans"] == []


def test_tagger_finds_more_forms_than_the_rules(spark):
    """Trained as a query trains it; on other made windows most are exactly right, and secrets and national numbers are added in texts."""
    rows = ["plain words without anything", "call +49 30 1234567 now", "from 10.0.0.1 to 10.0.0.2", "mail a.b@c.de today"] * 30
    docs = frame(spark, rows)
    x, y = pii.labelled_windows(docs, "text")
    assert len(x) == len({w.tobytes() for w in x}) == 3 and pii.labelled_windows(docs.limit(0), "text")[0].shape == (0, pii.WINDOW)
    model = pii.fit(docs)
    held, tags = pii.made_windows(300, seed=5)
    scores = pii.emissions(model, held)
    assert np.mean([(pii.viterbi(model, scores[k]) == tags[k]).all() for k in range(len(held))]) > 0.85
    key = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"
    texts = [f'some words and then token = "{key}" and more words', "an ordinary sentence about 1987 and 12:30", "x " * 40 + f'token = "{key}" ' + "y " * 40]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find(frame(spark, texts), model).collect()}
    assert got[1] == [] and all(len(got[k]) == 1 and got[k][0][0] == "secret" for k in (0, 2))
    odd = spark.createDataFrame([("a", "mail a.b@c.de"), ("a", "mail a.b@c.de"), (None, None)], "name string, body string").selectExpr("*", "1 AS spans", "2 AS base", "3 AS n_ip")
    told = pii.report(odd, "name", "body").collect()
    assert sorted((str(r["name"]), r["n_email"], r["n_phone"], r["n_spans"], r["n_secret"]) for r in told) == [("None", 0, 0, 0, 0), ("a", 1, 0, 1, 0), ("a", 1, 0, 1, 0)]


def test_language_model_base_is_brute_force(spark):
    rng = random.Random(7)
    one, two = [f"a{k}" for k in range(30)], [f"z{k}" for k in range(30)]
    texts = [" ".join(rng.choice(rng.choice((one, two)) if k % 9 == 0 else (one, two)[k % 2]) for _ in range(40)) for k in range(120)] + ODD[:5] + ["unseen words only"]
    got = {r["doc_id"]: r for r in class_lm.train_and_score(frame(spark, texts)).collect()}
    words = [(t or "").encode().lower().split() + [b""] for t in texts]
    out = [zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))]
    count = Counter(w for k, ws in enumerate(words) if not out[k] for w in ws)
    total, kinds = sum(count.values()), len(count)
    for k, ws in enumerate(words):
        r = got[k]
        base = sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[k], len(ws), sum(count[w] > 0 for w in ws), total)
        assert abs(r["base_score"] - base) < 1e-6 and r["score"] < 0
    held = [k for k in range(120) if out[k]]
    assert sum(got[k]["score"] for k in held) > sum(got[k]["base_score"] for k in held)
    assert class_lm.train_and_score(frame(spark, [])).count() == 0


def test_exchange_finds_classes():
    grid = np.zeros((9, 9))
    for a in range(1, 9):
        for b in range(1, 9):
            grid[a, b] = 100 if (a % 2) == (b % 2) else 1
    own = class_lm.exchange(grid, 3)
    assert own[0] == 0 and len(set(own[1::2])) == 1 and len(set(own[2::2])) == 1 and own[1] != own[2]


def test_main_text(spark):
    page = "<html><body><nav>menu</nav><div class='cookie-notice'>ok</div><article><h1>T &amp; t</h1><p>one <b>bold\n<p>two<br>lines<ul><li>x<li>y</ul><div class=comments><p>first!</p></div></article><footer>f</footer>"
    assert html_templates.main_text(page) == "T & t\none bold\ntwo lines\nx\ny"
    assert html_templates.main_text(None) == html_templates.main_text("") == ""
    bare = "<body><div><ul><li>Home<li>About us</ul></div><div><p>text {} of this page</p></div><div>All rights kept by the site</div></body>"
    rows = [(k, "https://h.example/x", bare.format(k)) for k in range(8)] + [(8, None, None), (9, "https://other.example/", "<p>alone"), (10, "https://h.example/y", bare.format(3))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_templates.extract(pages).collect()}
    assert all(got[k]["text"] == f"text {k} of this page" for k in range(8)) and got[10]["text"] == "text 3 of this page"
    assert got[8]["text"] == "" and got[8]["n_chars"] == 0 and got[9]["text"] == "alone"
    assert html_templates.extract(pages.limit(0)).count() == 0


def site(k, host="h.example", notice="<div><span>Join our club today and win</span></div>", quote=""):
    body = f"<h1>Title {k}</h1><p>First words of page {k}, and more of them so that the article is long enough.</p>{quote}<p>Last words of page number {k} are these, and some more.</p>{notice}"
    return (k, f"https://{host}/p{k}", f"<body><div><a href=/>Start</a></div><div><span>Mind the gap</span></div><article>{body}</article><div>Below all pages</div></body>")


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_counting_decides_what_is_template(spark, monkeypatch):
    """A notice with a neutral name goes from every article, a quoted passage and headings stay; without counts, the notice stays."""
    quote = "<p>This passage is quoted word for word.</p>"
    rows = [site(k, quote=quote if k % 3 == 0 else "") for k in range(12)]
    got = {r["page_id"]: r["text"] for r in html_templates.extract(pages_of(spark, rows)).collect()}
    for k in range(12):
        assert "Join our club" not in got[k] and ("quoted word for word" in got[k]) == (k % 3 == 0) and got[k].startswith(f"Title {k}\nFirst")
    monkeypatch.setattr(html_templates, "PLACED_PAGES", 100)
    assert all("Join our club" in r["text"] for r in html_templates.extract(pages_of(spark, rows)).collect())
    copies = [(k, f"https://h.example/{k}", f"<article><p>All of these pages say nearly the same thing, word for word.</p><p>Copy {k}</p></article>") for k in range(12)]
    monkeypatch.setattr(html_templates, "PLACED_PAGES", 6)
    assert all("word for word" in r["text"] for r in html_templates.extract(pages_of(spark, copies)).collect())


def test_items_of_lists_and_tables_stay(spark):
    """Recipes of a host share ingredients and facts, in lists and cells: these stay, while a menu that all pages have goes as a whole."""
    menu = "<ul><li><a href=/>Start</a></li><li><a href=/all>All our recipes</a></li></ul>"
    item = lambda k: "Salt" if k % 20 == 0 else f"Herb number {k}"
    page = lambda k: f"<body><div>{menu}</div><div><h1>Recipe {k}</h1><ul><li>{item(k)}</li><li>Water {k}</li></ul><table><tr><td>Serves</td><td>{k}</td></tr><tr><td>Time</td><td>one hour</td></tr></table><p>Stir the pot {k} times.</p></div></body>"
    got = {r["page_id"]: r["text"] for r in html_templates.extract(pages_of(spark, [(k, f"https://r.example/{k}", page(k)) for k in range(100)])).collect()}
    for k in range(100):
        assert got[k] == f"Recipe {k}\n{item(k)}\nWater {k}\nServes\n{k}\nTime\none hour\nStir the pot {k} times."


def test_template_counts_are_brute_force(spark):
    rng = random.Random(8)
    rows = [site(k, host=rng.choice(["a.example", "b.example"]), notice=rng.choice(["", "<div>Buy now</div>", "<div>Buy later</div>"])) for k in range(40)]
    rows += [(100 + k, u, h) for k, (_, u, h) in enumerate(rows[:7])] + [(200, None, None), (201, "https://a.example/x", "")]
    pages = pages_of(spark, rows)
    got = {(r["host"], r["key"]): r["pages"] for r in html_templates.templates(html_templates.seen_subtrees(html_templates.numbered(pages, "page_id", "url", "html"))).collect()}
    held = {}
    for _, u, h in rows:
        content, keys = html_templates.candidates(h)
        held.setdefault((u or "//").split("/")[2], {})[content] = keys
    want = {}
    for host, distinct in held.items():
        count = Counter(k[:2] for keys in distinct.values() for k in keys)
        for (key, placed), n in count.items():
            least, share = (html_templates.PLACED_PAGES, html_templates.PLACED_SHARE) if placed else (html_templates.MIN_PAGES, html_templates.MIN_SHARE)
            if n >= least and n >= share * len(distinct):
                want[host, key] = n
    assert got == want and want
    clash = pages.selectExpr("*", "'x' AS text", "1 AS host", "2 AS _row", "3 AS template")
    again = html_templates.extract(clash.unionAll(clash.filter("page_id < 3"))).collect()
    assert len(again) == len(rows) + 3


def test_long_pages(spark):
    long = "<article>" + "<div>" * 3000 + "<p>deep</p>" + "</div>" * 3000 + "<p>" + "word " * 200_000 + "</p></article>"
    (row,) = html_templates.extract(pages_of(spark, [(1, "https://h.example/", long)])).collect()
    assert row["text"].startswith("deep\nword") and row["n_chars"] == len(row["text"]) == 4 + 1 + 5 * 200_000 - 1
