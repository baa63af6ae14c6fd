import random

from lectern.operators import evidence as E
from lectern.operators import extract
from lectern.operators.chunking import PROSE, SENTENCES, content_blocks, create_chunks, split_text
from lectern.operators.extract import extract_article
from lectern.operators.memory import completed_turns, merge_turns, select_memory
from lectern.operators.search import bm25, containing, coverage_groups, literal_matches, neighbours
from tests import plain_evidence


def block(k, text, section="S", type_="paragraph", block_id=None):
    return {"block_id": block_id or f"block-{k}", "type": type_, "text": text, "section": section, "ord": k}


def test_chunks_keep_bounds_and_sections():
    chunks = create_chunks([block(0, "a" * 450)], 180)
    assert [len(c["text"]) for c in chunks] == [180, 180, 90] and "".join(c["text"] for c in chunks) == "a" * 450
    two = create_chunks([block(0, "x" * 300, "A"), block(1, "y" * 300, "B")])
    assert [c["section"] for c in two] == ["A", "B"]
    text = "。".join("字" * 500 for _ in range(3)) + "。"
    many = create_chunks([block(0, text)])
    assert "".join(c["text"] for c in many) == text and all(len(c["text"]) <= 1200 for c in many)


def test_tables_repeat_their_header():
    rows = "\n".join(f"row {k} | " + "v" * 260 for k in range(6))
    chunks = create_chunks([block(0, f"Table\nh1 | h2\n{rows}", block_id="context-table-1")])
    assert len(chunks) > 1 and all(c["text"].startswith("Table\nh1 | h2\n") for c in chunks)
    assert [line for c in chunks for line in c["text"].split("\n")[2:]] == rows.split("\n")


def chunk(k, text, section="S"):
    return {"chunk_idx": k, "chunk_id": f"chunk-{k + 1}", "section": section, "text": text, "block_ids": [f"b{k}"]}


def test_chunks_are_the_plain_fold():
    """Break points in running sums against adding one piece after another."""
    rng = random.Random(2)
    for _ in range(400):
        pieces = [block(k, "".join(rng.choice("ab .\n") for _ in range(rng.randint(0, 30))), rng.choice(["A", "A", "B", ""])) for k in range(rng.randint(0, 9))]
        most, target = rng.choice([30, 45, 90]), rng.choice([5, 25, 90])
        want, section, text, ids = [], pieces[0]["section"] if pieces else "", "", []
        for p in [*pieces, None]:
            if ids and (p is None or p["section"] != section or len(text) + 1 + len(p["text"]) > most or len(text) >= min(most, target)):
                want.append({"section": section, "text": text, "block_ids": ids})
                text, ids = "", []
            if p is not None:
                section, text, ids = p["section"] or section, text + "\n" * bool(ids) + p["text"], [*ids, p["block_id"]]
        assert create_chunks(pieces, target, most) == want


def test_texts_are_cut_without_loss():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["word ", "字", "。", ". ", "\n\n", ", ", "\n", "x" * 9]) for _ in range(rng.randint(0, 60)))
        most = rng.choice([4, 11, 40])
        parts = split_text(text, PROSE, most)
        assert "".join(parts) == text and all(len(p) <= most for p in parts)
        assert all(len(a) + len(b) > most for a, b in zip(parts, parts[1:]))


def test_windows_and_coverage():
    chunks = [chunk(0, "a"), chunk(1, "b"), chunk(2, "c"), chunk(3, "d", "T")]
    assert [w["text"] for w in plain_evidence.pack_windows(chunks, [1], 1000)] == ["a\nb\nc"]
    assert [w["chunk_id"] for w in plain_evidence.pack_windows(chunks, [1, 3], 1000)] == ["window-chunk-1-chunk-3", "window-chunk-4-chunk-4"]
    assert plain_evidence.pack_windows(chunks, [1], 2) == [] and plain_evidence.pack_windows(chunks, [1], 1000, 0) == []
    flat = [chunk(k, "t" * 50) for k in range(5)]
    assert E.cover(flat, 64000, 3) == [0, 2, 4]
    assert E.cover([chunk(0, "x", "A"), chunk(1, "x", "A"), chunk(2, "x", "B"), chunk(3, "x", "C")], 1000, 3) == [0, 2, 3]


def test_packing_keeps_pins_and_needs():
    held = plain_evidence.Fusion()
    held.channel([chunk(0, "p" * 100)], "focus-anchor", pinned=True)
    held.channel([chunk(1, "n" * 100)], "planned-need", need=0)
    held.channel([chunk(k, "c" * 100) for k in range(2, 9)] + [chunk(0, "p" * 100)], "global-search")
    packed = plain_evidence.pack(held.ranked(), 1, 250)
    assert [e.chunk["chunk_idx"] for e in packed] == [0, 1]
    assert list(packed[0].sources) == ["focus-anchor", "global-search"]


def test_joined_evidence_keeps_the_fullest_chunk():
    wide = {"chunk_idx": 1, "chunk_id": "wide", "section": "S", "text": "x" * 50, "block_ids": ["b1", "b2"]}
    held = plain_evidence.Fusion()
    held.channel([chunk(1, "one"), chunk(2, "two")], "exact-match")
    held.channel([wide], "global-search", need=3)
    (one,) = held.ranked()
    assert one.chunk is wide and one.key == ("b1",) and one.needs == {3} and abs(one.score - (1.5 / 61 + 1.5 / 62 + 1 / 61)) < 1e-12


def test_extraction():
    page = """<html><head><title>Doc</title></head><body><nav><p>menu</p></nav><main><article><h1>Title</h1><h2>Part</h2><p>One<br>two &amp; three</p><pre>a
 b</pre><ul><li>x<li>y</ul><table><caption>Cap</caption><tr><th>h<td colspan=2>v</table><figure><img src="/i.png" alt="pic"><figcaption>fig</figcaption></figure><math><mi>x</mi><annotation encoding="application/x-tex">x^2</annotation></math></article></main></body></html>"""
    got = extract_article(page, "https://e.com/p")
    assert got["title"] == "Title" and got["diagnostics"]["root_kind"] == "article"
    assert [(b["type"], b["text"], b["section"]) for b in got["blocks"]] == [("heading", "Title", "Title"), ("heading", "Part", "Part"), ("paragraph", "One\ntwo & three", "Part"), ("code", "a\n b", "Part"), ("list", "x\ny", "Part")]
    assert got["images"][0]["src"] == "https://e.com/i.png" and got["images"][0]["caption"] == "fig"
    assert got["tables"][0]["rows"][0]["cells"][1]["col_span"] == 2 and got["formulas"][0]["tex"] == "x^2"
    assert extract_article("<p>short", "https://e.com/p")["is_partial"]
    assert extract_article(None, None)["blocks"] == []


def messages(spark, rows):
    return spark.createDataFrame([(c, k, r, t, k, False) for c, k, r, t in rows], "conv_id long, msg_idx long, role string, content string, created_at long, error boolean")


def test_turns_and_memory(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"word{k} " + "x" * 300) for k in range(7)]
    turns = completed_turns(messages(spark, rows))
    assert [r["turn_idx"] for r in turns.orderBy("turn_idx").collect()] == [0, 2, 4]
    asked = spark.createDataFrame([(1, "word0 again")], "conv_id long, question string")
    got = {r["turn_idx"]: (r["how"], r["compacted"]) for r in select_memory(turns, asked, 1300, 700, 1, 2).collect()}
    assert got == {0: ("recalled", True), 2: ("omitted", True), 4: ("recent", False)}
    assert {r["how"] for r in select_memory(turns, asked, 0).collect()} == {"omitted"}


def test_archive_merge(spark):
    kind = "url string, question_id string, pos long, created_at long, question string, answer string"
    old = spark.createDataFrame([("u", "a", 0, 1, "old", "x"), ("u", "b", 1, 2, "b", "x")], kind)
    new = spark.createDataFrame([("u", "a", 0, 1, "new", "y"), ("u", "c", 1, 3, "c", "z")], kind)
    got = [(r["ord"], r["question_id"], r["question"]) for r in merge_turns(old, new).orderBy("ord").collect()]
    assert got == [(0, "a", "new"), (1, "b", "b"), (2, "c", "c")]


def test_search(spark):
    chunks = spark.createDataFrame([(1, 0, "A", "common common words here"), (1, 1, "A", "the vector index stores postings"), (1, 2, "B", "other text")], "article_id long, chunk_idx int, section string, text string")
    asked = spark.createDataFrame([(7, 0, "how does the vector index store postings")], "query_id long, pos int, text string")
    assert [r["chunk_idx"] for r in bm25(chunks, asked).collect()] == [1]
    assert {(r["chunk_idx"], r["before"], r["after"]) for r in neighbours(chunks).collect()} == {(0, None, 1), (1, 0, None), (2, None, None)}
    assert {r["group_key"] for r in coverage_groups(chunks).collect()} == {"A", "B"}


def test_literals_of_one_article(spark):
    """The two ways to find literals agree where every question is of every article."""
    rng = random.Random(6)
    words = ["alpha", "beta-7", "x/y", "gamma", "delta.io", "ab"]
    chunks = spark.createDataFrame([(a, k, "S", " ".join(rng.choice(words) for _ in range(6))) for a in (1, 2) for k in range(12)], "article_id long, chunk_idx int, section string, text string")
    asked = [(q, f'does "{rng.choice(words)} {rng.choice(words)}" mean {rng.choice(words)}') for q in range(6)]
    plain = literal_matches(chunks, spark.createDataFrame(asked, "query_id long, question string"))
    bound = literal_matches(chunks, spark.createDataFrame([(a, *q) for a in (1, 2) for q in asked], "article_id long, query_id long, question string"))
    told = lambda df: sorted((r["article_id"], r["query_id"], r["chunk_idx"], r["longest"], r["matches"], r["place"]) for r in df.collect())
    assert told(plain) == told(bound) and plain.count() > 20
    text = {(r["article_id"], r["chunk_idx"]): f"s {r['text']}" for r in chunks.collect()}
    few = spark.createDataFrame([(1, "a b"), (2, "--"), (3, "alpha")], "query_id long, literal string")
    got = {(r["article_id"], r["chunk_idx"], r["literal"]) for r in containing(chunks, few, 1).collect()}
    assert got == {(a, k, w) for (a, k), t in text.items() for w in ("a b", "--", "alpha") if w in t}


def test_media_become_blocks(spark):
    """Descriptions stand before the block of the same place; pictures without one, and formulas without TeX, are left out."""
    blocks = spark.createDataFrame([(1, f"block-{k + 1}", "paragraph", f"text {k}", "S", k) for k in range(2)], "article_id long, block_id string, type string, text string, section string, ord int")
    images = spark.createDataFrame([(1, "image-1", "a cat", "", "a cat", "S", 1), (1, "image-2", "", "", "", "S", 0), (1, "image-3", "", "at the end", None, "S", None)], "article_id long, id string, alt string, caption string, surrounding_text string, section string, ord int")
    tables = spark.createDataFrame([(1, "table-1", "Counts", "S", 0, [([("h", True, 1, 1), ("v", True, 1, 1)],), ([("a", False, 1, 1), ("1", False, 1, 1)],)])], "article_id long, id string, caption string, section string, ord int, rows array<struct<cells: array<struct<text: string, header: boolean, col_span: int, row_span: int>>>>")
    formulas = spark.createDataFrame([(1, "formula-1", "x^2", "S", 1), (1, "formula-2", "", "S", 1)], "article_id long, id string, tex string, section string, ord int")
    got = [(r["block_id"], r["text"]) for r in content_blocks(blocks, images, tables, formulas).orderBy("ord").collect()]
    assert got == [("context-table-1", "Table: Counts\nh | v\na | 1"), ("block-1", "text 0"), ("context-image-1", "Image: a cat"), ("context-formula-1", "Formula: x^2"), ("block-2", "text 1"), ("context-image-3", "Image: at the end")]


def plain_cover(chunks, budget, limit):
    """Coverage by trying everything, one chunk after another."""
    if not chunks or budget <= 0 or limit <= 0:
        return []
    if sum(map(E.cost, chunks)) <= budget and len(chunks) <= limit:
        return list(range(len(chunks)))
    groups = {}
    for k, g in enumerate(E.groups_of(chunks).tolist()):
        groups.setdefault(g, []).append(k)
    groups = list(groups.values())
    for n in range(min(limit, len(groups)), 0, -1):
        chosen = [groups[k] for k in E.even_indexes(len(groups), n)]
        if sum(E.cost(chunks[g[0]]) for g in chosen) <= budget:
            break
    else:
        return []
    picked = [g[0] for g in chosen]
    while len(picked) < limit:
        left = budget - sum(E.cost(chunks[k]) for k in picked)
        blocks = {b for k in picked for b in chunks[k]["block_ids"]}
        offers = []
        for g in chosen:
            rest = [k for k in g if k not in picked and not blocks & set(chunks[k]["block_ids"])]
            if rest:
                one = max(rest) if len(g) - len(rest) == 1 else min(rest, key=lambda k: (abs(2 * k - g[0] - g[-1]), k))
                offers.append((-sum(E.cost(chunks[k]) for k in rest), one))
        fit = [k for _, k in sorted(offers) if E.cost(chunks[k]) <= left]
        if not fit:
            break
        picked.append(fit[0])
    return sorted(picked)


def test_coverage_is_the_plain_choice():
    rng = random.Random(8)
    for n in range(500):
        size = rng.randint(0, 14)
        chunks = [chunk(k, "t" * rng.randint(0, 40), rng.choice(["A > x", "A > y", "A"] if n % 2 else ["A > x", "B > z", "B", ""])) | {"block_ids": [f"b{rng.randint(0, size)}"]} for k in range(size)]
        budget, limit = rng.choice([0, 40, 150, 400]), rng.randint(0, 7)
        assert E.cover(chunks, budget, limit) == plain_cover(chunks, budget, limit)


def cut(text):
    ends = [m.end() for m in SENTENCES.finditer(text)]
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)]) if b > a]


def test_sentences_end_where_the_rules_say():
    """The published cases of the rules for text boundaries."""
    cases = [
        ["He said “Are you going?” ", "John shook his head."], ["The resp. leaders are here. ", "3.4 is c.d and U.S. ", "Then"], ["etc.)’ ‘(the"], ["etc.)’ ", "‘(The"],
        ["the resp. leaders are"], ["字。", "它是！", "好"], ["Wait... what? ", "No!! ", "Yes"], ["a\n", "b\r\n", "c"], ["Mr. ", "Smith went"], ["She said “See spot run.”  ", "John shook his head. "], ["He said. , and so"], ["c.D"], ["3.4"], ["c.d"], ["U.S\u0300.A\u0300."],
    ]
    for parts in cases:
        assert cut("".join(parts)) == parts


def test_totals_are_known_in_passing(spark, tmp_path):
    page = "<html><body><article><h1>T</h1><p>Some words of a text that is long enough to be read, more or less.</p></article><iframe></iframe></body></html>"
    pages = spark.createDataFrame([(k, f"https://e.test/{k}", page if k % 2 else "<p>short") for k in range(6)], "page_id long, url string, html string")
    read, seen = extract.observed(extract.articles(pages))
    read.write.parquet(f"{tmp_path}/articles")
    assert seen.get == extract.diagnostics_totals(extract.articles(pages)).first().asDict() and seen.get["articles"] == 6
