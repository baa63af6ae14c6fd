"""Readable structure of web pages: root, blocks with section paths, images, tables, formulas, and diagnostics.

One Arrow-batched pass over the pages; a page's tree never leaves its worker. Facts of a live page (shadow roots,
canvas pixels, sources chosen by a browser) aren't in stored HTML: shadow roots count 0, canvases give no image.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import quote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.functions.dom import Element, parse
from lectern.sources.batches import SLICE, bounded

MINIMUM_READABLE, NEARBY = 80, 800

# What content, exclusion and loading look like.
CONTENT = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote ul ol".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
EXCLUDED_TAGS, EXCLUDED_ROLES = frozenset("nav footer aside form button".split()), frozenset("navigation toolbar group".split())
LOADING_VALUES = ("", "true", "loading", "pending")
LEAVES = frozenset("div span strong b".split())
PREFERRED = frozenset("longformContent articleText tweetText".split())
MATH_TAGS = frozenset("math semantics annotation annotation-xml mrow mi mn mo mtext mspace ms mglyph mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd mlabeledtr mstack mlongdiv msgroup msrow mscarries mscarry msline".split())
MATH_ATTRIBUTES = frozenset("display encoding mathvariant mathsize stretchy symmetric fence separator form lspace rspace accent accentunder align columnalign rowalign columnspan rowspan width height depth notation linethickness".split())

BLOCK = "struct<block_id: string, type: string, text: string, section: string, ord: int, level: int>"
DIAGNOSTICS = "struct<root_kind: string, readable_length: int, minimum_readable_length: int, root_text_length: int, candidate_block_count: int, accepted_block_count: int, excluded_block_count: int, empty_block_count: int, article_candidate_count: int, main_candidate_count: int, role_main_candidate_count: int, iframe_count: int, canvas_count: int, table_count: int, shadow_root_count: int, loading_indicator_count: int, fallback_used: boolean, fallback_block_count: int>"
ARTICLE = f"struct<title: string, blocks: array<{BLOCK}>, images: array<struct<id: string, src: string, alt: string, caption: string, section: string, surrounding_text: string, ord: int>>, tables: array<struct<id: string, caption: string, section: string, ord: int, rows: array<struct<cells: array<struct<text: string, header: boolean, col_span: int, row_span: int>>>>>>, formulas: array<struct<id: string, tex: string, mathml: string, section: string, ord: int, display: string>>, is_partial: boolean, diagnostics: {DIAGNOSTICS}>"


def _flat(text: str | None) -> str:
    return " ".join((text or "").split())


def _classes(e: Element) -> list[str]:
    return e.get("class").split()


def loading(e: Element) -> bool:
    return e.get("aria-busy") == "true" or "data-loading" in e.attributes and e.get("data-loading") in LOADING_VALUES or "hidden" not in e.attributes and bool({"loading", "skeleton"} & set(_classes(e)))


def _excluding(e: Element) -> bool:
    return e.tag in EXCLUDED_TAGS or e.get("role") in EXCLUDED_ROLES or e.get("aria-hidden") == "true" or loading(e)


def _unread(e: Element) -> bool:
    return e.tag in ("math", "script", "style") or e.get("aria-hidden") == "true" or "katex" in _classes(e)


def excluded(e: Element) -> bool:
    return e.closest(_excluding) is not None


def element_text(e: Element) -> str:
    return re.sub("\\s*\ue000\\s*", "\n", _flat(e.text(_unread, "\ue000")))


def code_text(e: Element) -> str:
    code = next((k for k in e.kids() if k.tag == "code"), e)
    lines = [k for k in code.kids() if not _unread(k) and (k.tag == "div" or "line" in _classes(k) or "data-line" in k.attributes)]
    raw = "\n".join(k.text(_unread, "\n") for k in lines) if len(lines) > 1 else e.text(_unread, "\n")
    raw = re.sub(r"[ \t]+$", "", re.sub(r"\r\n?", "\n", raw).replace("\xa0", " "), flags=re.M)
    return re.sub(r"^(?:[ \t]*\n)+|(?:\n[ \t]*)+$", "", raw)


def list_text(e: Element) -> str:
    return "\n".join(t for t in (element_text(k) for k in e.kids() if k.tag == "li") if t) or element_text(e)


def contents_list(e: Element) -> bool:
    links = [a for a in e.elements() if a.tag == "a" and "#" in a.get("href")] if e.tag in ("ul", "ol") else []
    return len(links) >= 3 and all(_flat(a.text()) for a in links)


class Path:
    """The headings above the current place."""

    def __init__(self, fallback: str) -> None:
        self.levels: dict[int, str] = {}
        self.fallback = fallback

    def enter(self, level: int, text: str) -> str:
        self.levels = {k: v for k, v in self.levels.items() if k < level} | ({level: text} if text else {})
        return self.label()

    def label(self) -> str:
        below = [self.levels[k] for k in sorted(self.levels) if k > 1]
        return " > ".join(below or [self.levels[k] for k in sorted(self.levels)]) or self.fallback


def section_of(root: Element, target: Element, title: str) -> str:
    path = Path(title)
    for h in root.elements():
        if h.start > target.start:
            break
        if h.tag in HEADINGS:
            path.enter(int(h.tag[1]), _flat(h.text()))
    return path.label()


def find_root(page: Element) -> tuple[Element, str]:
    kinds = (("article", lambda e: e.tag == "article"), ("main", lambda e: e.tag == "main"), ("role-main", lambda e: e.get("role") == "main"))
    for kind, fit in kinds:
        if found := [e for e in page.elements() if fit(e)]:
            return max(found, key=lambda e: len(root_text(e))) if len(found) > 1 else found[0], kind
    return page.find(lambda e: e.tag == "body") or page, "body"


def root_text(e: Element) -> str:
    return _flat(e.text(lambda x: _unread(x) or _excluding(x)))


def _own_text(e: Element) -> bool:
    return any(isinstance(c, str) and c.strip() for c in e.children)


def leaves(root: Element) -> list[Element]:
    """Elements of no meaning that hold text themselves, where content stands outside paragraphs and the like."""
    roots = [e for e in root.elements() if e.get("data-testid") in PREFERRED] or [root]
    barred = lambda e: _excluding(e) or e.tag in CONTENT or e.tag in ("table", "math", "svg")
    out = []
    for top in roots:
        for e in [top, *top.elements()]:
            if e.tag not in LEAVES or e.closest(barred) is not None or not _flat(e.text()):
                continue
            if _own_text(e) or not any(x.tag in LEAVES and _own_text(x) and not excluded(x) for x in e.elements()):
                out.append(e)
    return out


def sanitized_math(e: Element) -> str:
    if e.tag not in MATH_TAGS:
        return ""
    attributes = "".join(f' {k}="{html.escape(v[:500])}"' for k, v in e.attributes.items() if k in MATH_ATTRIBUTES)
    inside = "".join(html.escape(c, quote=False) if isinstance(c, str) else sanitized_math(c) for c in e.children)
    return f"<{e.tag}{attributes}>{inside}</{e.tag}>"


def _image_source(e: Element, url: str) -> str:
    if e.tag == "svg":
        return "data:image/svg+xml;charset=utf-8," + quote(f"<svg>{e.text()}</svg>")
    if e.tag != "img":
        return ""
    last = [c.split()[0] for c in (e.get("data-srcset") or e.get("srcset")).split(",") if c.split()]
    source = e.get("data-src") or e.get("data-original") or e.get("data-lazy-src") or e.get("src") or (last[-1] if last else "")
    try:
        return urljoin(url, source) if source else ""
    except ValueError:
        return source


def _visual(e: Element) -> bool:
    return e.tag in ("img", "canvas") or e.tag == "svg" and (e.get("role") == "img" or "aria-label" in e.attributes or e.closest(lambda x: x.tag == "figure") is not None)


def _nearby(e: Element) -> str:
    figure = e.closest(lambda x: x.tag == "figure")
    caption = figure.find(lambda x: x.tag == "figcaption") if figure else None
    around = [figure.beside(-1) if figure else None, caption, figure.beside(1) if figure else None, e.beside(-1), e.beside(1)]
    return " ".join(dict.fromkeys(t for t in (_flat(x.text()) for x in around if x) if t))[:NEARBY]


def extract_article(page: str | None, url: str | None) -> dict:
    url = url or ""
    tree = parse(page or "")
    root, kind = find_root(tree)
    first = root.find(lambda e: e.tag == "h1")
    head = tree.find(lambda e: e.tag == "title")
    title = (_flat(first.text()) if first else "") or (_flat(head.text()) if head else "") or (urlsplit(url).hostname or url)
    path, section = Path(title), title
    entries: list[tuple[Element, dict]] = []
    candidates = [e for e in root.elements() if e.tag in CONTENT]
    left_out = empty = 0
    for e in candidates:
        if excluded(e) or contents_list(e):
            left_out += 1
            continue
        type_ = "heading" if e.tag in HEADINGS else {"pre": "code", "blockquote": "quote", "ul": "list", "ol": "list"}.get(e.tag, "paragraph")
        text = {"code": code_text, "list": list_text}.get(type_, element_text)(e)
        if not text:
            empty += 1
            continue
        level = int(e.tag[1]) if type_ == "heading" else None
        if level:
            section = path.enter(level, text)
        entries.append((e, {"type": type_, "text": text, "section": section, "level": level}))
    readable = sum(len(b["text"]) for _, b in entries)
    whole = len(root_text(root))
    fallback = 0
    if readable < MINIMUM_READABLE or whole - readable >= MINIMUM_READABLE or root.find(lambda e: e.get("data-testid") in PREFERRED):
        seen, added = {b["text"] for _, b in entries}, []
        for e in leaves(root):
            text = element_text(e)
            if len(text) >= 2 and text not in seen and not any(x.holds(e) or e.holds(x) for x, _ in [*entries, *added]):
                seen.add(text)
                added.append((e, {"type": "paragraph", "text": text, "section": title, "level": None}))
        if added:
            fallback = len(added)
            entries = sorted([*entries, *added], key=lambda x: x[0].start)
            path, section = Path(title), title
            for _, b in entries:
                if b["level"]:
                    section = path.enter(b["level"], b["text"])
                b["section"] = section
            readable = sum(len(b["text"]) for _, b in entries)
    blocks = [{"block_id": f"block-{k + 1}", "ord": k} | b for k, (_, b) in enumerate(entries)]

    def place(target: Element) -> int:
        inside = next((k for k, (e, _) in enumerate(entries) if e.holds(target)), None)
        return inside + 1 if inside is not None else sum(e.start < target.start for e, _ in entries)

    images, sources = [], set()
    for e in root.elements():
        if _visual(e) and not excluded(e) and (source := _image_source(e, url)) and source not in sources:
            sources.add(source)
            figure = e.closest(lambda x: x.tag == "figure")
            caption = figure.find(lambda x: x.tag == "figcaption") if figure else None
            own_title = e.find(lambda x: x.tag == "title")
            alt = _flat(e.get("alt") or e.get("aria-label") or (own_title.text() if own_title else ""))
            images.append({"id": f"image-{len(images) + 1}", "src": source, "alt": alt, "caption": _flat(caption.text()) if caption else "", "section": section_of(root, e, title), "surrounding_text": _nearby(e), "ord": place(e)})
    tables = []
    span = lambda e, n: max(1, int(m[0]) if (m := re.match(r"\s*\d+", e.get(n))) else 1)
    for e in root.elements():
        if e.tag == "table" and not excluded(e):
            rows = [[{"text": t, "header": c.tag == "th", "col_span": span(c, "colspan"), "row_span": span(c, "rowspan")} for c in r.kids() if c.tag in ("th", "td") and (t := element_text(c))] for r in e.elements() if r.tag == "tr"]
            if any(rows):
                caption = e.find(lambda x: x.tag == "caption")
                tables.append({"id": f"table-{len(tables) + 1}", "caption": _flat(caption.text()) if caption else "", "section": section_of(root, e, title), "ord": place(e), "rows": [{"cells": r} for r in rows if r]})
    formulas = []
    for e in root.elements():
        if e.tag == "math" and not excluded(e):
            note = e.find(lambda x: x.tag == "annotation" and x.get("encoding") in ("application/x-tex", "text/tex"))
            mathml, tex = sanitized_math(e), _flat(note.text()) if note else ""
            shown = e.get("display") == "block" or e.closest(lambda x: "katex-display" in _classes(x)) is not None
            formulas.append({"id": f"formula-{len(formulas) + 1}", "tex": tex or _flat(e.text()), "mathml": mathml, "section": section_of(root, e, title), "ord": place(e), "display": "block" if shown else "inline"})
    readable += sum(len(t["caption"]) + sum(len(c["text"]) for r in t["rows"] for c in r["cells"]) for t in tables) + sum(len(f["tex"]) for f in formulas)
    count = lambda top, fit: sum(map(fit, top.elements()))
    waiting = count(root, loading)
    diagnostics = {
        "root_kind": kind, "readable_length": readable, "minimum_readable_length": MINIMUM_READABLE, "root_text_length": whole, "candidate_block_count": len(candidates), "accepted_block_count": len(blocks), "excluded_block_count": left_out, "empty_block_count": empty,
        "article_candidate_count": count(tree, lambda e: e.tag == "article"), "main_candidate_count": count(tree, lambda e: e.tag == "main"), "role_main_candidate_count": count(tree, lambda e: e.get("role") == "main"),
        "iframe_count": count(root, lambda e: e.tag == "iframe"), "canvas_count": count(root, lambda e: e.tag == "canvas"), "table_count": count(root, lambda e: e.tag == "table"), "shadow_root_count": 0, "loading_indicator_count": waiting, "fallback_used": fallback > 0, "fallback_block_count": fallback,
    }
    tree.release()
    return {"title": title, "blocks": blocks, "images": images, "tables": tables, "formulas": formulas, "is_partial": readable < MINIMUM_READABLE or waiting > 0, "diagnostics": diagnostics}


def article_of(page: Column, url: Column, fields: tuple[str, ...] = ()) -> Column:
    """The article of a page as a struct, with the named fields alone if any are named. Few pages are Python objects at a time."""
    every = StructType.fromDDL(ARTICLE.removeprefix("struct<").removesuffix(">"))
    kind = StructType([f for f in every if not fields or f.name in fields])

    def read(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for pages, urls in parts:
            for at in range(0, len(pages), SLICE):
                made = (extract_article(p, u) for p, u in zip(pages[at : at + SLICE], urls[at : at + SLICE], strict=True))
                yield pd.DataFrame([{k: x[k] for k in kind.names} for x in made], columns=kind.names)

    return F.pandas_udf(read, kind)(page, url)


def articles(pages: DataFrame, *fields: str) -> DataFrame:
    """article_id, url, and the article's fields (those named, or all) of every page."""
    return bounded(pages).select(F.col("page_id").alias("article_id"), "url", article_of(F.col("html"), F.col("url"), fields).alias("_a")).select("article_id", "url", "_a.*")


def blocks(read: DataFrame) -> DataFrame:
    """The blocks of articles() as rows."""
    return read.select("article_id", F.explode("blocks").alias("b")).select("article_id", "b.*")


def reading_scope(rows: DataFrame) -> DataFrame:
    """article_id, section, blocks, first_ord."""
    return rows.groupBy("article_id", "section").agg(F.count("*").alias("blocks"), F.min("ord").alias("first_ord"))


def _totals(read: DataFrame) -> list[Column]:
    counters = [f.name for f in read.schema["diagnostics"].dataType.fields if f.dataType.simpleString() == "int" and f.name != "minimum_readable_length"]
    d = F.col("diagnostics")
    return [F.count("*").alias("articles"), F.count_if("is_partial").alias("partial"), F.count_if(d["root_kind"] == "body").alias("body_roots"), F.count_if(d["fallback_used"]).alias("with_fallback"), *(F.coalesce(F.sum(d[c]), F.lit(0)).cast("long").alias(c) for c in counters)]


def diagnostics_totals(read: DataFrame) -> DataFrame:
    """One row: articles, partial ones, those read from the body, with fallback blocks, and the sums of all counters."""
    return read.agg(*_totals(read))


def observed(read: DataFrame) -> tuple[DataFrame, Observation]:
    """The articles, and what diagnostics_totals() says of them, known once they have been written: pages are parsed once for both.

    A task that runs again after a lost executor is counted again, so these are figures for a log; diagnostics_totals() is exact.
    """
    seen = Observation("diagnostics")
    return read.observe(seen, *_totals(read)), seen


def diagnostic_issues(d: Column) -> Column:
    """The ids of what may be wrong with an extraction, from its diagnostics."""
    missed = F.greatest(F.lit(0), d["root_text_length"] - d["readable_length"])
    rules = (
        ("low-readable-text", d["readable_length"] < d["minimum_readable_length"]),
        ("body-fallback", d["root_kind"] == "body"),
        ("multiple-articles", d["article_candidate_count"] > 1),
        ("unsupported-structure", d["iframe_count"] + d["canvas_count"] + d["shadow_root_count"] > 0),
        ("dynamic-loading", d["loading_indicator_count"] > 0),
        ("excluded-blocks", d["excluded_block_count"] > 0),
        ("unmatched-markup", ~d["fallback_used"] & (missed >= 120) & (missed > d["readable_length"] * 1.5)),
    )
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))
