"""Main text of web pages: site templates are found by counting element subtrees per host.

Every page is parsed into a small tree by a tolerant tokenizer. Each element subtree is hashed (tag and
white-space-collapsed text, bottom up, without what goes in any case) and counted per host over all pages, pages of equal
content counting once. What recurs on many pages of its host is template and is deleted, with the elements that are never
main text (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments, by their tag,
role, class or id). What is left of the article element, of main, or else of the body, gives the blocks.

There are two ways to recur. Elements outside of a declared article that hold no text block are template from MIN_PAGES
pages and MIN_SHARE of the host's pages on, wherever they stand. Everything else, that is what stands in an article and what holds
paragraphs or quotes, is counted together with its place (its parent's tag, and its number among the parent's
elements from the start, or from the end) and is template only from PLACED_PAGES pages and PLACED_SHARE of the host's pages on:
a notice in every article goes, a passage that some articles quote stays. Headings in articles stay. Items, cells and all else inside
a list or a table outside of a declared article count with the whole of it only: a menu goes, an ingredient that several recipes list stays. Where placed template would
take more than PLACED_MOST of a page's main text, the pages are copies of one another rather than alike by template, and it stays.

Pages are parsed once: the text they have without regard to counts is stored with their hashes. The counts are one
aggregation (host, hash) -> pages, combined before the shuffle. A join on (host, hash) tells which pages hold template in
their main text, and which, so no row carries its host's whole template; these pages alone are read and parsed again. A bitmap of their
row numbers, of FILTER_BITS bits at any size, keeps all others, or nearly, out of the joins that follow.

Defined results: null or empty html gives an empty text; a null url gives a host of its own ("") for counting; repeated
rows each give their row; an empty table gives an empty result. Hosts of fewer than MIN_PAGES pages have no template.
Rows are told apart by their place in the input, which must be a table read from files; other inputs are written to the
shared folder first (table=False).
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import batches, discard, documents_of, sliced, stored, tidy

#: On how many different pages of its host, and on what share of them, a subtree is template; and if its place counts.
MIN_PAGES, MIN_SHARE = 4, 0.01
PLACED_PAGES, PLACED_SHARE, PLACED_MOST = 6, 0.5, 0.3
#: Bits of the filter that tells pages with template from others: at most 133,153 words of 63 bits, about two megabytes.
FILTER_BITS = 1 << 23
#: Hashed subtrees have this many code points of text at least.
MIN_TEXT = 3

# Fixed values of HTML: elements without content, with raw text, that end an open paragraph, and what ends what.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption option".split())
ENDS_P = BLOCK - frozenset("li dd dt td th tr tbody thead tfoot caption option body html".split())
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "thead": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tfoot", "tr", "td", "th"},
}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}}
#: Elements whose text is never main text.
DROPPED = frozenset("script style noscript template iframe object embed svg math canvas audio video head title nav header footer aside form button input select textarea option dialog menu search noembed noframes applet map area".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar advertisement".split())
#: Names, as parts of class or id words, of elements that are never main text.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead footer sidebar widget widgets rail notice notices cookie cookies consent gdpr "
    "popup modal overlay newsletter subscribe subscription signup login comment comments disqus reply replies respond discussion related recommended recommendations share sharing social pagination pager skip toolbar".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_BLOCKS = HEADINGS | frozenset("p blockquote pre".split())
#: What counts as a whole: its parts aren't template on their own.
WHOLES = frozenset("ul ol dl menu dir table".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>\x00]*+)((?>[^>\"']*(?:(?:\"[^\"]*\"|'[^']*'|[\"'])[^>\"']*)*))>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
WORDS = re.compile(r"[A-Za-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)")


class Node:
    """An element; dropped: its text is never main text, by its tag, role, class or id."""

    __slots__ = ("tag", "role", "children", "dropped")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.children, self.role, self.dropped = tag, [], "", tag in DROPPED
        if not self.dropped and ("=" in attributes or "hidden" in attributes):
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
            self.role = found.get("role", "").strip().lower()
            hidden = found.get("aria-hidden", "").lower() == "true" or "aria-hidden" not in found and HIDDEN.search(attributes) is not None
            named = f"{found.get('class', '')} {found.get('id', '')}"
            words = (w.lower() for part in WORDS.findall(named) for w in CAMEL.split(part)) if named != " " and tag not in ("html", "body", "article", "main") else ()
            self.dropped = self.role in DROPPED_ROLES or hidden or not NAMES.isdisjoint(words)


def parse(page: str) -> Node:
    """The tree of a page: children are nodes, and strings with references still encoded."""
    root = Node("#root")
    stack = [root]
    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            _close(stack, tag)
            continue
        _imply_ends(stack, tag)
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if tag in VOID or tag in ("svg", "path") and m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else size])
            at = end.end() if end else size
            continue
        stack.append(node)
    return root


def _close(stack: list[Node], tag: str) -> None:
    limit = len(stack) - 1
    for k in range(limit, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if tag not in BLOCK and stack[k].tag in BLOCK:  # an inline end tag doesn't close a block
            return


def _imply_ends(stack: list[Node], tag: str) -> None:
    if tag in ENDS_P:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == "p":
                del stack[k:]
                break
            if stack[k].tag in BLOCK:
                break
    ended, scope = SIBLINGS.get(tag), SCOPES.get(tag, ())
    while ended:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in scope:
                return
            if stack[k].tag in ended:
                del stack[k:]
                break
        else:
            return


def _root(tree: Node) -> tuple[Node, bool]:
    """The declared article with the most text, then main, then body; whether the page declares one."""
    found: dict[str, list[Node]] = {"article": [], "main": [], "body": []}
    todo = [(tree, False)]
    while todo:
        node, inner = todo.pop()
        kind = "main" if node.role == "main" else node.tag
        inner = inner or node.tag != "#root" and node.dropped
        if kind in found and not inner:
            found[kind].append(node)
            if kind == "article":
                continue
        todo += [(c, inner) for c in reversed(node.children) if isinstance(c, Node)]
    for kind in ("article", "main"):
        if found[kind]:
            return max(found[kind], key=lambda n: len(_raw_text(n))) if len(found[kind]) > 1 else found[kind][0], True
    return (found["body"][0] if found["body"] else tree), False


def _raw_text(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is node or not x.dropped:
            todo += reversed(x.children)
    return "".join(out)


def _digest(parts: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


class Subtree:
    """A node's hash and text length; the keys it is counted under, whether these hold its place, and whether it is in the main text."""

    __slots__ = ("node", "hash", "length", "keys", "placed", "inner")

    def __init__(self, node: Node, hash_: int, length: int, inner: bool) -> None:
        self.node, self.hash, self.length, self.inner, self.keys, self.placed = node, hash_, length, inner, (), False


def subtrees(tree: Node, article: Node, declared: bool) -> dict[int, Subtree]:
    """id(node) -> its subtree, in one pass bottom up."""
    out: dict[int, Subtree] = {}
    order, todo = [], [(tree, tree, 0, 0, False, False, False)]
    while todo:
        node, parent, from_start, from_end, inside, inner, part = todo.pop()
        inside = inside or node is article and declared
        inner = node is article or inner and not node.dropped
        order.append((node, parent, from_start, from_end, inside, inner, part))
        elements = [c for c in node.children if not isinstance(c, str)]
        todo += [(c, node, k, len(elements) - k, inside, inner, part or node.tag in WHOLES) for k, c in enumerate(elements)]
    around, holds_text = set(), set()
    for node, parent, from_start, from_end, inside, inner, part in reversed(order):
        parts, length = [node.tag], 0
        for c in node.children:
            if isinstance(c, str):
                if text := " ".join(c.split()):
                    parts.append("t" + text)
                    length += len(text)
                continue
            if id(c) in around or c is article:
                around.add(id(node))
            if not c.dropped:
                parts.append(f"n{out[id(c)].hash}")
                length += out[id(c)].length
                if id(c) in holds_text or c.tag in TEXT_BLOCKS:
                    holds_text.add(id(node))
        own = out[id(node)] = Subtree(node, _digest(parts), length, inner)
        if length < MIN_TEXT or node is article or id(node) in around or node.tag in ("#root", "html", "body", "head"):
            continue
        own.placed = inside or not declared and (node.tag in TEXT_BLOCKS or id(node) in holds_text)
        if not own.placed:
            own.keys = () if part else (own.hash,)
        elif node.tag not in HEADINGS:
            own.keys = tuple(_digest([str(own.hash), parent.tag, side, str(k)]) for side, k in (("start", from_start), ("end", from_end)))
    return out


def candidates(page: str | None) -> tuple[int, list[tuple[int, bool, bool]]]:
    """A hash of the page's whole content, and the keys of its subtrees, each once, with whether they hold a place and are in the main text.

    Where an element and its only child have the same text, both are listed; a host's counts then agree for both.
    """
    return read(page)[:2]


def read(page: str | None) -> tuple[int, list[tuple[int, bool, bool]], str]:
    """candidates(), and the main text without regard to counts."""
    if not page:
        return 0, [], ""
    tree = parse(page)
    article, declared = _root(tree)
    found = subtrees(tree, article, declared)
    keys: dict[tuple[int, bool], bool] = {}
    for s in found.values():
        for k in s.keys:
            keys[k, s.placed] = keys.get((k, s.placed), False) or s.inner
    return found[id(tree)].hash, sorted((*k, inner) for k, inner in keys.items()), _blocks(article, set())


def template_nodes(tree: Node, article: Node, declared: bool, template: frozenset[int]) -> set[int]:
    """id(node) of what is template; placed template stays if it would take too much of the main text."""
    found = subtrees(tree, article, declared)
    hit = {k for k, s in found.items() if not template.isdisjoint(s.keys)}
    taken, todo = 0, [article]
    while todo:
        node = todo.pop()
        if id(node) in hit:
            taken += found[id(node)].length * found[id(node)].placed
        else:
            todo += (c for c in node.children if not isinstance(c, str) and not c.dropped)
    if taken > PLACED_MOST * found[id(article)].length:
        hit = {k for k in hit if not found[k].placed}
    return hit


def main_text(page: str | None, template: frozenset[int] = frozenset()) -> str:
    """The blocks of the main text, joined by line ends."""
    if not page:
        return ""
    tree = parse(page)
    article, declared = _root(tree)
    return _blocks(article, template_nodes(tree, article, declared, template) if template else set())


def _blocks(article: Node, gone: set[int]) -> str:
    blocks: list[str] = []
    run: list[str] = []

    def close() -> None:
        if run:
            text = "".join(run)
            if text := " ".join((html.unescape(text) if "&" in text else text).split()):
                blocks.append(text)
            run.clear()

    todo: list[Node | str | None] = [article]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            run.append(x)
        elif x is not article and (x.dropped or id(x) in gone):
            if x.tag in BLOCK:
                close()
        elif x.tag in ("br", "hr"):
            run.append(" ") if x.tag == "br" else close()
        else:
            if x.tag in BLOCK or x is article:
                close()
                todo.append(None)
            todo += reversed(x.children)
    close()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL, without user and port; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def numbered(pages: DataFrame, key: str, url: str, page: str) -> DataFrame:
    """_row (a row's place in the table), host, _html, and the columns key and url."""
    return documents_of(pages, key, url, page).select(F.monotonically_increasing_id().alias("_row"), host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{page}`").alias("_html"), F.col(f"`{key}`").alias("_key"), F.col(f"`{url}`").alias("_url"))


def seen_subtrees(rows: DataFrame) -> DataFrame:
    """_row, host, _key, _url, content (a hash of the page), keys (of its subtrees: key, placed, inner) and text."""
    kinds = pa.list_(pa.struct([("key", pa.int64()), ("placed", pa.bool_()), ("inner", pa.bool_())]))

    def run(parts):
        def made():
            for part in sliced(parts):
                read_ = [read(p) for p in part.column(2).to_pylist()]
                columns = [pa.array(c, k) for c, k in zip(zip(*read_, strict=True), (pa.int64(), kinds, pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in (0, 1, 3, 4)), *columns], names=["_row", "host", "_key", "_url", "content", "keys", "text"])

        yield from tidy(made())

    kind = rows.schema["_key"].dataType.simpleString()
    return rows.select("_row", "host", "_html", "_key", "_url").mapInArrow(run, f"_row long, host string, _key {kind}, _url string, content long, keys array<struct<key: long, placed: boolean, inner: boolean>>, text string")


def templates(seen: DataFrame) -> DataFrame:
    """host, key, pages of the template of every host. Pages of equal content count once, so copies of a page don't make its text a template."""
    held = seen.withColumn("keys", F.transform("keys", lambda k: F.struct(k["key"].alias("key"), k["placed"].alias("placed"))))
    distinct = held.groupBy("host", "content").agg(F.first("keys").alias("keys"))
    sizes = seen.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("every"))
    counts = distinct.select("host", F.explode("keys").alias("k")).groupBy("host", "k").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min(MIN_PAGES, PLACED_PAGES))
    placed = F.col("k.placed")
    often = (F.col("pages") >= F.when(placed, PLACED_PAGES).otherwise(MIN_PAGES)) & (F.col("pages") >= F.when(placed, PLACED_SHARE).otherwise(MIN_SHARE) * F.col("every"))
    return counts.join(sizes, "host").filter(often).select("host", "k.key", "pages")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", table: bool = False) -> DataFrame:
    """key, url, text, n_chars of every page. table: pages is read from files as it is."""
    pages = documents_of(pages, key, url, page)
    rows = numbered(pages if table else stored(pages, "pages-input"), key, url, page)
    seen = stored(seen_subtrees(rows), "subtrees", "zstd")  # holds the pages' texts
    known = stored(templates(seen).select("host", "key"), "templates")
    inner = seen.select("_row", "host", F.explode(F.filter("keys", lambda k: k["inner"])).alias("k")).select("_row", "host", "k.key")
    own = stored(inner.join(known.hint("merge"), ["host", "key"]).groupBy("_row").agg(F.collect_set("key").alias("template")), "page-templates")
    discard(known)
    bit = F.pmod(F.xxhash64("_row"), F.lit(FILTER_BITS))
    bitmap = own.groupBy(F.floor(bit / 63).alias("_word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(xxhash64(_row), {FILTER_BITS}L) % 63 as int)))").alias("_bits"))

    def split(df: DataFrame, hit: bool) -> DataFrame:
        """The rows that the bitmap lets through, or the others."""
        marked = df.withColumn("_bit", bit).join(F.broadcast(bitmap), F.floor(F.col("_bit") / 63) == F.col("_word"), "left")
        through = F.coalesce(F.expr("(shiftright(_bits, cast(_bit % 63 as int)) & 1) = 1"), F.lit(False))
        return marked.filter(through if hit else ~through).select(*df.columns)

    texts = pa.schema([("_row", pa.int64()), ("changed", pa.string())])

    def run(parts):
        made = ((r, main_text(p, frozenset(t))) for part in sliced(parts) for r, p, t in zip(*(c.to_pylist() for c in part.columns), strict=True))
        yield from tidy(batches(made, texts, weight=lambda r: 2 * len(r[1])))

    again = split(rows.select("_row", "_html"), True).join(own.hint("merge"), "_row").select("_row", "_html", "template").mapInArrow(run, "_row long, changed string")
    plain = seen.select("_row", "_key", "_url", "text")
    mended = split(plain, True).join(again.hint("merge"), "_row", "left").withColumn("text", F.coalesce("changed", "text")).drop("changed")
    every = split(plain, False).unionByName(mended)
    return every.select(F.col("_key").alias(key), F.col("_url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
