"""A small document tree over the standard tokenizer: elements with attributes, parents and places, and implied end tags."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

# Fixed values of HTML: elements without content, and what a start tag ends when it stands open.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
WALLS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}


class Element:
    __slots__ = ("tag", "attributes", "parent", "children", "start", "end")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None, start: int) -> None:
        self.tag, self.attributes, self.parent, self.children, self.start, self.end = tag, attributes, parent, [], start, start

    def release(self) -> None:
        """No element below knows its parent any more, so the tree goes with its last reader and waits for no collector."""
        for e in self.elements():
            e.parent = None

    def get(self, name: str) -> str:
        return self.attributes.get(name) or ""

    def elements(self) -> Iterator[Element]:
        """All elements below, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Element)]
        while todo:
            one = todo.pop()
            yield one
            todo += [c for c in reversed(one.children) if isinstance(c, Element)]

    def kids(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def find(self, fit: Callable[[Element], bool]) -> Element | None:
        return next((e for e in self.elements() if fit(e)), None)

    def closest(self, fit: Callable[[Element], bool]) -> Element | None:
        one: Element | None = self
        while one is not None and not fit(one):
            one = one.parent
        return one

    def holds(self, other: Element) -> bool:
        return self.start <= other.start and other.end <= self.end

    def text(self, skip: Callable[[Element], bool] = lambda e: False, line: str = "") -> str:
        """Text of all below but what is skipped; `line` stands for line breaks."""
        out, todo = [], list(reversed(self.children))
        while todo:
            one = todo.pop()
            if isinstance(one, str):
                out.append(one)
            elif one.tag == "br":
                out.append(line)
            elif not skip(one):
                todo += reversed(one.children)
        return "".join(out)

    def beside(self, step: int) -> Element | None:
        around = self.parent.kids() if self.parent else []
        at = next((k for k, e in enumerate(around) if e is self), -1) + step
        return around[at] if 0 <= at < len(around) else None


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.count = 0
        self.root = Element("#document", {}, None, 0)
        self.open = [self.root]

    def _pop_to(self, k: int) -> None:
        for e in self.open[k:]:
            e.end = self.count
        del self.open[k:]

    def _end_open(self, tags: tuple[str, ...] | frozenset[str], walls: tuple[str, ...]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in walls:
                return
            if self.open[k].tag in tags:
                self._pop_to(k)
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P:
            self._end_open(("p",), ("article", "section", "div", "table", "td", "th", "li", "blockquote", "body", "button", "main"))
        for _ in CLOSES.get(tag, ()):
            self._end_open(CLOSES[tag], WALLS[tag])
        self.count += 1
        made = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.open[-1], self.count)
        made.end = self.count
        self.open[-1].children.append(made)
        if tag not in VOID:
            self.open.append(made)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and (tag in ("svg", "path", "math") or self.open[-1].parent.closest(lambda e: e.tag in ("svg", "math"))):
            self._pop_to(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                self._pop_to(k)
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(page: str) -> Element:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    builder._pop_to(1)
    builder.root.end = builder.count + 1
    return builder.root
