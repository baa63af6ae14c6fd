"""Markdown of answers, tidied: line ends, blank lines, and list markers that stand alone."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of list markers alone on a line, of list items, and of fenced code (to its end or the text's).
MARKER = re.compile(r"(\s*)([-+*]|\d+[.)])\s*")
ITEM = re.compile(r"(\s*)(?:[-+*]|\d+[.)])\s+\S")
FENCED = r"^[^\S\n]*(?P<run>(?P<mark>[`~])(?P=mark){2,})[^\n]*(?:\n(?![^\S\n]*(?P=run)(?P=mark)*[^\S\n]*$)[^\n]*)*(?:\n[^\S\n]*(?P=run)(?P=mark)*[^\S\n]*$)?"
UNIT = re.compile(rf"(?P<fence>{FENCED})|^[^\n]*\S[^\n]*$", re.M)


def _units(text: str) -> Iterator[tuple[bool, str, str]]:
    """Fenced stretches and lines that aren't blank: whether blank lines go before, the first line as given, and what is shown.

    A list marker alone takes the next line's text if that is no code, no marker, and indented by spaces, three more at most.
    """
    at = 0
    while unit := UNIT.search(text, at):
        given, end = unit[0], unit.end()
        shown, gap = given, text.count("\n", at, unit.start()) > 1
        bare = None if unit["fence"] else MARKER.fullmatch(given)
        after = UNIT.search(text, end) if bare else None
        if after and not after["fence"] and not MARKER.fullmatch(after[0]):
            margin = after[0][: len(after[0]) - len(after[0].lstrip(" \t"))]
            if "\t" not in margin and len(margin) <= len(bare[1]) + 3:
                shown, end = f"{bare[1]}{bare[2]} {after[0].lstrip()}", after.end()
        yield gap, given.partition("\n")[0], shown
        at = end


def normalize_markdown(text: str | None) -> str | None:
    """Blank runs become one blank line, none between sibling items or at the edges; fenced code stays as it is."""
    if text is None:
        return None
    out: list[str] = []
    for gap, first, shown in _units(text.replace("\r\n", "\n").replace("\r", "\n")):
        if gap and out:
            one, two = ITEM.match(out[-1]), ITEM.match(first)
            if not (one and two and len(one[1]) == len(two[1])):
                out.append("")
        out += shown.split("\n")
    return "\n".join(out).rstrip("\n")


def normalized_markdown(text: Column) -> Column:
    def read(given: pd.Series) -> pd.Series:
        return given.map(normalize_markdown)

    return F.pandas_udf(read, "string")(text)
