"""Markup to rows of cells: table rows where a layout is made of tables, else lines of text."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.fixed import LINE_ENDS

_DROPPED = {"script", "style", "head", "title"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_LINES = re.compile(LINE_ENDS)
#: Fixed value: fewer rows of cells than this are taken for layout.
LEAST_ROWS = 3


class _Rows(HTMLParser):
    """Collects texts in document order; cells of innermost rows. Open rows form a stack."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.rows: list[dict] = []
        self.open: list[dict] = []
        self.muted: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in _DROPPED:
            self.muted.append(tag)
        elif self.muted:
            return
        elif tag == "br":
            self._say("\n")
        elif tag == "tr":
            for row in self.open:
                row["inner"] = False
            self.open.append({"cells": [], "inner": True, "cell": []})
            self.rows.append(self.open[-1])
        elif tag in ("td", "th") and self.open:
            self.open[-1]["cell"].append([])
            self.open[-1]["cells"].append(self.open[-1]["cell"][-1])

    def handle_startendtag(self, tag, attrs):
        if tag in _VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.muted:
            if tag in self.muted:
                del self.muted[self.muted.index(tag) :]
        elif tag == "tr" and self.open:
            self.open.pop()
        elif tag in ("td", "th") and self.open and self.open[-1]["cell"]:
            self.open[-1]["cell"].pop()

    def _say(self, text: str):
        self.texts.append(text)
        for row in self.open:
            for cell in row["cell"]:
                cell.append(text)

    def handle_data(self, data):
        if not self.muted:
            self._say(data)


def _tight(text: str) -> str:
    return " ".join(text.split())


def _table_rows(parser: _Rows) -> list[list[str]]:
    """Cells with text of the innermost rows that have one."""
    found = []
    for row in parser.rows:
        texts = [_tight(" ".join(pieces)) for pieces in row["cells"]] if row["inner"] else []
        if any(texts):
            found.append([t for t in texts if t])
    return found


def structured_rows(html: str | None) -> list[list[str]]:
    """Cells of each innermost table row, empty ones left out; with fewer than three such rows one cell per line of text."""
    parser = _Rows()
    parser.feed(html or "")
    parser.close()
    table = _table_rows(parser)
    if len(table) >= LEAST_ROWS:
        return table
    return [[line] for line in map(_tight, _LINES.split("\n".join(parser.texts))) if line]


def html_to_text(html: str | None) -> str:
    """Rows as lines, their cells three spaces apart."""
    return "\n".join("   ".join(row) for row in structured_rows(html))


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def html_rows(html: pd.Series) -> pd.Series:
    """structured_rows of a column; no built-in function parses markup."""
    return html.map(structured_rows)


def rows_to_text(rows):
    """html_to_text of parsed rows, as a column expression."""
    return F.array_join(F.filter(F.transform(rows, lambda r: F.trim(F.array_join(r, "   "))), lambda x: x != ""), "\n")
