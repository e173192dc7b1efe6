"""Readable text of HTML pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DROPPED = {"sup", "table", "aside", "span", "figure"}
WANTED = {"h2", "h3", "h4", "p", "li"}
MOST = 60_000


class _Reader(HTMLParser):
    """Collects the text of wanted elements in document order; nested ones give their text twice."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []  # tag, dropped?, slot of the wanted element or None
        self.slots: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "hr", "meta", "link", "input", "wbr"):
            return
        if tag in ("p", "li") and self.open and self.open[-1][0] == tag:  # a new one ends the last
            self.open.pop()
        slot = None
        if tag in WANTED and not any(o[1] for o in self.open):
            slot = len(self.slots)
            self.slots.append([])
        self.open.append([tag, tag in DROPPED, slot])

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if any(o[1] for o in self.open) or any(o[0] in ("script", "style") for o in self.open):
            return
        piece = data.strip()
        if piece:
            for o in self.open:
                if o[2] is not None:
                    self.slots[o[2]].append(piece)


def article_text(html: str | None, most: int = MOST) -> str:
    if not html:
        return ""
    reader = _Reader()
    reader.feed(html)
    out, size = [], 0
    for slot in reader.slots:
        line = " ".join(slot)
        if line:
            out.append(line)
            size += len(line)
            if size > most:
                break
    return "\n".join(out)[:most]


@F.pandas_udf(StringType())
def article(html: pd.Series) -> pd.Series:
    """Headings, paragraphs and list items of each page, as text."""
    return html.map(article_text)
