"""HTML to text without third-party parsers."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose content isn't text of the page, elements without an end tag, and the roots looked for in order (fixed values).
DROPPED = frozenset(("script", "style", "nav", "header", "footer", "aside", "noscript", "form"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
ROOTS = ("article", "main", "body")


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.title: str | None = None
        self.in_title = False
        #: text parts per root, of its first occurrence, and how deep it is open
        self.parts: dict[str, list[str]] = {}
        self.depth: dict[str, int] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "title" and self.title is None:
            self.title, self.in_title = "", True
        if tag in VOID:
            return
        self.open.append(tag)
        if tag in ROOTS and tag not in self.parts and not DROPPED.intersection(self.open):
            self.parts[tag], self.depth[tag] = [], len(self.open)

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if tag in self.open:
            while self.open.pop() != tag:
                pass
            for root, d in [*self.depth.items()]:
                if d > len(self.open):
                    del self.depth[root]

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not DROPPED.intersection(self.open):
            for root in self.depth:
                self.parts[root].append(data)


def page_text(html: str) -> tuple[str, str]:
    """(title, text): the title is read before anything is dropped; the text is that of the first article, main or body."""
    p = _Page()
    p.feed(html)
    p.close()
    text = next((p.parts[r] for r in ROOTS if r in p.parts), [])
    return (p.title or "").strip(), " ".join(" ".join(t.strip() for t in text if t.strip()).split())


def extract(html: Column) -> Column:
    """struct(title, text) of an HTML page; null for null, empty strings for an empty page."""

    @F.pandas_udf("struct<title:string,text:string>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if h is None else page_text(h) for h in s], columns=["title", "text"])

    return run(html)
