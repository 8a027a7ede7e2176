"""HTML and JATS to text."""

from __future__ import annotations

import re
import sys
from functools import partial

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Elements whose content is no text of the page.
SKIPPED = ("script", "style", "nav", "header", "footer", "aside")


def _closed_only(html: str) -> str:
    """html with each & escaped that begins no whole character reference with its semicolon."""
    from html.entities import html5

    known = lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + m[0][1:]
    return re.sub(r"&((?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)?", known, html)


def html_to_text(html: str | None, closed: bool = False) -> str:
    """The chunks of text outside of skipped elements, stripped, joined by single spaces.

    Character references are decoded as HTML has it, also where their semicolon is missing; closed: only with it.
    """
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        depth = 0

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.chunks: list[str] = []

        def handle_starttag(self, tag, attrs):
            self.depth += tag in SKIPPED

        def handle_endtag(self, tag):
            if tag in SKIPPED and self.depth:
                self.depth -= 1

        def handle_data(self, data):
            if not self.depth and data.strip():
                self.chunks.append(data.strip())

    reader = Reader()
    reader.feed(_closed_only(html or "") if closed else html or "")
    reader.close()
    return " ".join(reader.chunks)


def jats_to_text(xml: str | None) -> str:
    """The body's text of a JATS article, white space single; empty if it can't be parsed."""
    from xml.etree import ElementTree

    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return ""
    return " ".join(" ".join(t for b in root.iter() if b.tag.rpartition("}")[2] == "body" for t in b.itertext()).split())


def _each(f, c: Column) -> Column:
    from collections.abc import Iterator

    import pandas as pd

    def run(batches):
        for b in batches:
            yield pd.Series([f(x) for x in b], dtype="str")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(c)


def html_text(c: Column, closed: bool = False) -> Column:
    return _each(partial(html_to_text, closed=closed), c)


def jats_text(c: Column) -> Column:
    return _each(jats_to_text, c)
