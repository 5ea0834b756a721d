"""Elements of HTML documents."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelyard.sources.slices import few

#: Stands for the elements of a page that can't be parsed; no element can have this name.
PARSE_ERROR = "#error"
ELEMENTS = "doc long, ordinal int, tag string, attrs map<string,string>"


class _Elements(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, dict[str, str]]] = []

    def handle_starttag(self, tag, attrs):
        own: dict[str, str] = {}
        for name, value in attrs:
            own.setdefault(name, value or "")
        self.found.append((tag, own))


def elements(html: str | None) -> list[tuple[str, dict[str, str]]]:
    """(tag, attributes) of every element in order; what stands in comments and scripts is none. A text that can't be
    parsed has PARSE_ERROR as its only one."""
    parser = _Elements()
    try:
        parser.feed(html or "")
        parser.close()
    except (AssertionError, ValueError):  # how the standard parser gives up, on unknown marked sections for one
        return [(PARSE_ERROR, {})]
    return parser.found


def read_elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """doc, ordinal, tag, attrs: one row for each element of each page."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in few(frames, "html"):
            rows = [
                (doc, k, tag, attrs)
                for doc, html in zip(frame["doc"], frame["html"], strict=True)
                for k, (tag, attrs) in enumerate(elements(html if isinstance(html, str) else None))
            ]
            yield pd.DataFrame(rows, columns=["doc", "ordinal", "tag", "attrs"])

    return pages.select(F.col(id_col).cast("long").alias("doc"), F.col(html_col).alias("html")).mapInPandas(parse, ELEMENTS)
