"""Declarations of style sheets, with their places in the source."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from babelyard.sources.slices import few

DECLARATIONS = (
    "path string, ordinal int, prop string, value string, important boolean, parts array<string>, start int, end int, indent string"
)


#: All that a sheet's structure hangs on; between them nothing has to be looked at.
SIGNS = re.compile(r"/\*|[\"'(){};]")
VALUE_SIGNS = re.compile("[\"'() \n\t]")


@dataclass
class Declaration:
    prop: str
    value: str
    important: bool
    start: int
    end: int
    indent: str


def _skip(text: str, at: int) -> int:
    """The end of the comment or string that begins at `at`, or `at`."""
    if text.startswith("/*", at):
        end = text.find("*/", at + 2)
        return len(text) if end < 0 else end + 2
    if text[at] in "\"'":
        end = at + 1
        while end < len(text) and text[end] != text[at] and text[end] != "\n":
            end += 2 if text[end] == "\\" else 1
        return min(end + 1, len(text))
    return at


def declarations(text: str) -> list[Declaration]:
    """All declarations, in nested rules too. What is not closed ends with the text."""
    found, start, at, depth = [], 0, 0, 0
    while at <= len(text):
        mark = SIGNS.search(text, at)
        at = mark.start() if mark else len(text)
        if mark and (end := _skip(text, at)) > at:
            at = end
            continue
        sign = text[at] if at < len(text) else "}"
        if sign == "(":
            depth += 1
        elif sign == ")":
            depth = max(0, depth - 1)
        elif sign in "{};" and (not depth or sign != ";"):
            if sign != "{" and (own := _declaration(text, start, at)):
                found.append(own)
            start, depth = at + 1, 0
        at += 1
    return found


def _declaration(text: str, start: int, end: int) -> Declaration | None:
    raw = text[start:end]
    clean = re.sub(r"/\*.*?\*/", lambda m: " " * len(m[0]), raw, flags=re.S) if "/*" in raw else raw
    match = re.match(r"(\s*)([-\w$*]+)\s*:\s*(.*?)\s*$", clean, re.S)
    if not match or not match[3] or match[2].startswith("@"):
        return None
    value = raw[match.start(3) : match.end(3)].strip()
    bare = re.sub(r"\s*!\s*important\s*$", "", value, flags=re.I) if "!" in value else value
    return Declaration(match[2], bare, bare != value, start + match.start(2), start + match.end(3), match[1])


def space_parts(value: str) -> list[str]:
    """A value's parts between spaces; parentheses and quotes hold together."""
    parts, start, depth, quote = [], 0, 0, ""
    for mark in VALUE_SIGNS.finditer(value):
        sign = mark[0]
        if quote:
            quote = "" if sign == quote else quote
        elif sign in "\"'":
            quote = sign
        elif sign in "()":
            depth = max(0, depth + (1 if sign == "(" else -1))
        elif not depth:
            parts += [value[start : mark.start()]] if mark.start() > start else []
            start = mark.end()
    return parts + ([value[start:]] if start < len(value) else [])


def read_declarations(files: DataFrame) -> DataFrame:
    """files: path, content. One row for each declaration; start and end count characters."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in few(frames):
            rows = [
                (path, k, d.prop, d.value, d.important, space_parts(d.value), d.start, d.end, d.indent)
                for path, content in zip(frame["path"], frame["content"], strict=True)
                for k, d in enumerate(declarations(content) if isinstance(content, str) else ())
            ]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DECLARATIONS.split(", ")])

    return files.select("path", "content").mapInPandas(parse, DECLARATIONS)
