"""Leaves of JSON trees."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from babelyard.sources.slices import few

LEAVES = "path string, ordinal int, dot_path string, field string, leaf string, value string, error boolean"


def leaves(node, path: tuple[str, ...] = (), field: str | None = None) -> Iterator[tuple[str, str | None, str | None, str]]:
    """(dotted path, nearest object key, last segment, string) of every string, in order, without recursion."""
    stack = [(node, path, field)]
    while stack:
        node, path, field = stack.pop()
        if isinstance(node, str):
            yield ".".join(path), field, path[-1] if path else None, node
        elif isinstance(node, list):
            stack += [(x, (*path, str(k)), field) for k, x in reversed(list(enumerate(node)))]
        elif isinstance(node, dict):
            stack += [(x, (*path, k), k) for k, x in reversed(list(node.items()))]


def read_leaves(files: DataFrame) -> DataFrame:
    """files: path, content (JSON). A file that cannot be read gives one row with error."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in few(frames):
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    tree = json.loads(content.removeprefix("﻿"))
                    rows += [(path, k, *leaf, False) for k, leaf in enumerate(leaves(tree))]
                except (ValueError, AttributeError, RecursionError):
                    rows.append((path, 0, None, None, None, None, True))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LEAVES.split(", ")])

    return files.select("path", "content").mapInPandas(parse, LEAVES)


def unflatten(rows: list[tuple[list[str], str]]) -> dict:
    """A nested object from (path, value)."""
    out: dict = {}
    for path, value in rows:
        node = out
        for part in path[:-1]:
            node = node.setdefault(part, {})
        node[path[-1]] = value
    return out
