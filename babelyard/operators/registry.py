"""Registry of data files: which fields hold display texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelyard.functions.text import classify
from babelyard.sources import jsx
from babelyard.sources.jsontree import read_leaves
from babelyard.sources.slices import few

LITERALS = "path string, ordinal int, dot_path string, field string, leaf string, value string, error boolean"


def _literals(text: str) -> Iterator[tuple[str, str | None, str | None, str]]:
    """Strings and plain templates of exported object literals, with the property that holds each."""
    source = jsx.Source(text)
    for own in source.objects:
        for p in own.properties:
            if not source.in_export(p.key_start):
                continue
            raw = text[p.value_start : p.value_end]
            if p.value is not None:
                yield p.key, p.key, p.key, p.value
            elif raw.startswith("`") and raw.endswith("`") and "${" not in raw:
                yield p.key, p.key, p.key, raw[1:-1]
            elif raw.startswith("[") and "{" not in raw:
                for k, m in enumerate(re.finditer(r"""(["'])((?:(?!\1)[^\\\n]|\\.)*)\1""", raw)):
                    yield f"{p.key}.{k}", p.key, str(k), m[2]


def read_script_leaves(files: DataFrame) -> DataFrame:
    """The leaves of exported literals in script files, which are read and never run."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in few(frames):
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows += [(path, k, *leaf, False) for k, leaf in enumerate(_literals(content or ""))]
                except (SyntaxError, RecursionError):
                    rows.append((path, 0, None, None, None, None, True))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LITERALS.split(", ")])

    return files.select("path", "content").mapInPandas(run, LITERALS)


def data_leaves(files: DataFrame) -> DataFrame:
    scripts, trees = files.where(F.col("path").endswith(".js")), files.where(F.col("path").endswith(".json"))
    return read_script_leaves(scripts).unionByName(read_leaves(trees))


def classified(leaves: DataFrame) -> DataFrame:
    return leaves.where("not error and field is not null").withColumn("class", classify(F.col("value")))


def registry(leaves: DataFrame) -> DataFrame:
    """path, field, class: distinct; a field may have several classes."""
    return classified(leaves).select("path", "field", "class").distinct()


def _translatable(leaves: DataFrame, own: DataFrame) -> DataFrame:
    return leaves.join(own.where("class = 'translatable'").select("path", "field").distinct(), ["path", "field"], "left_semi")


def data_keys(leaves: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """value of every leaf of a field that is translatable in its file, whatever the value itself would be."""
    own = own if own is not None else registry(leaves)
    return _translatable(leaves.where("not error and field is not null"), own).select("value").where("trim(value) <> ''").distinct()


def data_paths(leaves: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """path, dot_path, value of the leaves whose own last segment is a translatable field: items of
    plain lists are not among them."""
    own = own if own is not None else registry(leaves)
    held = _translatable(leaves.where("not error and field is not null"), own)
    return held.where("leaf = field").select("path", "dot_path", "value")


def promoted(leaves: DataFrame, messages: DataFrame, locale: str) -> DataFrame:
    """locale, key, value: values that are translatable themselves, as their own keys, where the locale has none."""
    values = classified(leaves).where("class = 'translatable'").select(F.col("value").alias("key")).distinct()
    fresh = values.join(messages.where(F.col("locale") == locale).select("key"), "key", "left_anti")
    return fresh.select(F.lit(locale).alias("locale"), "key", F.col("key").alias("value"))


def values_per_file(leaves: DataFrame) -> DataFrame:
    """path, n_values: distinct translatable values of each file."""
    return classified(leaves).where("class = 'translatable'").groupBy("path").agg(F.count_distinct("value").alias("n_values"))
