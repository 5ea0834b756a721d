"""Source files as tables: path, ext, content."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from babelyard.functions import lookups as L
from babelyard.sources.trees import list_tree, read_contents

SCHEMA = "path string, ext string, content string"
SCRIPTS = (".js", ".jsx", ".ts", ".tsx")
#: Folders that each walk leaves out, and the endings that it keeps.
WALKS = {
    "sources": (("node_modules", ".git", "build", "dist", ".next"), (*SCRIPTS, ".css")),
    "scripts": (("node_modules", ".git", "build", "dist", ".next"), SCRIPTS),
    "sync": (("node_modules", ".next", "dist", "build"), SCRIPTS),
    "classes": (("node_modules", ".next", "dist", "build"), SCRIPTS),
    "doctor": ((), SCRIPTS),
}


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def read_tree(spark: SparkSession, roots: list[str], base: str | None = None, kind: str | None = None) -> DataFrame:
    """All files below the roots that exist, or those that one of the WALKS visits; paths are relative to base. A root that is missing is empty.

    Of a walk's ignored folders nothing is listed, and of files with other endings nothing is read (`trees`).
    Folders whose name begins with a dot hold no sources, for any walk.
    """
    pruned, endings = WALKS[kind] if kind else ((), ())
    rows = read_contents(list_tree(spark, roots, pruned, endings, dotted=False))
    full = F.regexp_replace("path", "^file:/+", "/")
    name = F.regexp_replace(full, "^" + re.escape(base.rstrip("/") + "/"), "") if base else full
    return rows.select(name.alias("path"), extension(name).alias("ext"), "content")


def walk(files: DataFrame, kind: str) -> DataFrame:
    """The files that one of the WALKS visits."""
    pruned, endings = WALKS[kind]
    kept = files.where(F.col("ext").isin(*endings))
    if pruned:
        kept = kept.where(~F.col("path").rlike("(^|/)(?:" + "|".join(map(re.escape, pruned)) + ")/"))
    return kept


def discover_sources(files: DataFrame) -> DataFrame:
    """Sources below src, app, pages and components; if there are none, all outside tools' folders."""
    sources = walk(files, "sources")
    rooted = sources.where(F.col("path").rlike("^(?:" + "|".join(L.SOURCE_ROOTS) + ")/"))
    if not rooted.isEmpty():
        return rooted
    return sources.where(~F.col("path").rlike(r"node_modules|\.git|packages|config"))


def data_files(files: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Data files: .js and .json below src in a data folder, and those named explicitly."""
    held = F.col("path").rlike("(?:" + "|".join(L.DATA_FILE_FOLDERS) + ")")
    kinds = files.where(F.col("ext").isin(".js", ".json"))
    return kinds.where((F.col("path").startswith("src/") & held) | F.col("path").isin(list(extra))).dropDuplicates(["path"])


def read_messages(files: DataFrame, folder: str = "src/i18n/messages") -> DataFrame:
    """locale, key, value of flat message files; of a repeated key the last counts. Files that
    are no JSON object give no rows."""
    own = files.where(F.col("path").rlike(f"(^|/){re.escape(folder)}/[^/]+\\.json$"))
    locale = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    parsed = F.from_json(F.regexp_replace("content", "^﻿", ""), "map<string,string>")
    return own.select(locale.alias("locale"), F.explode(parsed).alias("key", "value"))


def first_existing(files: DataFrame, candidates: list[str]) -> DataFrame:
    """One row: the path of the first candidate that is a file, or null."""
    ranks = files.sparkSession.createDataFrame([(c, k) for k, c in enumerate(candidates)], "path string, rank int")
    # one row for each candidate
    return files.join(F.broadcast(ranks), "path").agg(F.min_by("path", "rank").alias("path"))


def read_locales(files: DataFrame) -> DataFrame:
    """code, is_default from a locales module."""
    own = files.where(F.col("path").rlike(r"(^|/)i18n/locales\.(?:ts|js)$"))
    codes = F.regexp_extract_all("content", F.lit(r"""code\s*:\s*['"]([^'"]+)['"]"""), F.lit(1))
    main = F.regexp_extract("content", r"""defaultLocale(?:\s*:\s*\w+)?\s*=\s*['"]([^'"]+)['"]""", 1)
    return own.select(F.explode(codes).alias("code"), main.alias("main")).select("code", (F.col("code") == F.col("main")).alias("is_default"))
