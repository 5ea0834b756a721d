"""Edits of texts: ranges and what replaces them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from babelyard.sources import jsx
from babelyard.sources.files import SCRIPTS


def overlaps(edits: DataFrame, key: str = "path") -> DataFrame:
    """The edits that reach into the one that starts next after them; neighbours in order are enough to find them."""
    order = Window.partitionBy(key).orderBy(F.desc("start"), F.desc("end"))
    return edits.withColumn("next_end", F.lead("end").over(order)).where("next_end > start")


def first_of_each_range(edits: DataFrame, key: str = "path", order: str = "ordinal") -> DataFrame:
    """One edit for each (start, end): the first."""
    return edits.groupBy(key, "start", "end").agg(F.min_by("replacement", order).alias("replacement"))


def apply_edits(text: Column, edits: Column) -> Column:
    """The text with its edits, an array of struct(start, end, replacement), set in from the last to the first."""
    last_first = lambda a, b: F.coalesce(F.nullif(b["start"] - a["start"], F.lit(0)), b["end"] - a["end"])

    def splice(done: Column, e: Column) -> Column:
        return F.concat(F.substr(done, F.lit(1), e["start"]), e["replacement"], F.substr(done, e["end"] + 1))

    return F.aggregate(F.array_sort(edits, last_first), text, splice)


def _overlap(edits: Column) -> Column:
    """Whether an edit of an array in order reaches into the next one."""
    pairs = F.zip_with(F.slice(edits, F.lit(1), F.size(edits) - 1), F.slice(edits, F.lit(2), F.size(edits) - 1), lambda a, b: a["end"] > b["start"])
    return F.coalesce(F.exists(pairs, lambda x: F.coalesce(x, F.lit(False))), F.lit(False))


def edit_files(files: DataFrame, edits: DataFrame) -> DataFrame:
    """path, content, n_edits of all files. Files with overlapping edits stay as they are and have a null count.
    The edits are gathered by file, of which each has few; contents meet them once, and edits are made once."""
    gathered = edits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("edits"))
    joined = files.join(gathered.withColumn("bad", _overlap(F.col("edits"))), "path", "left")
    own = F.coalesce("edits", F.array().cast("array<struct<start:int,end:int,replacement:string>>"))
    return joined.select(
        "path",
        F.when(F.col("bad"), F.col("content")).otherwise(apply_edits(F.col("content"), own)).alias("content"),
        F.when(F.col("bad"), F.lit(None)).otherwise(F.size(own)).cast("int").alias("n_edits"),
    )


def readable(text: str | None, ext: str) -> bool:
    """Whether a component source can be parsed; other files always can."""
    if ext not in SCRIPTS:
        return True
    try:
        jsx.Source(text or "")
    except (SyntaxError, RecursionError):
        return False
    return True


def verify_edits(files: DataFrame, edited: DataFrame) -> DataFrame:
    """path, content, n_edits, failed of all files after a second parse of those that were edited.

    files: path, content; edited: what edit_files made of them. A file that could be read before its edits and can't any more goes back to
    its old content, and so does one whose edits overlap; failed says so. What could not be read before is left as it is.
    Each file is judged by itself, so one that fails stops no other.
    """
    both = files.select("path", F.col("content").alias("old")).join(edited.select("path", F.col("content").alias("new"), "n_edits"), "path")
    changed = both.withColumn("changed", F.coalesce(F.col("n_edits"), F.lit(0)) > 0)

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ends = [p[p.rfind(".") :] if "." in p else "" for p in frame["path"]]
            bad = [c and not readable(new, e) and readable(old, e) for old, new, c, e in zip(frame["old"], frame["new"], frame["changed"], ends, strict=True)]
            yield frame[["path", "old", "new"]].assign(n_edits=frame["n_edits"].astype("Int32"), broken=bad)

    judged = changed.mapInPandas(judge, "path string, old string, new string, n_edits int, broken boolean")
    failed = F.col("broken") | F.col("n_edits").isNull()
    return judged.select("path", F.when(failed, F.col("old")).otherwise(F.col("new")).alias("content"), F.when(failed, 0).otherwise(F.col("n_edits")).alias("n_edits"), failed.alias("failed"))
