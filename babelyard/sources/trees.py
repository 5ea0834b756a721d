"""File trees, listed and read in tasks: a folder that is left out is never opened, and the driver sees no file."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from babelyard.sources.scratch import written

ENTRIES = "path string, is_folder boolean, size long"
CONTENTS = "path string, content string"
#: Bytes of files that one task reads, and of texts that cross to the JVM at once.
TASK_BYTES, BATCH_BYTES = 1 << 26, 1 << 22


def _system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it. Names in a path stand as they are, without escapes."""
    parts = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://([^/]*)(/.*)?$", path)
    if not parts or parts[1] == "file":
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    system, top = fs.FileSystem.from_uri(f"{parts[1]}://{parts[2]}/")
    return system, top.rstrip("/") + (parts[3] or "/")


def _entries(folder: str, pruned: frozenset[str], endings: tuple[str, ...], dotted: bool = True) -> Iterator[tuple[str, bool, int]]:
    """(path, is folder, size) of what lies in a folder and is kept; a folder that isn't there is empty."""
    system, inner = _system(folder)
    local = isinstance(system, fs.LocalFileSystem)
    for own in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
        path = f"{folder.rstrip('/')}/{own.base_name}"
        if own.type == fs.FileType.Directory:
            hidden = own.base_name in pruned or (own.base_name.startswith(".") and not dotted)
            if not hidden and not (local and os.path.islink(own.path)):
                yield path, True, 0
        elif own.type == fs.FileType.File and (not endings or own.base_name.endswith(endings)):
            yield path, False, own.size


def list_tree(spark: SparkSession, roots: Sequence[str], pruned: Sequence[str] = (), endings: Sequence[str] = (), dotted: bool = True) -> DataFrame:
    """path, size of all files below the roots whose name has one of the endings (all, if none is given).

    Folders with a name in pruned aren't opened, at any depth, nor are, with dotted=False, those with a name that begins with
    a dot; the roots themselves are, whatever their name. A root that is missing is empty; one that can't be read is an error.
    Links to folders are not followed, so no tree is endless. Paths begin as their root does; a file below two
    roots counts once.

    The tree is listed level by level: the folders of a level are dealt over tasks and each listed once. So there are as many
    rounds as levels, and a large subtree is listed by many tasks.
    """
    left_out, kept = frozenset(pruned), tuple(endings)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = list(_entries(folder, left_out, kept, dotted))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.int64())],
                    ["path", "is_folder", "size"],
                )

    found = spark.createDataFrame([], ENTRIES)
    folders = spark.createDataFrame([(r,) for r in dict.fromkeys(r.rstrip("/") or "/" for r in roots)], "path string")
    while not folders.isEmpty():
        dealt = folders.repartition(spark.sparkContext.defaultParallelism, "path")
        level = written(dealt.mapInArrow(read, ENTRIES), "folders")
        found = found.unionByName(level.where("not is_folder"))
        folders = level.where("is_folder").select("path")
    # of roots that lie in each other a file is found twice
    return (found if len(roots) < 2 else found.dropDuplicates(["path"])).select("path", "size")


def read_contents(listed: DataFrame) -> DataFrame:
    """path, content of listed files, as UTF-8 (what is none is replaced). Files are dealt over tasks by their path, into as many as their bytes need,
    so a folder that holds most of them is read by many. A file that has gone since gives no row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, inner = _system(path)
                try:
                    with system.open_input_stream(inner) as stream:
                        content = stream.read()
                except FileNotFoundError:
                    continue
                rows.append((path, content.decode("utf-8", "replace")))
                held += len(content)
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    spark = listed.sparkSession
    size = listed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, size // TASK_BYTES + 1)
    return listed.select("path").repartition(tasks, "path").mapInArrow(read, CONTENTS)


def _batch(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["path", "content"])
