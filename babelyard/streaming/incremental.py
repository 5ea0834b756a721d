"""Incremental runs: only files whose contents changed since the last one."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from babelyard.functions import lookups as L
from babelyard.operators import keys
from babelyard.operators.sync import changed_files, deep_merge, next_state, seed_locales
from babelyard.plans.lifecycle import Config, extract_project
from babelyard.sources import files as sources
from babelyard.sources.scratch import empty, written

STATE = "path string, sha256 string"
FORMAT = "hash-v1"


class FileState:
    """Versions of (path, sha256), one folder each, written after a run has succeeded."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        system = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(folder):
            return []
        names = [s.getPath().getName() for s in system.listStatus(folder)]
        done = [n for n in names if n.startswith(f"{FORMAT}-") and n[len(FORMAT) + 1 :].isdigit()]
        full = [n for n in done if system.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[len(FORMAT) + 1 :]) for n in full)

    def read(self) -> DataFrame:
        """The last version; empty where there is none, or only of another format: then everything counts as changed."""
        versions = self.versions()
        if not versions:
            return empty(self.spark, STATE)
        return self.spark.read.schema(STATE).parquet(f"{self.path}/{FORMAT}-{versions[-1]}")

    def write(self, state: DataFrame) -> None:
        version = (self.versions() or [0])[-1] + 1
        state.select("path", "sha256").write.mode("overwrite").parquet(f"{self.path}/{FORMAT}-{version}")


def incremental_run(files: DataFrame, state: FileState, work: Callable[[DataFrame], DataFrame | None]) -> bool:
    """Calls work with the changed files, and keeps the new state after it: of the files that work
    returns (path, content) if it rewrites them, else of those it got. False if nothing changed."""
    changed = changed_files(files, state.read()).drop("sha256")
    if changed.isEmpty():
        return False
    after = work(changed)
    new = next_state(after if after is not None else changed)
    kept = files.select("path", F.sha2("content", 256).alias("sha256")).join(new.select("path"), "path", "left_anti")
    state.write(kept.unionByName(new))
    return True


def stream_files(spark: SparkSession, folder: str, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """The same for files that keep arriving: each micro-batch has the files that are new in the folder, and
    the checkpoint remembers which were done."""
    stream = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    files = stream.select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("_metadata.file_path", r"(\.[^./]*)$", 1).alias("ext"), F.col("value").alias("content"))
    return files.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


MESSAGES = "locale string, key string, value string"


class SyncStore:
    """What incremental runs leave behind: for each batch the tables of TABLES, written by one attempt.

    An attempt writes a folder of its own; the batch counts from the moment its marker exists, which names the attempt. A
    marker is created or it fails: of two attempts at one batch, one counts. What no marker names is never read.
    """

    TABLES = {"files": STATE, "messages": MESSAGES, "key_map": keys.MAP, "sources": "path string, content string"}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, *names: str):
        own = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))
        return own, own.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        """Batches that count, by number; markers are a few bytes each, all in one folder."""
        own, system = self._at(f"{FORMAT}-commits")
        if not system.exists(own):
            return []
        names = [s.getPath().getName() for s in system.listStatus(own)]
        return sorted(int(n) for n in names if n.isdigit())

    def attempt(self, batch: int) -> str:
        own, system = self._at(f"{FORMAT}-commits", str(batch))
        stream = system.open(own)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, name: str, batch: int | None = None) -> DataFrame:
        """A table after a batch, the last one if none is named; empty before the first."""
        done = self.committed()
        if not done or batch is not None and batch not in done:
            return empty(self.spark, self.TABLES[name])
        batch = done[-1] if batch is None else batch
        return self.spark.read.schema(self.TABLES[name]).parquet(f"{self.path}/{self.attempt(batch)}/{name}")

    def commit(self, batch: int, tables: dict[str, DataFrame]) -> bool:
        """Writes the tables; False, and nothing changes, if the batch counts already."""
        attempt = f"batch-{batch}-{uuid.uuid4().hex}"
        for name, schema in self.TABLES.items():
            columns = [c.split()[0] for c in schema.split(", ")]
            tables[name].select(*columns).write.parquet(f"{self.path}/{attempt}/{name}")
        marker, system = self._at(f"{FORMAT}-commits", str(batch))
        if system.exists(marker):
            return False
        stream = system.create(marker, False)
        stream.write(bytearray(attempt.encode()))
        stream.close()
        return True


def sync_batch(files: DataFrame, store: SyncStore, batch: int, config: Config, complete: bool = True) -> bool:
    """One incremental run: display texts of the changed sources are extracted, the sources rewritten, their keys added to every
    locale, and all of it kept under the batch's number. False if the batch was done before or nothing changed.

    The kept hash of a rewritten file is that of its new content, so it isn't read again as a change. complete: files is the
    whole project, and files that are gone are forgotten; else it has what arrived, and the others stay known. Messages: what the
    message files hold goes over what is kept; the default locale gets the text of a new key, others an empty one.
    """
    if batch in store.committed():
        return False
    before = {name: store.read(name) for name in store.TABLES}
    rooted = F.col("path").rlike("^(?:" + "|".join(map(re.escape, L.SOURCE_ROOTS)) + ")/")
    code = sources.walk(files, "scripts").where(rooted)
    changed = written(changed_files(code, before["files"]), "changed")
    if changed.isEmpty():
        return False
    data = sources.data_files(files, config.data_files) if complete else None
    done = extract_project(changed.drop("sha256"), data, before["key_map"])
    after = written(done.files.select("path", "content"), "after")
    keyed = written(done.keyed.where("key is not null"), "keyed")
    hashed = code.select("path", F.sha2("content", 256).alias("sha256")) if complete else before["files"]
    state = hashed.join(changed.select("path"), "path", "left_anti").unionByName(next_state(after))
    held = deep_merge(before["messages"], sources.read_messages(files))
    last = F.struct("path", "pos")
    found = keyed.groupBy("key").agg(F.max_by("value", last).alias("value"))
    locales = list(dict.fromkeys([config.default_language, *config.languages]))
    messages = seed_locales(held, found, locales, config.default_language)
    key_map = keys.next_key_map(keyed.where("text_hash is not null"), before["key_map"])
    rewritten = after.join(changed.select("path", F.col("sha256").alias("old")), "path").where(F.sha2("content", 256) != F.col("old"))
    return store.commit(batch, {"files": state, "messages": messages, "key_map": key_map, "sources": rewritten})


def stream_sync(spark: SparkSession, folder: str, store: SyncStore, config: Config, checkpoint: str) -> StreamingQuery:
    """sync_batch for every micro-batch of files that arrive below folder, under the micro-batch's number: a batch that
    Spark runs again after a failure changes nothing if it was kept before."""
    base = re.escape(re.sub(r"^file:/+", "/", folder.rstrip("/"))) + "/"

    def work(arrived: DataFrame, batch: int) -> None:
        inside = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{base}", "")
        sync_batch(arrived.withColumn("path", inside), store, batch, config, complete=False)

    return stream_files(spark, folder, work, checkpoint)
