"""Reading inputs, writing intermediate tables where every executor can read them, and joins with hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes: list[list[str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one in
    local mode, as in tests; a cluster has to name one that all its machines share."""
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="babelyard-")
        spark.conf.set(CHECKPOINT_CONF, root)
    return f"{root.rstrip('/')}/babelyard-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str, stays: bool = False, scope: list[str] | None = None) -> DataFrame:
    """Write df to the shared scratch folder and read it back: lineage is cut, a lost executor
    costs its running tasks only, and the planner knows the table's size. stays: a scratch_scope keeps it;
    scope: it belongs to this one, not to the innermost."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if scope is not None:
        scope.append(path)
    elif _scopes and not stays:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_counted(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """materialise(), and aggregates of the rows that are worked out as they are written."""
    seen = Observation()
    table = materialise(df.observe(seen, *(c.alias(k) for k, c in metrics.items())), name)
    return table, seen.get


def _delete(spark: SparkSession, path: str) -> None:
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes the tables written inside it as it ends; what was read from them must be written by then."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """A query that is run inside leaves no shuffle files as it ends; else they stay until the driver happens to collect its
    garbage. For steps that are written once each. The session's own setting holds again afterwards."""
    own = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_CONF) if own is None else spark.conf.set(CLEANUP_CONF, own)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables. Results that were not yet written need them."""
    _delete(spark, scratch_root(spark))


def fold(id_col: str, folds: int):
    """crc32 of the id's decimal text, modulo folds: the fold that an id belongs to."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def spread_join(many: DataFrame, few: DataFrame, key: str, by: str, counts: DataFrame | None = None, total: int | None = None, least: int = 100, hot_keys: int = 1000, how: str = "inner") -> DataFrame:
    """many joined with few (one row a key) on key, where one key may hold most rows of many. how: inner or left.

    A key with over max(least, rows / hot_keys) rows is hot, so there are at most hot_keys of them, whatever the
    size, and their list can be broadcast. The rows of a hot key are dealt over as many parts as it is hot by a
    hash of the column `by`, and its row of few is copied to each part. counts (key, n) says how many rows of many
    a key has, total how many there are; what isn't given is counted, and many should then be a written table.
    """
    if counts is None:
        counts = many.groupBy(key).agg(F.count("*").alias("n"))
    if total is None:
        total = counts.agg(F.sum("n")).first()[0] or 0
    share = max(least, -(-total // hot_keys))
    parts = F.ceil(F.col("n") / share).cast("int").alias("__parts")
    hot = counts.where((F.col("n") > share) & F.col(key).isNotNull()).select(F.col(key).alias("__hot"), parts)
    place = F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by, F.lit(31)), F.col("__parts")))
    left = many.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__part", place.cast("int")).drop("__hot", "__parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))
    right = few.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__part", copies).drop("__hot", "__parts")
    return left.join(right, [key, "__part"], how).drop("__part")
