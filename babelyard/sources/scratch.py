"""Intermediate tables where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ADVISORY_CONF = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def shared_folder(spark: SparkSession) -> str:
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


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own: lineage is cut, and a lost executor costs its running tasks only."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows, which plans know to be empty: what is joined with it goes. Of createDataFrame's they don't, and Python
    workers of its own make it, one a core."""
    return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema))).where("false")


@contextmanager
def shuffles_freed(spark: SparkSession, advisory: str) -> Iterator[None]:
    """A query that is run inside leaves no shuffle files as it ends; else they stay until the driver happens to collect its
    garbage. Small partitions are joined to no more than `advisory` bytes. The session's own settings hold again afterwards."""
    own = {k: spark.conf.get(k, None) for k in (CLEANUP_CONF, ADVISORY_CONF)}
    try:
        spark.conf.set(CLEANUP_CONF, "true")
        spark.conf.set(ADVISORY_CONF, advisory)
        yield
    finally:
        for k, v in own.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
