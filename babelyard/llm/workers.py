"""What a reused Python worker holds between tasks: one model, whatever stages it has served.

A worker outlives the stage that it was started for. Were each module to keep its own model there, a
pipeline's last stage would carry the models of all stages before it.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import SparkSession

BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that cross to Python at once, where the session keeps Spark's own value: whole texts make wide rows.
BATCH_ROWS, SPARK_ROWS = 1000, 10_000

_held: dict[str, Any] = {}


def release() -> None:
    """Let go of the held model, and give freed memory back to the system."""
    if not _held:
        return
    import pyarrow as pa

    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass  # another C library has no such call


def hold(key: Hashable, build: Callable[[], Any]) -> Any:
    """The model of this key; one of another key goes first."""
    if _held.get("key") != key:
        release()
        _held.update(key=key, model=build())
    return _held["model"]


def bound_batches(spark: SparkSession) -> None:
    """Fewer rows a batch, unless the session says otherwise than Spark does."""
    if int(spark.conf.get(BATCH_CONF)) == SPARK_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


def pieces(batch: Any, column: str, most_bytes: int = 1 << 22) -> Iterator[Any]:
    """Slices of a record batch, in order, with few bytes of the column each; a longer text is a slice of its own. Lists of
    words take many times the room of their text."""
    import pyarrow.compute as pc

    begin, held = 0, 0
    for k, size in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        size = size or 0
        if k > begin and held + size > most_bytes:
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """At most so many rows a batch for what is run inside; the session's own setting holds again afterwards."""
    own = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, str(min(rows, int(own)) if int(own) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, own)
