"""Row numbers in groups of any size: no group has to fit into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from babelyard.sources.scratch import written


def numbered(rows: DataFrame, group: list[str], order: list[str | Column], name: str = "n", total: str | None = None) -> DataFrame:
    """Adds name: each row's number (from 1) in its group, in order. Rows that the order doesn't tell apart are numbered in any order.
    total: the name of a column for the group's number of rows, if it is wanted.

    Rows are dealt by ranges of (group, order), so a large group lies in many partitions, one after the other, and are
    written once, each with its place. A group's part in a partition is numbered from its least place; parts of the same group before it
    add their counts. The table of parts has a row for each group and partition. A null group value is a value like others.
    """
    keys = [F.col(g) for g in group]
    placed = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__at", F.monotonically_increasing_id())
    table = written(placed, "numbered").withColumn("__part", F.shiftright("__at", 33))
    parts = table.groupBy(*group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
    parts = parts.withColumn("__total", F.sum("__rows").over(Window.partitionBy(*group))).drop("__rows")
    parts = parts.withColumnsRenamed({c: f"__own_{c}" for c in [*group, "__part"]})
    same = F.col("__part") == F.col("__own___part")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"__own_{g}"))
    number = F.col("__at") - F.col("__first") + F.col("__before") + 1
    return table.join(parts, same).select(*rows.columns, number.alias(name), *([F.col("__total").alias(total)] if total else []))
