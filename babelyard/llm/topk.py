"""Exact top-k search: tiles of queries times tiles of candidates, partial selection, tree merge."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "query_id long, part long, vec_id long, score long"


def quantise(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null for a vector that is null, or holds a null or
    non-finite component. One that doesn't fit into 64 bits is an error."""
    usable = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(math.inf)),
    )
    too_large = F.raise_error(F.lit("a vector's component doesn't fit into 64 bits")).cast("long")
    scaled = lambda x: x.cast("double") * F.lit(float(scale))
    return F.when(usable, F.transform(vector, lambda x: F.when(F.abs(scaled(x)) < F.lit(2.0**63), F.floor(scaled(x))).otherwise(too_large)))


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer products: by doubles where no sum can pass 2^53, else by Python integers.
    A product that doesn't fit into 64 bits is an error, since it could not be ranked."""
    if not queries.size or not rows.size:
        return np.zeros((len(queries), len(rows)), dtype=np.int64)
    bound = float(np.abs(queries).max()) * float(np.abs(rows).max()) * queries.shape[1]
    if bound < 2**53:
        return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    exact = queries.astype(object) @ rows.T.astype(object)
    if exact.max() >= 2**63 or exact.min() < -(2**63):
        raise OverflowError("an inner product doesn't fit into 64 bits")
    return exact.astype(np.int64)


def _select(scores: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of each row's k best scores, ties to the smaller column number."""
    n = scores.shape[1]
    if n <= k:
        return np.argsort(-scores, axis=1, kind="stable")
    top = max(abs(int(scores.max())), abs(int(scores.min())))
    if top < 2**62 // n:
        key = scores * n + (n - 1 - np.arange(n))
        best = np.argpartition(key, n - k, axis=1)[:, n - k :]
        order = np.argsort(-np.take_along_axis(key, best, axis=1), axis=1)
        return np.take_along_axis(best, order, axis=1)
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def tile_top(queries: pd.DataFrame, rows: pd.DataFrame, k: int, step: int = 512) -> pd.DataFrame:
    """The k best rows of one tile for every query of one block, without rows of the query's own id."""
    out = []
    if len(queries) and len(rows):
        rows = rows.sort_values("vec_id", kind="stable")
        ids, part = rows["vec_id"].to_numpy(np.int64), int(rows["part"].iloc[0])
        mine = queries["query_id"].to_numpy(np.int64)
        left, right = np.stack(queries["ints"].to_numpy()), np.stack(rows["ints"].to_numpy())
        low, high = np.searchsorted(ids, mine, "left"), np.searchsorted(ids, mine, "right")
        widest = k + int((high - low).max())
        for at in range(0, len(mine), step):
            scores = _products(left[at : at + step], right)
            best = _select(scores, min(widest, len(ids)))
            for row, cols in enumerate(best):
                cols = cols[ids[cols] != mine[at + row]][:k]
                out.append((np.full(len(cols), mine[at + row]), ids[cols], scores[row, cols]))
    if not out:
        return pd.DataFrame({"query_id": [], "part": [], "vec_id": [], "score": []}).astype("int64")
    got = [np.concatenate(x) for x in zip(*out, strict=True)]
    return pd.DataFrame({"query_id": got[0], "part": part, "vec_id": got[1], "score": got[2]})


def in_tiles(clean: DataFrame, tiles: int, k: int) -> DataFrame:
    """Rows with their tile, part, which follows from id and values: neither an id nor a vector that many rows hold fills one
    tile. Of rows that agree in both, k are kept: no list has room for more of them, and they are equal."""
    counted = clean.groupBy("vec_id", "ints", "dim").agg(F.count("*").alias("n"))
    rows = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k).cast("long"))))).drop("n", "copy")
    return rows.withColumn("part", F.pmod(F.xxhash64("vec_id", "ints"), F.lit(tiles)))


def exact_topk(
    vectors: DataFrame,
    k: int = 5,
    query_every: int = 50,
    query_block: int = 4096,
    tile_rows: int = 8192,
    fan_in: int = 32,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows by integer inner product.

    Queries are the rows whose id is divisible by query_every; candidates are all rows with
    another id. Both sides are cut into blocks by a hash of id and values, each (block, tile) pair is one
    task's work of bounded size, and the lists of the tiles are merged fan_in at a time.
    Ties go to the smaller id. Rows with a null id and unusable vectors take no part; vectors are
    compared only with vectors of their length. Rows that repeat an id are candidates each (never
    for their own id) and queries once for each vector of that id, merged into one list; an empty table gives no rows.
    A component or a product beyond 64 bits ends the query with an error.
    """
    clean = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), quantise(F.col(vector_col)).alias("ints")
    ).where("vec_id is not null and ints is not null").withColumn("dim", F.size("ints"))
    asked = clean.where(F.pmod("vec_id", F.lit(query_every)) == 0)
    total, wanted = clean.agg(F.count("*"), F.count_if(F.pmod("vec_id", F.lit(query_every)) == 0)).first()
    tiles, blocks = max(1, math.ceil(total / tile_rows)), max(1, math.ceil(wanted / query_block))
    rows = in_tiles(clean, tiles, k).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = (
        asked.dropDuplicates(["vec_id", "ints"])
        .withColumnRenamed("vec_id", "query_id")
        .withColumn("block", F.pmod(F.xxhash64("query_id", "ints"), F.lit(blocks)).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
    )
    # names of their own: a cogroup of two forms of one table mixes up columns that both have
    right = rows.select(*(F.col(c).alias(f"row_{c}") for c in rows.columns))
    best = queries.groupBy("part", "block", "dim").cogroup(right.groupBy("row_part", "row_block", "row_dim")).applyInPandas(
        lambda left, right: tile_top(left, right.rename(columns=lambda c: c.removeprefix("row_")), k), PART
    )
    return merge_top(best, tiles, k, fan_in)


def merge_top(best: DataFrame, parts: int, k: int, fan_in: int) -> DataFrame:
    """Merge the parts' lists, fan_in at a time, until one list a query is left."""

    def level(df: DataFrame, _: int) -> DataFrame:
        order = [F.desc("score"), F.asc("vec_id")]
        ranked = df.withColumn("part", F.expr(f"part div {fan_in}")).withColumn(
            "rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))
        )
        return ranked.where(F.col("rank") <= k)

    levels = max(1, math.ceil(math.log(max(2, parts), fan_in)))
    while fan_in**levels < parts:
        levels += 1
    return reduce(level, range(levels), best).select("query_id", "rank", "vec_id", "score")
