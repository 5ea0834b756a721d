from __future__ import annotations

import math
import random

import pytest

from babelyard.llm import topk

VECTORS = "vec_id long, embedding array<float>, rank string"


def brute(rows, every, k):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in ok if i % every == 0}:
        scored = []
        for i, v in ok:
            own = [sum(a * b for a, b in zip(u, v, strict=True)) for j, u in ok if j == q and len(u) == len(v)]
            scored += [(-s, i) for s in own if i != q]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])}
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    exact = [x / 256 for x in range(-64, 64)]
    rows = [(i, [rng.choice(exact) for _ in range(8)], "x") for i in range(300)]
    rows += [(i, [0.25] * 8, "x") for i in range(300, 360)]  # one vector, many rows: ties
    rows += [(400, None, "x"), (401, [1.0, None] * 4, "x"), (402, [float("nan")] * 8, "x"), (403, [float("inf")] * 8, "x"), (404, [0.5] * 3, "x"), (None, [0.5] * 8, "x")]
    got = topk.exact_topk(spark.createDataFrame(rows, VECTORS), k=5, query_every=20, query_block=7, tile_rows=50, fan_in=2)
    assert {tuple(r) for r in got.collect()} == brute(rows, 20, 5)


def test_few_rows(spark):
    one = spark.createDataFrame([(0, [1.0], "x")], VECTORS)
    assert topk.exact_topk(one).count() == 0
    two = spark.createDataFrame([(0, [1.0], "x"), (3, [2.0], "x")], VECTORS)
    assert [tuple(r) for r in topk.exact_topk(two).collect()] == [(0, 1, 3, 256 * 512)]
    assert topk.exact_topk(spark.createDataFrame([], VECTORS)).count() == 0


DOUBLES = "vec_id long, embedding array<double>, rank string"


def test_large_components(spark):
    """Exact up to 64 bits, and an error beyond."""
    rows = [(0, [1e6, 1.0], "x"), (1, [4e6, 1.0], "x"), (2, [4e6, 2.0], "x")]
    assert {tuple(r) for r in topk.exact_topk(spark.createDataFrame(rows, DOUBLES)).collect()} == brute(rows, 50, 5)
    for one in ([3e12, 1.0], [1e300, 1.0]):
        with pytest.raises(Exception, match="64 bits"):
            topk.exact_topk(spark.createDataFrame([(0, one, "x"), (1, one, "x")], DOUBLES)).collect()


def test_hot_id_and_hot_vector_are_spread(spark):
    rng = random.Random(4)
    rows = [(50, [rng.randint(-64, 64) / 256 for _ in range(4)], "x") for _ in range(400)]
    rows += [(7, [0.5] * 4, "x")] * 200 + [(i, [0.25] * 4, "x") for i in range(300, 500)]
    df = spark.createDataFrame(rows, VECTORS)
    got = topk.exact_topk(df, k=5, query_every=50, query_block=30, tile_rows=40, fan_in=2)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute(rows, 50, 5))
    clean = df.select("vec_id", topk.quantise(df["embedding"]).alias("ints")).withColumn("dim", df["vec_id"] * 0 + 4)
    sizes = [r["count"] for r in topk.in_tiles(clean, 20, 5).groupBy("part").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 70 and sum(sizes) == 605
