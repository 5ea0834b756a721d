"""Numbering and key allocation against a walk over the rows, one after the other."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from babelyard.functions.text import text_hash
from babelyard.operators import keys, translate
from babelyard.operators.ranks import numbered

ROWS = "namespace string, path string, pos int, text string, ast_sig string, base_key string"


def in_turn(rows, known: dict, taken: set[str]) -> dict:
    """(path, pos) -> key, giving out one key at a time."""
    used = defaultdict(set)
    for key in taken:
        used[key.split(".")[0]].add(key)
    last, seen, out = {}, {}, {}
    for space, path, pos, digest, sig, base in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3], r[4])):
        ident = (path, digest, sig)
        if ident in known:
            out[path, pos] = known[ident]
        elif (space, *ident) in seen:
            out[path, pos] = seen[(space, *ident)]
        else:
            name, n = base, last.get((space, base), 1)
            while name in used[space]:
                n += 1
                name = f"{base}{n}"
            last[space, base] = n
            used[space].add(name)
            out[path, pos] = seen[(space, *ident)] = name
    return out


@pytest.mark.parametrize(("seed", "bases"), [(0, ["t", "body", "cta"]), (1, ["t", "t2", "t22", "t3", "u"]), (2, ["x1", "x12", "x", "x120", "y9"]), (3, ["only"])])
def test_allocation_equals_giving_out_in_turn(spark, seed, bases):
    rng = random.Random(seed)
    rows, pos = [], defaultdict(int)
    for _ in range(400):
        space = rng.choice(["a", "b"])
        path = f"src/{space}{rng.randint(0, 3)}.jsx"
        pos[path] += 1
        rows.append((space, path, pos[path], rng.choice(["one", "two", "three", "four"]) + str(rng.randint(0, 30)), str(rng.randint(0, 2)), f"{space}.{rng.choice(bases)}"))
    df = spark.createDataFrame(rows, ROWS)
    hashed = [(r.namespace, r.path, r.pos, r.h, r.ast_sig, r.base_key) for r in df.withColumn("h", text_hash(F.col("text"))).collect()]
    old, names = {}, set()
    for space, path, _, digest, sig, base in rng.sample(hashed, 60) if seed != 3 else []:
        name = base + rng.choice(["", "2", "3", "5", "22", "02", "1", "_x"])
        if name not in names and (path, digest, sig) not in old:
            names.add(name)
            old[path, digest, sig] = name
    gone = {f"{s}.{rng.choice(bases)}{n}" for s in "ab" for n in (4, 7, 12)} - names
    held = [(*k, v) for k, v in old.items()] + [(f"gone{k}", "h", "s", v) for k, v in enumerate(sorted(gone))]
    key_map = spark.createDataFrame(held, keys.MAP) if seed != 3 else None
    got = {(r.path, r.pos): r.key for r in keys.allocate(df, key_map).collect()}
    assert got == in_turn(hashed, old, names | gone if key_map is not None else set())


def test_a_hot_base_key_lies_in_many_tasks(spark):
    df = spark.range(20_000).select(F.lit("a").alias("namespace"), F.format_string("%08d", "id").alias("path"), F.lit(0).alias("pos"), F.col("id").cast("string").alias("text"), F.lit("s").alias("ast_sig"), F.lit("a.t").alias("base_key"))
    row = keys.allocate(df).agg(F.count("*").alias("n"), F.count_distinct("key").alias("k"), F.max(F.when(F.col("path") == "00019999", F.col("key"))).alias("last")).first()
    assert (row.n, row.k, row.last) == (20_000, 20_000, "a.t20000")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert numbered(df.select("namespace", "path"), ["namespace"], ["path"]).groupBy(F.spark_partition_id()).count().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_no_rows(spark):
    assert keys.allocate(spark.createDataFrame([], ROWS)).collect() == []
    assert numbered(spark.createDataFrame([], "a int, b int"), ["a"], ["b"]).collect() == []


def test_numbers_with_nulls_and_ties(spark):
    rows = [(None, 3), (None, 1), (1, 5), (1, 5), (1, None)]
    got = numbered(spark.createDataFrame(rows, "a int, b int"), ["a"], ["b"]).collect()
    assert sorted((r.a is None, r.n, r.b or 0) for r in got) == [(False, 1, 0), (False, 2, 5), (False, 3, 5), (True, 1, 1), (True, 2, 3)]


def test_chunks(spark):
    df = spark.range(1050).select((F.col("id") % 2).alias("g"), "id")
    got = translate.chunk_numbers(df, "g", "id").groupBy("g", "chunk").agg(F.count("*").alias("n"), F.min("id").alias("first")).collect()
    assert sorted(map(tuple, got)) == sorted((g, c, 100 if c < 5 else 25, c * 200 + g) for g in (0, 1) for c in range(6))
