from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from babelyard.llm import tries

CONVERSATIONS = "conv_id long, turn long, role string, text string, n long, key string, child long, node long"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], CONVERSATIONS)


def sequences(rows) -> dict[int, list[tuple[str, str]]]:
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            by[conv].append((turn is not None, turn or 0, digest, role, text))
    return {c: [x[3:] for x in sorted(own)] for c, own in by.items()}


def brute(own: dict[int, list]) -> set[tuple]:
    """Every node by listing all beginnings."""
    members = defaultdict(list)
    for conv, turns in own.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    out = set()
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        children = [x for x in below if len(x) == len(node) + 1]
        saved = sum((len(members[x]) - 1) * (len(x[-1][1]) if x else 0) for x in below)
        ends = ",".join(map(str, sorted(c for c in convs if len(own[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(convs), len(node), parent, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes(df) -> set[tuple]:
    rows = [tuple(r) for r in df.select(*tries.FIELDS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made(seed: int, convs: int = 80) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        hot = rng.random() < 0.4
        n = rng.randint(1, 6)
        for t in range(n):
            word = "same" if hot else rng.choice(["ü", "one", "two", "three words here"])
            rows.append((c, t, rng.choice(["user", "user", "bot"]) if not hot else "user", word))
    return rows


@pytest.mark.parametrize("local", [1, 3, 4096])
def test_equals_brute_force(spark, local):
    rows = made(local)
    df = tries.prefix_trie(tries.encode_turns(table(spark, rows)), local=local, listed=5)
    assert nodes(df) == brute(sequences(rows))


def test_shared_starts(spark):
    rows = [(c, t, "user", f"{c if c % 7 else 'x'} {t}") for c in range(230) for t in range(c % 5 + 1) if c != 200]
    taken = F.col("conv_id") % 6
    df = tries.prefix_trie(tries.share_starts(tries.encode_turns(table(spark, rows)), 100, taken, 5), local=10)
    own = sequences(rows)
    rebuilt = {c: own.get(c - c % 100, [])[: c % 6] + turns[c % 6 :] for c, turns in own.items()}
    assert any(not x for x in rebuilt.values())
    assert nodes(df) == brute(rebuilt)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (1, None, None, None), (1, 2, "user", ""), (1, 2, "bot", "a"), (1, 2, "bot", "a"), (2, None, "", ""), (3, 5, "user", "y" * 100_000), (-7, 0, "user", "z"), (-7, 1, None, "z")]
    assert nodes(tries.prefix_trie(tries.encode_turns(table(spark, rows)), local=1)) == brute(sequences(rows))


def test_empty_table(spark):
    df = tries.prefix_trie(tries.encode_turns(table(spark, [])))
    assert df.collect() == [] and df.columns == tries.FIELDS


def test_ids_of_a_hot_sequence_are_hashed_in_order(spark):
    rows = [(c, 0, "user", "hello") for c in range(500)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert nodes(tries.prefix_trie(tries.encode_turns(table(spark, rows)), listed=10)) == brute(sequences(rows))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_sort_bucket_of_one_long_sequence():
    found = tries.sort_bucket([(list(range(5000)), [1] * 5000, 7, 2, "e")], 1, 3)
    assert len(found) == 5000 and found[0][:4] == [7, 1, 3, 2] and found[-1][7] == "e" and found[0][6] == 5000
