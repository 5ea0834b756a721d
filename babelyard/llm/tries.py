"""Prefix trie of conversations: distributed radix partitioning by turn, and quicksort by several keys inside buckets.

Turns are numbers from a dictionary of (role, text). Equal conversations are one sequence with a count. All
sequences begin in the root's bucket; a round deals the buckets' sequences by their next turn. A bucket that has become small
enough is local: one task sorts it by multikey quicksort, whose recursion gives the nodes of its subtree. Only buckets with
more sequences go into the next round; each is a node whose counts are aggregates. Sums over the subtrees of such
nodes are put together from the last round upwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from babelyard.llm.tables import materialise, spread_join

#: Sequences that one task sorts as one bucket, and equal conversations whose ids are listed in one row.
LOCAL, LISTED = 4096, 10_000
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def encode_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns, chars: each conversation's turns in order as dictionary numbers, and the code points of their texts.

    Null roles and texts count as empty. Turns with one turn number (or none, which comes first) are ordered by a digest of role and text;
    repeated rows are turns each. Rows with a null conv_id belong to no conversation.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).alias("chars"))
    known = rows.groupBy("digest").agg(F.max("chars").alias("chars"), F.count("*").alias("n"))
    known = materialise(known.withColumn("id", F.monotonically_increasing_id()), "trie-dictionary")
    coded = spread_join(rows.drop("chars"), known.drop("n"), "digest", "conv_id", counts=known.select("digest", "n"))
    own = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "id", "chars"))).alias("own"))
    return materialise(own.select("conv_id", F.col("own.id").alias("turns"), F.col("own.chars").alias("chars")), "trie-turns")


def share_starts(sequences: DataFrame, every: int, most: Column, limit: int) -> DataFrame:
    """Sequences whose first `most` turns (at most limit) come from the conversation that begins their hundred, or whatever `every` is."""
    bases = sequences.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, limit).alias("b_turns"), F.slice("chars", 1, limit).alias("b_chars")
    )
    both = sequences.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(bases, "base", "left").withColumn("h", most.cast("int"))

    def mixed(name: str, kind: str) -> Column:
        first = F.slice(F.coalesce(f"b_{name}", F.array().cast(f"array<{kind}>")), F.lit(1), F.col("h"))
        return F.concat(first, F.slice(name, F.col("h") + 1, F.size(name))).alias(name)

    return both.select("conv_id", mixed("turns", "bigint"), mixed("chars", "int"))


def _chunks(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted ids of each group, joined as far as they stand in one batch."""
    for batch in it:
        if len(batch):
            parts = [(a, b, own.iloc[0], ",".join(map(str, own))) for (a, b), own in batch.groupby(["a", "b"], sort=False)["conv_id"]]
            yield pd.DataFrame(parts, columns=["a", "b", "first", "ids"])


def _digests(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of each group's chunks in order; a group may go on from batch to batch."""
    at, state = None, hashlib.sha256()
    for batch in it:
        for key, ids in zip(zip(batch["a"], batch["b"], strict=True), batch["ids"], strict=True):
            if key != at:
                if at is not None:
                    yield pd.DataFrame([(*at, state.hexdigest())], columns=["a", "b", "ends"])
                at, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if at is not None:
        yield pd.DataFrame([(*at, state.hexdigest())], columns=["a", "b", "ends"])


def distinct_sequences(sequences: DataFrame, listed: int = LISTED) -> DataFrame:
    """turns, chars, conv_id (the least), n, ends of every distinct sequence: how many conversations are equal to it, and the
    SHA-256 of their ids in order, joined by commas. Over `listed` ids are joined in chunks by many tasks; only hashing them goes in succession."""
    keyed = sequences.withColumns({"a": F.xxhash64("turns"), "b": F.xxhash64(F.lit(1), "turns")})
    groups = materialise(keyed.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")), "trie-groups")
    key = F.struct("a", "b")
    several = groups.where("n > 1").select(key.alias("key"), "n")
    members = spread_join(keyed.select(key.alias("key"), "conv_id"), several, "key", "conv_id", counts=several)
    few = members.where(F.col("n") <= listed).groupBy("key").agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    few = few.select("key.a", "key.b", F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), 256).alias("ends"))
    many = members.where(F.col("n") > listed).select("key.a", "key.b", "conv_id").repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
    chunks = many.mapInPandas(_chunks, "a long, b long, first long, ids string").repartition("a", "b").sortWithinPartitions("a", "b", "first")
    ends = materialise(few.unionByName(chunks.mapInPandas(_digests, "a long, b long, ends string")), "trie-ends")
    named = groups.join(ends, ["a", "b"], "left").select("conv_id", "n", F.coalesce("ends", F.sha2(F.col("conv_id").cast("string"), 256)).alias("ends"))
    return materialise(sequences.join(named, "conv_id"), "trie-sequences")


def sort_bucket(rows: list[tuple], depth: int, parent_conv: int | None) -> list[list]:
    """The nodes of a bucket whose sequences begin with the same `depth` turns, its own node first, as lists of FIELDS.
    rows: turns, chars, conv_id, n, ends; no two have equal turns. Multikey quicksort: rows are parted into those whose
    next turn is less than, equal to and greater than a pivot's; the equal ones are a child and go on with the turn after it."""
    nodes: list[list] = []
    parents, lasts = [], []

    def node(group: list[tuple], depth: int, parent: int) -> int:
        above = nodes[parent][0] if parent >= 0 else parent_conv
        nodes.append([min(r[2] for r in group), depth, above, sum(r[3] for r in group), 0, 0, 0, NO_ENDS])
        parents.append(parent)
        lasts.append(group[0][1][depth - 1] if depth else 0)
        return len(nodes) - 1

    stack = [(rows, depth, node(rows, depth, -1))]
    while stack:
        group, depth, parent = stack.pop()
        if len(group) == 1:
            for at in range(depth, len(group[0][0])):
                parent = node(group, at + 1, parent)
            nodes[parent][7] = group[0][4]
            continue
        turns = [r[0][depth] if len(r[0]) > depth else -1 for r in group]
        pivot = turns[len(turns) // 2]
        equal = [r for r, t in zip(group, turns, strict=True) if t == pivot]
        for side in ([r for r, t in zip(group, turns, strict=True) if t < pivot], [r for r, t in zip(group, turns, strict=True) if t > pivot]):
            if side:
                stack.append((side, depth, parent))
        if pivot < 0:
            nodes[parent][7] = equal[0][4]
        else:
            stack.append((equal, depth + 1, node(equal, depth + 1, parent)))
    for k in range(len(nodes) - 1, -1, -1):  # what stands below a node comes after it
        own = nodes[k]
        own[5] = own[5] or 1
        own[6] += (own[3] - 1) * lasts[k]
        if parents[k] >= 0:
            above = nodes[parents[k]]
            above[4] += 1
            above[5] += own[5]
            above[6] += own[6]
    return nodes


def _finish(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows of local buckets to nodes. The node of a bucket itself names the node of the last round that it hangs from."""
    at, rows = None, []

    def done() -> pd.DataFrame:
        level, _, upper, parent_conv = at
        out = pd.DataFrame(sort_bucket(rows, level + 1, parent_conv), columns=FIELDS)
        out["level"] = level
        out["upper"] = pd.array([upper, *[None] * (len(out) - 1)], dtype="Int64")
        return out

    for batch in it:
        out = []
        keys = zip(batch["level"], batch["child"], batch["node"], batch["node_conv"], strict=True)
        for key, *row in zip(keys, batch["turns"], batch["chars"], batch["conv_id"], batch["n"], batch["ends"], strict=True):
            if key != at:
                if rows:
                    out.append(done())
                at, rows = key, []
            rows.append((row[0].tolist(), row[1].tolist(), *row[2:]))
        if out:
            yield pd.concat(out, ignore_index=True)
    if rows:
        yield done()


def prefix_trie(sequences: DataFrame, local: int = LOCAL, listed: int = LISTED) -> DataFrame:
    """One row for every node of the trie of the sequences (conv_id, turns, chars; one row a conv_id): FIELDS.

    A node is a distinct beginning of d turns, the root having none; its members are the conversations that begin so. conv_id is its least member,
    n_convs how many there are; parent_conv_id belongs to the parent (null for the root); n_leaves counts the childless nodes of its subtree, itself
    included; saved_tokens adds (n_convs - 1) times the code points of the last text over its subtree; ends_sha256 is the SHA-256 of
    the ids of the members that have no further turn. Conversations without turns belong to the root; an empty table has no nodes.
    """
    open_ = distinct_sequences(sequences, listed).withColumns({"node": F.lit(0).cast("long"), "node_conv": F.lit(None).cast("long")})
    root = open_.agg(
        F.lit(0).cast("long").alias("number"), F.lit(None).cast("long").alias("upper"), F.min("conv_id").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.sum("n").alias("n_convs"), F.lit(0).alias("last"), F.max(F.when(F.size("turns") == 0, F.col("ends"))).alias("ends"),
    )
    levels = [materialise(root.where("n_convs is not null"), "trie-level")]
    if levels[0].isEmpty():
        return sequences.sparkSession.createDataFrame([], NODE)
    open_ = open_.crossJoin(F.broadcast(levels[0].select(F.col("conv_id").alias("c")))).withColumn("node_conv", F.col("c")).drop("c")  # one row
    closed: DataFrame | None = None
    while True:
        depth = len(levels) - 1
        going = open_.where(F.size("turns") > depth).withColumn("key", F.struct("node", F.get("turns", F.lit(depth)).alias("turn")))
        found = going.groupBy("key").agg(
            F.sum("n").alias("n_convs"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.max("node_conv").alias("parent_conv_id"),
            F.max(F.get("chars", F.lit(depth))).alias("last"), F.max(F.when(F.size("turns") == depth + 1, F.col("ends"))).alias("ends"),
        )
        children = materialise(found.withColumn("number", F.monotonically_increasing_id()), "trie-children")
        few = children.select("key", F.col("number").alias("child"), F.col("conv_id").alias("child_conv"), (F.col("n") > local).alias("large"))
        dealt = materialise(spread_join(going, few, "key", "conv_id", counts=children.select("key", "n")).withColumn("level", F.lit(depth)), "trie-dealt")
        small = dealt.where("not large").select("level", "child", "node", "node_conv", "turns", "chars", "conv_id", "n", "ends")
        closed = small if closed is None else closed.unionByName(small)
        large = children.where(F.col("n") > local)
        if large.isEmpty():
            break
        levels.append(large.select("number", F.col("key.node").alias("upper"), "conv_id", "parent_conv_id", "n_convs", "last", "ends"))
        open_ = dealt.where("large").withColumns({"node": F.col("child"), "node_conv": F.col("child_conv")}).drop("key", "child", "child_conv", "large", "level")

    order = ["level", "child"]
    done = materialise(closed.repartition(*order).sortWithinPartitions(*order).mapInPandas(_finish, f"{NODE}, level int, upper long"), "trie-local")
    tops = done.where("upper is not null").select("level", F.col("upper").alias("number"), "n_leaves", "saved_tokens")
    out, below = done.select(*FIELDS), None
    for depth in range(len(levels) - 1, -1, -1):
        under = tops.where(F.col("level") == depth).drop("level")
        under = under if below is None else under.unionByName(below)
        sums = under.groupBy("number").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        saved = (F.col("n_convs") - 1) * F.col("last") + F.coalesce("saved", F.lit(0))
        whole = levels[depth].join(sums, "number", "left").select(
            "upper", "conv_id", F.lit(depth).cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.coalesce("leaves", F.lit(1)).alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
        )
        whole = materialise(whole, "trie-nodes")
        below = whole.select(F.col("upper").alias("number"), "n_leaves", "saved_tokens")
        out = out.unionByName(whole.select(*FIELDS))
    return out
