"""Packing documents into sequences: first-fit decreasing over a tournament tree of bin capacities."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelyard.llm import vocab, workers
from babelyard.llm.tables import materialise

END_ID = 2
#: doc_id as text: whole numbers beside nulls would become floating ones on their way.
DOCUMENT = "doc_id string, doc_tokens long, full_crcs array<long>, rest_crc long, part_crcs array<long>"
PIECE = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """A tournament tree over bins: each node holds the largest free capacity below it, so the
    leftmost bin that takes an item is found in as many steps as the tree is high."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        node, free = 1, self.free
        if free[1] < size:
            raise ValueError(f"no bin takes {size}")
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        at = node - self.leaves
        free[node] -= size
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
        return at


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; equal sizes keep their order."""
    tree, bins = CapacityTree(max(1, len(sizes)), capacity), []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = tree.place(sizes[item])
        if at == len(bins):
            bins.append([])
        bins[at].append(item)
    return bins


def powers(length: int) -> list[int]:
    """The powers of two that make up length, largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def tokenise(capacity: int, vocabulary):
    """For mapInPandas: (doc_id, text) to token counts and the crc32 of every place for a cut."""

    def run(frames):
        coder = vocab.encoder(vocabulary.value)
        end = END_ID.to_bytes(4, "little")
        for frame in frames:
            rows = []
            texts = [t if isinstance(t, str) else None for t in frame["text"]]
            for doc_id, ids in zip(frame["doc_id"], coder.encode(texts), strict=True):
                ids = memoryview(ids + end)
                n = len(ids) // 4
                full = [vocab.crc(ids[4 * a : 4 * (a + capacity)]) for a in range(0, n - n % capacity, capacity)]
                at, parts = n - n % capacity, []
                rest = ids[4 * at :]
                for size in powers(n % capacity):
                    parts.append(vocab.crc(ids[4 * at : 4 * (at + size)]))
                    at += size
                rows.append((doc_id, n, full, vocab.crc(rest), parts))
            yield pd.DataFrame(rows, columns=["doc_id", "doc_tokens", "full_crcs", "rest_crc", "part_crcs"])

    return run


def pack_group(docs: list[tuple], capacity: int, slack: int) -> list[tuple]:
    """The pieces of one group: (document number, start, length, crc32, sequence, offset).

    Whole capacities of a document are sequences of their own. What is left of each document is
    packed by first-fit decreasing. Bins with more than slack tokens free are opened again: their
    items are cut into powers of two, which fill bins without a gap, but for one last bin; that one
    is dealt into sequences whose lengths are powers of two, which need no padding.
    """
    out, sequence, rests = [], 0, []
    for number, (tokens, full, rest_crc, part_crcs) in enumerate(docs):
        for k, code in enumerate(full):
            out.append((number, k * capacity, capacity, code, sequence, 0))
            sequence += 1
        if left := tokens % capacity:
            rests.append((number, tokens - left, left, rest_crc, part_crcs))
    loose = []
    for items in first_fit_decreasing([r[2] for r in rests], capacity):
        filled = sum(rests[i][2] for i in items)
        if capacity - filled > slack and filled & (filled - 1):
            for i in items:
                number, at, left, _, codes = rests[i]
                for size, code in zip(powers(left), codes, strict=True):
                    loose.append((number, at, size, code))
                    at += size
            continue
        offset = 0
        for i in items:
            out.append((*rests[i][:4], sequence, offset))
            offset += rests[i][2]
        sequence += 1
    for items in first_fit_decreasing([x[2] for x in loose], capacity):
        filled = sum(loose[i][2] for i in items)
        ends = powers(filled)  # one power of two if the bin is full
        offset = 0
        for i in items:  # largest first, so that they meet each end exactly
            out.append((*loose[i], sequence, offset))
            offset += loose[i][2]
            if offset == ends[0]:
                ends, offset, sequence = ends[1:], 0, sequence + 1
    return out


def pack_documents(
    docs: DataFrame,
    capacity: int = 4096,
    slack: int = 64,
    group_docs: int = 2048,
    vocabulary_path: str | None = None,
    seed: int = 7,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and then id 2. Documents are dealt at random, by a hash of a number that
    each written row has, into groups of about group_docs, however many rows are equal, and every group is packed by
    itself: the tree is small, groups run side by side, and a lost task repeats one group. Every
    sequence is within slack tokens of capacity or has a power of two as its length.
    A null or empty text gives the one id 2; a null doc_id stays null; repeated rows are packed
    once each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    workers.bound_batches(spark)
    words = spark.sparkContext.broadcast(vocab.read_text(vocabulary_path or vocab.vocabulary_path()))
    coded = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(tokenise(capacity, words), DOCUMENT)
    # the number is written with its row, so a task that runs again deals the row as before
    counted = materialise(coded.withColumn("number", F.monotonically_increasing_id()), "packing-documents")
    groups = max(1, math.ceil(counted.count() / group_docs))

    def pack(key, frame):
        frame = frame.sort_values(["doc_id", "doc_tokens", "rest_crc", "number"])
        ids, tokens = frame["doc_id"].tolist(), frame["doc_tokens"].tolist()
        columns = [frame[c].tolist() for c in ("full_crcs", "rest_crc", "part_crcs")]
        pieces = pack_group(list(zip(tokens, *columns, strict=True)), capacity, slack)
        rows = [(ids[n], at, size, code, tokens[n], (int(key[0]) << 32) + seq, off) for n, at, size, code, seq, off in pieces]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PIECE.split(", ")])

    place = F.pmod(F.xxhash64("number", F.lit(seed)), F.lit(groups))
    pieces = counted.withColumn("group", place).groupBy("group").applyInPandas(pack, PIECE)
    return pieces.withColumn("doc_id", F.col("doc_id").cast("long"))
