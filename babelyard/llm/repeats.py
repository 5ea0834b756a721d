"""Substring dedup: seed and extend on winnowed anchors; every stretch of words that repeats is found exactly.

A window is `words` consecutive words. Its anchor is its least run of `anchor_words` words, by a hash: equal
windows have equal anchors at equal places. Windows that follow each other mostly share an anchor; the stretch of
words that they fill together, as far both ways from the anchor as it stays theirs, is a cell.

1. Seeds: anchors are counted over all documents; what follows looks only at cells whose anchor stands twice or more.
2. A match is extended both ways at once where whole cells are equal: all windows of such a cell are repeats.
3. Where a repeat begins or ends, cells with one anchor differ. Only there are texts read again, and windows compared one
   by one: of each cell that stands alone, and of one place of each other cell with its anchor.
4. Windows that repeat are joined to maximal stretches, and these are cut out of the text.

No pairs are listed: a group of equal anchors or cells is a count, which Spark adds up before it deals it, and joins
deal hot keys over many parts. Equal texts are one content with a number of copies. Keys are 128 bits together
(anchor and cell, anchor and window), contents are MD5 digests.

Disk: a step's shuffle files go as it ends, and written tables as soon as the next ones don't read them, so that the largest
step counts and not all together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from babelyard.llm import shingles, workers
from babelyard.llm.tables import materialise, scratch_scope, shuffles_freed, spread_join

WORDS = 35
ANCHOR_WORDS = 12
_INVERSE = pow(shingles._ODD, -1, 1 << 64)
_NONE = np.empty(0, dtype=np.int64)


class Hashes:
    """Hashes of stretches of a text's words, each in constant time."""

    def __init__(self, text: bytes):
        own = shingles.blank_parted_hashes(text)
        self.n = len(own)
        self._inverse = shingles._powers(_INVERSE, self.n + 1)
        self._sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(own * shingles._powers(shingles._ODD, self.n + 1)[:-1], out=self._sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of words lo to hi - 1."""
        return shingles._mix((self._sums[hi] - self._sums[lo]) * self._inverse[lo] + (hi - lo).astype(np.uint64))


def least_places(x: np.ndarray, width: int) -> np.ndarray:
    """The place of the least value of each stretch of `width` values; of equal ones, the first."""
    at, low, span = np.arange(len(x)), x, 1
    while span < width:
        step = min(span, width - span)
        later = low[step:] < low[:-step]
        at, low = np.where(later, at[step:], at[:-step]), np.where(later, low[step:], low[:-step])
        span += step
    return at


def cells(text: bytes, words: int, anchor_words: int) -> tuple[np.ndarray, ...]:
    """anchor, cell, first, last: hashes of every cell and of its anchor, and its first and last window."""
    own = Hashes(text)
    if own.n < words:
        return _NONE, _NONE, _NONE, _NONE
    start = np.arange(own.n - anchor_words + 1)
    x = own.of(start, start + anchor_words)
    at = least_places(x, words - anchor_words + 1)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at)) - 1
    return x[at[first]].view(np.int64), own.of(first, last + words).view(np.int64), first, last


def covered_words(n: int, first: np.ndarray, last: np.ndarray, words: int) -> np.ndarray:
    """Which of n words windows first to last cover, of each pair."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.minimum(last + words, n), -1)
    return np.cumsum(edge[:n]) > 0


def spans_of(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true."""
    edge = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def _finish(kept: list[bytes], digest: bool) -> str:
    joined = b" ".join(kept)
    return hashlib.sha256(joined).hexdigest() if digest else joined.decode("utf-8", "replace")


def scan(docs: DataFrame, words: int, anchor_words: int, digest: bool) -> DataFrame:
    """doc_id, content, n_words, kept (as if nothing repeated), and its cells, of every row; written."""
    own = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("content"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    schema = own.select("doc_id", "content").schema.add("n_words", "long").add("kept", "string")
    for name, kind in (("anchor", T.LongType()), ("cell", T.LongType()), ("first", T.IntegerType()), ("last", T.IntegerType())):
        schema = schema.add(name, T.ArrayType(kind))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column("text").to_pylist()
            parts = [cells(t, words, anchor_words) for t in texts]
            split = [t.split() for t in texts]
            offsets = pa.array(np.cumsum([0, *(len(p[0]) for p in parts)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), kind)) for x, kind in zip(zip(*parts, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)] if parts else []
            if parts:
                head = [batch.column("doc_id"), batch.column("content"), pa.array([len(w) for w in split], pa.int64()), pa.array([_finish(w, digest) for w in split], pa.string())]
                yield pa.RecordBatch.from_arrays([*head, *lists], names=schema.names)

    with workers.small_batches(docs.sparkSession):
        return materialise(own.mapInArrow(batches, schema), "repeats-scan")


def _windows(it: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    """The windows of the cells that are compared window by window."""
    for batch in it:
        out = []
        for content, text, first, last, anchor, copies in zip(batch["content"], batch["text"], batch["o_first"], batch["o_last"], batch["o_anchor"], batch["o_copies"], strict=True):
            first, last = np.asarray(first, dtype=np.int64), np.asarray(last, dtype=np.int64)
            if not len(first):
                continue
            n = last - first + 1
            start = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            value = Hashes(text).of(start, start + words).view(np.int64)
            out.append(pd.DataFrame({"content": [content] * len(start), "start": start, "anchor": np.repeat(np.asarray(anchor, dtype=np.int64), n), "window": value, "copies": np.repeat(np.asarray(copies, dtype=np.int64), n)}))
        if out:
            yield pd.concat(out, ignore_index=True)


def _cut(it: Iterator[pd.DataFrame], words: int, digest: bool) -> Iterator[pd.DataFrame]:
    """Texts without the words that windows cover, and the stretches that went."""
    for batch in it:
        rows = []
        for content, text, first, last, starts in zip(batch["content"], batch["text"], batch["d_first"], batch["d_last"], batch["starts"], strict=True):
            own = text.split()
            starts = np.asarray([] if starts is None else starts, dtype=np.int64)
            lo, hi = np.append(np.asarray(first, dtype=np.int64), starts), np.append(np.asarray(last, dtype=np.int64), starts)
            gone = covered_words(len(own), lo, hi, words)
            from_, to = spans_of(gone)
            kept = [own[i] for i in np.flatnonzero(~gone)]
            rows.append((content, int(gone.sum()), _finish(kept, digest), [{"start": int(a), "end": int(b)} for a, b in zip(from_, to, strict=True)]))
        yield pd.DataFrame(rows, columns=["content", "n_removed", "kept", "spans"])


def _touched(seeds: DataFrame, steps: list[str]) -> DataFrame:
    """content, and its cells that repeat whole (d_) and those to compare (o_), of every content that has one; written."""
    with scratch_scope(seeds.sparkSession):
        # equal cells; of each, one place
        seeds = seeds.withColumn("key", F.struct("anchor", "cell"))
        equal = seeds.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("content", "first", "last")).alias("one"))
        equal = materialise(equal.select("key", "n", "one", F.col("key.anchor").alias("anchor")), "repeats-cells")
        whole = equal.where("n > 1").select("key", "n")
        repeated = spread_join(seeds, whole.select("key"), "key", "content", counts=whole).select("content", "first", "last")

        # anchors with a cell that stands alone: there repeats begin or end
        edges = equal.groupBy("anchor").agg(F.count("*").alias("n"), F.min("n").alias("least")).where("least = 1")
        edges = materialise(edges.select("anchor", "n"), "repeats-edges")
        open_ = spread_join(equal, edges.select("anchor"), "anchor", "key", counts=edges)
        places = repeated.select("content", "first", "last", F.lit(None).cast("long").alias("anchor"), F.lit(0).cast("long").alias("n")).unionByName(
            open_.select("one.content", "one.first", "one.last", "anchor", "n")
        )
        touched = places.groupBy("content").agg(F.collect_set(F.struct("first", "last", "anchor", "n")).alias("at"))

        def field(name: str, kept) -> Column:
            return F.transform(F.filter("at", kept), lambda x: x[name])

        whole_cell, compared = (lambda x: x["anchor"].isNull()), (lambda x: x["anchor"].isNotNull())
        touched = touched.select(
            "content", field("first", whole_cell).alias("d_first"), field("last", whole_cell).alias("d_last"),
            field("first", compared).alias("o_first"), field("last", compared).alias("o_last"), field("anchor", compared).alias("o_anchor"), field("n", compared).alias("o_copies"),
        )
        return materialise(touched, "repeats-touched", scope=steps)


def _cut_texts(docs: DataFrame, copies: DataFrame, touched: DataFrame, words: int, digest: bool) -> DataFrame:
    """content, n_removed, kept, spans of every touched content that stands once; written."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    texts = docs.select(F.unhex(F.md5(text)).alias("content"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    with scratch_scope(docs.sparkSession):
        texts = materialise(spread_join(texts, touched, "content", "row", counts=copies).drop("row"), "repeats-texts")
        found = texts.where(F.size("o_first") > 0).select("content", "text", "o_first", "o_last", "o_anchor", "o_copies")
        windows = materialise(found.mapInPandas(lambda it: _windows(it, words), "content binary, start long, anchor long, window long, copies long"), "repeats-windows")

        # rows of one content are copies of one place
        windows = windows.withColumn("key", F.struct("anchor", "window"))
        counted = windows.groupBy("key", "content", "start").agg(F.max("copies").alias("copies")).groupBy("key").agg(F.sum("copies").alias("n")).where("n > 1")
        counted = materialise(counted, "repeats-counted")
        lone = windows.where("copies = 1")
        answers = spread_join(lone, counted.select("key"), "key", "content", counts=counted).groupBy("content").agg(F.collect_set("start").alias("starts"))

        several = copies.where("n > 1").select("content")
        cut_from = texts.select("content", "text", "d_first", "d_last").join(several, "content", "left_anti").join(answers, "content", "left")
        cut = cut_from.mapInPandas(lambda it: _cut(it, words, digest), "content binary, n_removed long, kept string, spans array<struct<start:long,end:long>>")
        return materialise(cut, "repeats-cut", stays=True)


def remove_repeats(docs: DataFrame, words: int = WORDS, anchor_words: int = ANCHOR_WORDS, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept, spans of every row: its text without the words that a repeated window covers.

    A window is `words` consecutive words (parted by blanks, unchanged) of one document; it is repeated if its words
    also stand at any other place, in the same document or another. All windows are judged on the input. kept has
    the words left, joined by one space, or their SHA-256 if digest; spans the stretches removed (word numbers, end exclusive).

    Null and empty texts have no words and lose none. Repeated rows and equal texts (whatever their doc_id, null too) are copies of each other:
    with `words` words or more they lose all. Shorter texts lose nothing. An empty table gives no rows. Other columns are ignored.
    """
    if not 0 < anchor_words <= words:
        raise ValueError("an anchor has one word at least and fits into a window")
    spark = docs.sparkSession
    with workers.small_batches(spark), shuffles_freed(spark), scratch_scope(spark) as steps:
        with scratch_scope(spark):
            scanned = scan(docs, words, anchor_words, digest)
            rows = materialise(scanned.select("doc_id", "content", "n_words", "kept"), "repeats-rows", stays=True)
            copies = materialise(rows.groupBy("content").agg(F.count("*").alias("n")), "repeats-copies", stays=True)
            own = scanned.select("content", F.inline(F.arrays_zip("anchor", "cell", "first", "last")))
            shared = materialise(own.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "repeats-anchors")
            seeds = materialise(spread_join(own, shared.select("anchor"), "anchor", "content", counts=shared), "repeats-seeds", scope=steps)
        cut = _cut_texts(docs, copies, _touched(seeds, steps), words, digest)

        several = copies.where("n > 1")
        none = F.array().cast("array<struct<start:long,end:long>>")
        answer = cut.select("content", "n_removed", F.col("kept").alias("rest"), "spans", F.lit(False).alias("whole")).unionByName(
            several.select("content", F.lit(None).cast("long").alias("n_removed"), F.lit(None).cast("string").alias("rest"), none.alias("spans"), F.lit(True).alias("whole"))
        )
        joined = spread_join(rows.select("doc_id", "content", "n_words", "kept"), answer, "content", "doc_id", counts=copies, how="left")
    all_gone = F.coalesce("whole", F.lit(False)) & (F.col("n_words") >= words)
    all_words = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    return joined.select(
        "doc_id", "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, F.lit(_finish([], digest))).otherwise(F.coalesce("rest", "kept")).alias("kept"),
        F.when(all_gone, all_words).otherwise(F.coalesce("spans", none)).alias("spans"),
    )
