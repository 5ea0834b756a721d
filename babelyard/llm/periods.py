"""Periodic run detection: word ids against themselves at every lag, and stretches of equal words as runs.

A run of period q has its words equal to those q places on, for min_exponent - 1 times q places in succession, so
that many multiples of q in succession lie among them. At each lag the array is compared with its shift at the
multiples of the lag, all at once; only where that many of them in succession agree are all words around compared.
So every lag up to n / min_exponent is tried, and all of them together cost about n log n.

Texts of up to LAGS lags are scanned together, a batch at a time, where they were read: ids differ between texts.
Longer ones are dealt out as ranges of lags, each a row of its own, and their runs meet again by the row's number.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from babelyard.llm import workers
from babelyard.llm.tables import materialise

MIN_EXPONENT, MIN_LENGTH = 4, 6
#: Lags that one task tries for one text.
LAGS = 1 << 15
RUNS = "array<struct<start:long,length:long,period:long>>"


@lru_cache(maxsize=1 << 14)
def _primes(n: int) -> tuple[int, ...]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return (*out, n) if n > 1 else tuple(out)


def _first(different: Iterator[np.ndarray]) -> int:
    """How many places come before the first true one of the parts."""
    passed = 0
    for part in different:
        hit = part.argmax() if len(part) else 0
        if len(part) and part[hit]:
            return passed + int(hit)
        passed += len(part)
    return passed


def _stretch(ids: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The widest places around `at` whose words all equal those a lag further on."""

    def onwards() -> Iterator[np.ndarray]:
        lo, step, end = at, 64, len(ids) - lag
        while lo < end:
            hi = min(lo + step, end)
            yield ids[lo:hi] != ids[lo + lag : hi + lag]
            lo, step = hi, step * 2

    def backwards() -> Iterator[np.ndarray]:
        hi, step = at, 64
        while hi > 0:
            lo = max(hi - step, 0)
            yield (ids[lo:hi] != ids[lo + lag : hi + lag])[::-1]
            hi, step = lo, step * 2

    return at - _first(backwards()), at + _first(onwards())


def _least_period(ids: np.ndarray, start: int, lag: int) -> int:
    """The least divisor of the lag that is a period too, of a run that has the lag as one."""
    for p in _primes(lag):
        while lag % p == 0 and np.array_equal(ids[start : start + lag], ids[start + lag // p : start + lag // p + lag]):
            lag //= p
    return lag


def find_runs(ids: np.ndarray, sizes: np.ndarray, first_lag: int = 1, last_lag: int | None = None, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> np.ndarray:
    """start, length, period of the runs whose period is among the lags. ids: the words of texts that share no id,
    the longest text first; sizes: how many words each has. Runs come by period, then start."""
    ends = np.cumsum(sizes)
    last_lag = int(sizes[0]) // min_exponent if last_lag is None and len(sizes) else last_lag or 0
    # of each word, the period and the end of a run found there: at multiples of that period there is nothing new
    period, until = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
    out = []
    for lag in range(first_lag, last_lag + 1):
        texts = int(np.searchsorted(-sizes, -max(min_length, min_exponent * lag), "right"))
        if not texts:
            break
        line = ids[: ends[texts - 1] : lag]
        same = line[1:] == line[:-1]
        agree = same[: len(same) - min_exponent + 2].copy()
        for k in range(1, min_exponent - 1):
            agree &= same[k : len(agree) + k]
        at = np.flatnonzero(agree) * lag
        if not len(at):
            continue
        known = (period[at] > 0) & (lag % np.maximum(period[at], 1) == 0) & (until[at] > at + lag)
        passed = 0
        for place in at[~known].tolist():
            if place < passed:
                continue
            start, end = _stretch(ids, place, lag)
            passed = end
            if end - start < max(min_length - lag, (min_exponent - 1) * lag):
                continue
            least = _least_period(ids, start, lag)
            period[start : end + lag], until[start : end + lag] = least, end + lag
            if least == lag:
                out.append((start, end - start + lag, lag))
    return np.array(out, dtype=np.int64).reshape(-1, 3)


def word_ids(texts: list[list[bytes]]) -> np.ndarray:
    """A number for every word, of texts in succession; no two texts share one."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    own = [np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)) for words in texts]
    return np.concatenate([ids + k * len(numbers) for k, ids in enumerate(own)]) if own else np.empty(0, dtype=np.int64)


def runs_of(texts: list[list[bytes]], min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> list[np.ndarray]:
    """The runs of each text, by start, then period."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    sizes = np.array([len(texts[k]) for k in order], dtype=np.int64)
    found = find_runs(word_ids([texts[k] for k in order]), sizes, min_exponent=min_exponent, min_length=min_length)
    begins = np.cumsum(sizes) - sizes
    # texts without words begin where the next one does, and come last
    whose = np.searchsorted(begins[sizes > 0], found[:, 0], "right") - 1
    found[:, 0] -= begins[whose] if len(found) else 0
    by = np.lexsort((found[:, 2], found[:, 0], whose))
    found, whose = found[by], whose[by]
    out: list[np.ndarray] = [found[:0]] * len(texts)
    for k in np.unique(whose):
        out[order[k]] = found[whose == k]
    return out


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that come after the first period of a run."""
    if not len(runs):
        return words
    gone = np.zeros(len(words), dtype=bool)
    for start, length, period in runs.tolist():
        gone[start + period : start + length] = True
    return [words[k] for k in np.flatnonzero(~gone)]


def _batch(doc_ids: pa.Array, texts: list[list[bytes]], runs: list[np.ndarray]) -> pa.RecordBatch:
    offsets = pa.array(np.cumsum([0, *(len(r) for r in runs)]), pa.int32())
    table = np.concatenate([r.reshape(-1, 3) for r in runs]) if runs else np.empty((0, 3), dtype=np.int64)
    rows = pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(3)], names=["start", "length", "period"])
    kept = pa.array([b" ".join(collapse(w, r)) for w, r in zip(texts, runs, strict=True)], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array([len(w) for w in texts], pa.int64()), pa.ListArray.from_arrays(offsets, rows), kept], names=["doc_id", "n_words", "runs", "collapsed"]
    )


def periodic_runs(docs: DataFrame, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH, lags: int = LAGS) -> DataFrame:
    """doc_id, n_words, runs, collapsed of every row.

    Words are parted by blanks and compared unchanged. A run is a stretch of words with least period q, at least max(min_length,
    min_exponent * q) words long, that no word beside it continues with that period; runs may overlap. runs lists start (word
    number from 0), length and period, by start, then period. collapsed has the words, joined by one space, that no run
    contains after its first q words.

    Null, empty and blank texts have no words and no runs. Each row is judged by itself, so repeated rows give equal rows; a
    text that takes over `lags` lags is scanned by several tasks. An empty table gives no rows. Other columns are ignored.
    """
    if min_exponent < 2:
        raise ValueError("a run repeats its period at least once")
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).cast("binary")
    # no text has more words than every second byte
    ranges = F.greatest(F.ceil(F.octet_length(text) / (2 * min_exponent * lags)), F.lit(1)).cast("int")
    own = docs.select("doc_id", text.alias("text"), ranges.alias("ranges"))
    schema = own.select("doc_id").schema.add("n_words", "long").add("runs", T.StructType.fromDDL(f"runs {RUNS}")["runs"].dataType).add("collapsed", "string")

    def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for piece in workers.pieces(batch, "text"):
                texts = [t.split() for t in piece.column("text").to_pylist()]
                yield _batch(piece.column("doc_id"), texts, runs_of(texts, min_exponent, min_length))

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            for row, text, at in zip(batch["row"], batch["text"], batch["at"], strict=True):
                ids = word_ids([text.split()])
                last = min((at + 1) * lags, len(ids) // min_exponent)
                found = find_runs(ids, np.array([len(ids)]), at * lags + 1, last, min_exponent, min_length)
                yield pd.DataFrame({"row": row, "start": found[:, 0], "length": found[:, 1], "period": found[:, 2]})

    def joined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [t.split() for t in batch.column("text").to_pylist()]
            runs = [np.array([(r["start"], r["length"], r["period"]) for r in x or []], dtype=np.int64).reshape(-1, 3) for x in batch.column("runs").to_pylist()]
            yield _batch(batch.column("doc_id"), texts, runs)

    with workers.small_batches(spark):
        short = own.where("ranges = 1").select("doc_id", "text").mapInArrow(near, schema)
        long = materialise(own.where("ranges > 1").withColumn("row", F.monotonically_increasing_id()), "periods-long")
    with workers.small_batches(spark, 4):
        dealt = long.select("row", "text", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)).alias("at")).repartition("row", "at")
        found = materialise(dealt.mapInPandas(part, "row long, start long, length long, period long"), "periods-parts")
        listed = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
        back = F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")))
        whole = materialise(long.join(listed.select("row", back.alias("runs")), "row", "left").select("doc_id", "text", "runs").mapInArrow(joined, schema), "periods-long-done")
    return short.unionByName(whole)

