from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from babelyard.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    own = docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    texts = [(r.doc_id, r.text) for r in own.collect()]
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.measure(own).collect())
    assert got == sorted((str(i), *counts(t)) for i, t in texts)


def most(n, risk, level):
    total, k = 0.0, -1
    for i in range(math.ceil(n * risk) + 1):
        total += math.exp(math.log(math.comb(n, i)) + i * math.log(risk) + (n - i) * math.log1p(-risk))
        if total <= level:
            k = i
    return k


def test_exact_bound(spark):
    sizes = [0, 1, 10, 500, 900, 3000]
    df = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", quality.allowed_rejections(F.col("n"), 0.004, 0.0025).alias("k"))
    assert {r.n: r.k for r in df.collect()} == {n: most(n, 0.004, 0.0025) for n in sizes}


LABELS = "doc_id long, quality int, toxic int"


def test_cutoffs_hold_and_reject(spark, make_docs):
    good, bad = "alpha beta gamma delta " * 10, "alpha# beta# gamma# delta# " * 10
    rows = [(k, f"{good} word{k}") for k in range(2000)] + [(5000 + k, f"{bad} word{k}") for k in range(50)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(2000)] + [(5000 + k, 0, 0) for k in range(50)] + [(None, 1, 0), (1, None, 0), (99_999, 1, 1)], LABELS)
    rules = (quality.Rule("symbols", "try_divide(n_symbols, word_chars)", (0.3, 0.1, 0.05)),)
    got = quality.quality_rules(make_docs(rows), labels, rules).withColumn("is_bad", F.col("doc_id") >= 5000)
    assert {(r.is_bad, r.kept): r["count"] for r in got.where("not base_failed").groupBy("is_bad", "kept").count().collect()}.get((False, False)) is None
    assert all(r.failed_rules == ["symbols"] for r in got.where("is_bad").collect())
    chosen = quality.cutoffs(quality.measure(make_docs([(k, "a b c d e f# g h " * 4 + str(k)) for k in range(2000)])), labels, rules).collect()
    assert {r.cutoff_symbols for r in chosen} == {0.3}  # all good documents are over the stricter ones


def test_copies_are_one_trial(spark, make_docs):
    """A thousand copies of one good text allow no more than one does; a text that one label calls poor is no good one."""
    rows = [(k, "alpha beta gamma delta " * 10) for k in range(1000)] + [(2000, "one two three " * 10), (2001, "one two three " * 10)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(1000)] + [(2000, 1, 0), (2001, 0, 0)], LABELS)
    chosen = quality.cutoffs(quality.measure(make_docs(rows)), labels).collect()
    assert {(r.n_good, r.level) for r in chosen} == {(1, None)} and len(chosen) == len(quality.BANDS) + 1


def test_pools():
    assert quality.pool([300, 300, 300, 300], 217) == [0, 1, 2, 3]
    assert quality.pool([14, 123, 178, 26], 217) == [0, 0, 0, 0]
    assert quality.pool([166, 1159, 1812, 272], 217) == [0, 0, 2, 3]
    assert quality.pool([500, 10, 500, 10], 217) == [0, 1, 1, 1]
    assert quality.pool([0, 0, 0, 0], 217) == [0, 0, 0, 0]
    assert (1 - 0.02) ** quality.fewest(0.02, 0.0125) <= 0.0125 < (1 - 0.02) ** (quality.fewest(0.02, 0.0125) - 1)


def test_the_bound_holds_in_simulation():
    """Of many samples of good documents, a stratum loses more than the risk in no larger a share than the level."""
    rng = np.random.default_rng(3)
    true = np.array([0.001, 0.004, 0.01, 0.018, 0.022, 0.03, 0.06, 0.2])  # rejected good documents by level, laxest first
    for n, level in ((328, 0.0125), (1276, 0.0125), (9090, 0.0125)):
        allowed = most(n, 0.02, level)
        harm = rng.random((2000, n))
        counts = np.stack([(harm < t).sum(axis=1) for t in true], axis=1)
        taken = (counts <= allowed).sum(axis=1) - 1
        lost = np.where(taken >= 0, true[taken], 0.0)
        assert (lost > 0.02).mean() <= level + 0.008
        assert (taken >= 0).mean() > 0.5


def test_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.quality_rules(odd, none).collect()
    assert len(rows) == 9 and all(r.base_failed and not r.kept for r in rows if r.n_words < 20)
    assert quality.quality_rules(empty, none).count() == 0
