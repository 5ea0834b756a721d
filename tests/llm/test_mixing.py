from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from babelyard.llm import mixing

LABELS = "doc_id long, quality int, toxic int"


def project(n, p, totals, cap, ridge, steps=4000):
    """The same least squares by plain projected gradient in numpy."""
    whole = n.sum()
    gram = (p * n[:, None]).T @ p / whole + 1e-6 * np.eye(p.shape[1])
    metric, w = np.linalg.inv(gram), np.ones(len(n))
    for _ in range(steps):
        off = ((n * w) @ p - totals) / whole
        w = np.clip(w - (p @ (metric @ off) + ridge * (w - 1)) / (1 + ridge), 0, cap)
    return w


def test_rates_against_numpy(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.5, 0.5, 0.5], 200)
    n = rng.integers(1, 500, 200).astype(float)
    totals = np.array([0.6, 0.3, 0.1]) * n.sum()
    df = spark.createDataFrame([(k, int(a), *map(float, b)) for k, (a, b) in enumerate(zip(n, p, strict=True))], "k long, n_tokens long, p_0 double, p_1 double, p_2 double")
    rate, _ = mixing.fit_rates(df, totals.tolist(), 1e-3, 4.0, 40, 1e-9)
    got = np.array([r.rate for r in df.withColumn("rate", rate).orderBy("k").collect()])
    expected = project(n, p, totals, 4.0, 1e-3)
    assert np.abs((n * got) @ p - (n * expected) @ p).max() < 0.01 * n.sum()
    assert got.min() >= 0 and got.max() <= 4


def test_targets_are_met(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    targets = {"good": 0.8, "poor": 0.1, "toxic": 0.1}
    rows = mixing.mix(docs, labels, targets=targets).collect()
    assert len(rows) == 200
    tokens = sum(r.n_tokens for r in rows)
    for name, share in targets.items():
        assert sum(r.n_tokens * r.rate * r[f"p_{name}"] for r in rows) / tokens == pytest.approx(share, abs=0.03)
    assert all(sum(r[f"p_{d}"] for d in mixing.DOMAINS) == pytest.approx(1) and r.rate >= 0 for r in rows)


def test_tilted_targets(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    tilts = {"good": 1.0, "poor": 0.7, "toxic": 0.5}
    mixer, members = mixing.fit(docs, labels, tilts=tilts)
    rows = members.withColumn("rate", mixer.rate).collect()
    own = [sum(r.n_tokens * r[f"p_{k}"] for r in rows) for k in range(3)]
    got = [sum(r.n_tokens * r.rate * r[f"p_{k}"] for r in rows) for k in range(3)]
    tilted = [t * x for t, x in zip(tilts.values(), own, strict=True)]
    for x, t in zip(got, tilted, strict=True):
        assert x / sum(own) == pytest.approx(t / sum(tilted), abs=0.01)
    assert all(r.rate >= 1 for r in rows if r.p_0 > 0.99)


def test_classifier_separates(spark, make_docs):
    rows = [(k, f"plain words of text number {k} " * 5) for k in range(200)] + [(1000 + k, f"## noise ## {k} ## " * 5) for k in range(100)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 200, 2)] + [(1000 + k, 0, 0) for k in range(0, 100, 2)] + [(None, 1, 1), (3, None, None)], LABELS)
    got = mixing.mix(make_docs(rows, extra=True), labels).collect()
    assert all((r.p_poor > 0.5) == (r.doc_id >= 1000) for r in got)


def test_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], LABELS)
    rows = mixing.mix(odd, none).collect()
    assert len(rows) == 9 and all(r.rate >= 0 for r in rows)
    assert all(r.p_good == pytest.approx(1 / 3) for r in rows)
    assert mixing.mix(empty, none).count() == 0


def test_rows_are_repeated_by_rate(spark, make_docs, odd):
    docs = make_docs([(k, f"words of number {k}") for k in range(2000)], extra=True)
    none = spark.createDataFrame([], LABELS)
    mixer, _ = mixing.fit(docs, none)
    mixer.rate = F.lit(1.3)
    out = mixer.repeat_rows(docs)
    assert out.columns == docs.columns
    counts = {r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {1, 2} and 2500 < out.count() < 2700
    mixer.rate = F.lit(0.0)
    assert mixer.repeat_rows(odd).count() == 0


def test_rare_domains_reach_their_targets(spark, make_docs):
    rows = [(k, f"plain words of text number {k} " * 5) for k in range(600)] + [(1000 + k, f"## noise ## {k} ## " * 5) for k in range(6)] + [(2000 + k, f"bad nasty {k} vile " * 5) for k in range(6)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 600, 2)] + [(1000 + k, 0, 0) for k in range(6)] + [(2000 + k, 1, 1) for k in range(6)], LABELS)
    docs = make_docs(rows)
    targets = {"good": 0.85, "poor": 0.07, "toxic": 0.08}
    mixer, members = mixing.fit(docs, labels, targets=targets)
    got = members.withColumn("rate", mixer.rate).collect()
    tokens = sum(r.n_tokens for r in got)
    for k, d in enumerate(mixing.DOMAINS):
        share = sum(r.n_tokens * r.rate * r[f"p_{k}"] for r in got) / tokens
        assert share == pytest.approx(targets[d], abs=0.01)
        assert mixer.wanted[k] == targets[d] and mixer.reached[k] == pytest.approx(share, abs=1e-6)
    assert max(r.rate for r in got) > 4
    with pytest.warns(UserWarning, match="out of reach"):
        mixing.fit(docs, labels, targets=targets, max_rate=4.0)


def logistic(rows, x):
    """Posteriors of (bins, slots) x by plain numpy from the fitted weights."""
    weights, constants = mixing.fit_logistic(rows)
    logs = constants.copy()
    for k, b in enumerate(x[0]):
        logs = logs + weights[k * mixing.BINS + b]
    for s in x[1]:
        logs = logs + weights[len(mixing.STATISTICS) * mixing.BINS + s]
    e = np.exp(logs - logs.max())
    return e / e.sum()


def test_posteriors_against_numpy(spark):
    rng = np.random.default_rng(8)
    rows = [(mixing.DOMAINS[k % 3], [int(x) for x in rng.integers(0, 20, 7)], sorted({k % 3 * 100, *map(int, rng.integers(1000, 4096, 4))})) for k in range(300)]
    weights, constants = mixing.fit_logistic(rows)
    asked = [(k, 5, r[1], r[2]) for k, r in enumerate(rows[:40])] + [(40, 0, [63] * 7, [])]
    df = spark.createDataFrame(asked, "row long, n_tokens long, bins array<int>, slots array<int>")
    got = {r.row: [r.p_0, r.p_1, r.p_2] for r in mixing.Mixer([], weights, constants).posteriors(df).collect()}
    for k, _, bins, slots in asked:
        assert got[k] == pytest.approx(logistic(rows, (bins, slots)).tolist(), abs=1e-9)
    assert all(mixing.DOMAINS[int(np.argmax(got[k]))] == rows[k][0] for k in range(40))


def test_zero_is_a_bound(spark, make_docs):
    rows = [(k, f"plain words of text number {k} " * 5) for k in range(300)] + [(2000 + k, f"bad nasty {k} vile " * 5) for k in range(100)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 300, 2)] + [(2000 + k, 1, 1) for k in range(0, 100, 2)], LABELS)
    got = mixing.mix(make_docs(rows), labels, targets={"good": 1.0, "poor": 0.0, "toxic": 0.0}).collect()
    assert all((r.rate == 0) == (r.doc_id >= 2000) for r in got)
    assert {r.miss for r in got} == {got[0].miss} and got[0].miss < 0.01


def test_repeated_rows_teach_once(spark, make_docs):
    rows = [(k, f"plain words of text number {k} " * 5) for k in range(60)] + [(900, "bad nasty vile " * 9)] * 500
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)] + [(900, 1, 1)], LABELS)
    learnt = mixing.materialise(mixing.features(make_docs(rows), [], (F.col("doc_id"),)), "x").select("row.doc_id", "bins", "slots")
    counted = []
    fit, mixing.fit_logistic = mixing.fit_logistic, lambda x: counted.append(len(x)) or fit(x)
    try:
        mixing.learn_classifier(learnt, mixing.labelled_sample(labels, 100))
    finally:
        mixing.fit_logistic = fit
    assert counted == [61]
