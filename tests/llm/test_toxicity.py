from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest

from babelyard.llm import toxicity


def test_folding():
    words = toxicity.folded_words
    assert words("1d10t") == words("IDIOT") == words("іdіоt") == words("ｉｄｉｏｔ") == ["idiot"]
    assert words("$tup1d @ss") == ["stupid", "ass"]
    assert words("in 2021, 45 of") == ["in", "2021", "45", "of"]
    assert words("l0ser LOSER") == ["ioser", "ioser"]
    assert words("thoner$$$ stupid### i​diot") == ["thoner", "stupid", "idiot"]
    assert words("") == []


def test_exceptions_and_longest_weight():
    own = toxicity.Lexicon({" trash ": 2.0, " tras": 1.0, " scum ": 3.0})
    assert own.hits(toxicity.folded_words("the trash can")) == 0.0
    assert own.hits(toxicity.folded_words("the trash")) == 2.0
    assert own.hits(toxicity.folded_words("trashy trash trash scum")) == 1.0 + 2.0 + 2.0 + 3.0
    assert own.hits([]) == 0.0
    assert toxicity.Lexicon({}, ()).hits(["a"]) == 0.0


LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture
def labelled(spark, make_docs):
    rng = random.Random(2)
    plain = [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(1200):
        text = [rng.choice(plain) for _ in range(60)]
        bad = k % 4 == 0
        for _ in range(3 if bad else 0):
            text[rng.randrange(60)] = rng.choice(["scum", "moron"])
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(bad)))
    labels += [(None, 1, 1), (7, 1, None), (50_000, 1, 1)]
    return make_docs(rows), spark.createDataFrame(labels, LABELS)


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == 1200
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and sum((r.predicted == 1) == (r.doc_id % 4 == 0) for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_disguised_words_are_found(labelled, make_docs):
    docs, labels = labelled
    fitted = toxicity.fit(docs, labels)
    plain = "w1 w2 w3 w4 w5 " * 8
    scores = toxicity.score_texts(fitted, [plain, plain + "$cum m0r0n ѕсum", None, ""])
    assert scores[1] >= 0.5 > max(scores[0], scores[2], scores[3])
    kept = toxicity.reject_toxic(docs.unionByName(make_docs([(9_000, plain + "$cum m0r0n"), (9_001, plain)])), labels)
    ids = {r.doc_id for r in kept.collect()}
    assert 9_001 in ids and 9_000 not in ids and kept.columns == docs.columns


def test_without_labels(spark, odd, empty):
    none = spark.createDataFrame([], LABELS)
    rows = toxicity.score_documents(odd, none).collect()
    assert len(rows) == 9 and {r.predicted for r in rows} == {0}
    assert toxicity.score_documents(empty, none).count() == 0
    assert toxicity.reject_toxic(odd, none).count() == 9


def plain_hits(weights, exceptions, words):
    """The lexicon's sum by plain search. A phrase's last space is the first one of the next word."""
    text, total = f" {' '.join(words)} ", 0.0
    folded = [f" {' '.join(toxicity.folded_words(p))} " for p in exceptions]
    for at in range(len(text)):
        if any(text.startswith(p, start) and start <= at < start + len(p) - 1 for p in folded for start in range(max(0, at - len(p)), at + 1)):
            continue
        total += max((w for t, w in weights.items() if text.startswith(t, at)), default=0.0)
    return total


def test_hits_against_plain_search():
    rng = random.Random(4)
    vocabulary = ["trash", "can", "trashy", "scum", "pond", "clown", "fish", "class", "word", "wordy"]
    for _ in range(60):
        weights = {t: rng.choice([1.0, 1.5, 2.0]) for w in rng.sample(vocabulary, 5) for t in rng.sample(toxicity.terms(w), 1)}
        words = [w for w in toxicity.folded_words(" ".join(rng.choice(vocabulary) for _ in range(30)))]
        exceptions = rng.sample(toxicity.EXCEPTIONS, 3)
        assert toxicity.Lexicon(weights, exceptions).hits(words) == pytest.approx(plain_hits(weights, exceptions, words))


def test_scores_against_plain_python(labelled):
    docs, labels = labelled
    weights, exceptions, logistic = fitted = toxicity.fit(docs, labels)
    texts = [r.text for r in docs.limit(80).collect()] + ["", None, "a $cum l0t", "x" * 50_000]
    for text, score in zip(texts, toxicity.score_texts(fitted, texts), strict=True):
        words = toxicity.folded_words(text or "")
        total = plain_hits(weights, exceptions, words) if len(words) < 100 else 0.0
        z = logistic @ np.array([math.log1p(total), math.log1p(100 * total / max(len(words), 1)), 1.0])
        assert score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_weights_against_plain_counts(labelled):
    """The learnt weights are the log-odds of the sample's first half."""
    docs, labels = labelled
    rows = toxicity.learning_rows(docs, labels.select("doc_id", "toxic"), 20_000, 0, 5).where("half = 0").collect()
    sides = [sum(r.toxic == 0 for r in rows), sum(r.toxic == 1 for r in rows)]
    held = [(r.toxic, {t for w in toxicity.folded_words(r.text) for t in toxicity.terms(w)}) for r in rows]
    weights = toxicity.fit(docs, labels)[0]
    assert weights
    for term, weight in weights.items():
        n = [sum(term in own for side, own in held if side == k) for k in (0, 1)]
        odds = math.log((n[1] + 0.5) / (sides[1] - n[1] + 0.5)) - math.log((n[0] + 0.5) / (sides[0] - n[0] + 0.5))
        assert weight == pytest.approx(odds)


def test_repeated_rows_teach_once(spark, make_docs):
    docs = make_docs([(1, "a text"), (2, "b text")] + [(3, "c text")] * 50 + [(3, "another text")])
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(1, 4)], LABELS)
    rows = toxicity.learning_rows(docs, labels, 10, 99, 5).collect()
    assert sorted(r.text for r in rows) == ["a text", "another text", "b text"]
