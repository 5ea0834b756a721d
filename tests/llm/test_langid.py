from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from babelyard.llm import langid


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "ab", "b", "ba", "▁ab"]
    theta = np.vstack([np.array([[0.1, 0.2], [0.2, 0.1], [0.1, 0.1], [0.2, 0.2], [0.1, 0.1], [0.1, 0.2], [0.2, 0.1]]), np.zeros((1, 2))])
    lattice = langid.Lattice(pieces)
    words = ["▁abab", "▁b", "▁aba", "▁xa"]
    got = np.exp(langid.forward(lattice, theta, words))
    place = {p: k for k, p in enumerate(pieces)}
    for w, row in zip(words, got, strict=True):
        for lang in (0, 1):
            total = 0.0
            for cuts in itertools.product([0, 1], repeat=len(w) - 1):
                parts, last = [], 0
                for k, c in enumerate(cuts, 1):
                    if c:
                        parts.append(w[last:k])
                        last = k
                parts.append(w[last:])
                p = [theta[place[x], lang] if x in place else (langid.UNKNOWN if len(x) == 1 else 0.0) for x in parts]
                total += math.prod(p)
            assert row[lang] == pytest.approx(total)


def test_expected_counts_add_up():
    pieces = ["▁", "a", "b", "ab"]
    theta = np.vstack([np.full((4, 1), 0.25), np.zeros((1, 1))])
    counts = langid.expected_counts(langid.Lattice(pieces), theta, ["▁ab"], np.array([0]), np.array([2]))
    # 1/4^3 for three pieces, 1/4^2 for two
    assert counts[:, 0] == pytest.approx([2.0, 0.4, 0.4, 1.6, 0.0])


ENGLISH = "the house and the water that they have with this thing should bring them there again"
FRENCH = "la maison et les eaux que nous avons avec cette chose devraient leur apporter encore une fois"


@pytest.fixture
def bilingual(spark):
    rows = []
    for k in range(300):
        text, lang = ((ENGLISH, "en"), (FRENCH, "fr"))[k % 2]
        words = text.split()
        rows.append((k, " ".join(words[k % 7 :] + words[: k % 7]) + f" {k}", lang if k % 11 else None, "s", 1, "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


def test_held_out_accuracy(bilingual):
    rows = langid.identify(bilingual).collect()
    assert len(rows) == 300
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(r.lang_pred == ("en", "fr")[r.doc_id % 2] and 0.9 < r.score <= 1 for r in rows)


def test_odd_rows(bilingual, odd, empty, spark):
    fitted = langid.fit(bilingual)
    rows = langid.identify(odd, fitted).collect()
    assert len(rows) == 9
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (0, 1, 2))
    assert langid.identify(empty, fitted).count() == 0
    unnamed = bilingual.limit(5).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unnamed).collect()} == {"und"}
    digits = spark.createDataFrame([(1, "123 456 !!", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.lang_pred for r in langid.identify(digits, fitted).collect()] == ["und"]


def test_filter_keeps_clean_documents(bilingual):
    kept = langid.reject_unknown(bilingual.unionByName(bilingual.limit(1).selectExpr("cast(999 as bigint) doc_id", "'12 34' text", "lang", "source", "n_chars", "score")))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(300)) and kept.columns == bilingual.columns


def test_no_piece_of_letters_is_left_out():
    pieces = langid.read_pieces()
    assert {"▁university", "▁programming", "▁specified"} <= set(pieces)
    assert langid.split_words("x" * 100) == ["▁" + "x" * 100]


def log_sum(word, theta, place):
    """log P(word) by plain sums, for one language."""
    alpha = [0.0] + [-math.inf] * len(word)
    for end in range(1, len(word) + 1):
        terms = []
        for start in range(end):
            x = word[start:end]
            p = theta[place[x]] if x in place else 0.0
            p = max(p, langid.UNKNOWN) if len(x) == 1 else p
            if p > 0 and alpha[start] > -math.inf:
                terms.append(alpha[start] + math.log(p))
        top = max(terms)
        alpha[end] = top + math.log(sum(math.exp(t - top) for t in terms))
    return alpha[-1]


def test_long_pieces_and_long_words():
    pieces = ["▁", "a", "b", "ab", "▁abababababab", "bababababa"]
    theta = np.vstack([np.array([[0.1, 0.2], [0.2, 0.1], [0.1, 0.3], [0.1, 0.1], [0.3, 0.2], [0.2, 0.1]]), np.zeros((1, 2))])
    lattice, place = langid.Lattice(pieces), {p: k for k, p in enumerate(pieces)}
    words = ["▁abababababab", "▁" + "ab" * 10, "▁" + "ab" * 30 + "y", "▁" + "x" * 150]
    got = langid.forward(lattice, theta, words)
    assert got == pytest.approx(np.array([[log_sum(w, theta[:, k], place) for k in (0, 1)] for w in words]))
    counts = langid.expected_counts(lattice, theta, words[:2] + ["▁" + "ab" * 200], np.array([0, 1, 0]), np.array([1, 1, 2]))
    letters = sum(counts[k].sum() * len(p) for k, p in enumerate(pieces))
    assert letters == pytest.approx(13 + 21 + 2 * 401)


def test_letters():
    """Signs for numbers are no letters, marks belong to their letter."""
    assert [langid.split_words(t) for t in ("½ ² ① Ⅷ 42", "Grüße a̍b c1d", None, "")] == [[], ["▁grüße", "▁a̍b", "▁c", "▁d"], [], []]
    model = langid.Model(("▁", "a"), ["en", "fr"], np.full((3, 2), 0.3))
    assert model.predict(["½ ② ³", "a", ""])[0] == ["und", "en", "und"]


def test_long_words_by_plain_sums(monkeypatch):
    pieces = ["▁", "▁ab", "a", "b", "abc", "c", "bcab"]
    rng = np.random.default_rng(2)
    theta = np.vstack([rng.random((len(pieces), 3)) / 9, np.zeros((1, 3))])
    lattice, word = langid.Lattice(pieces), "▁" + "abcx" * 30
    alpha = [np.ones(3)]
    for end in range(1, len(word) + 1):
        total = np.zeros(3)
        for size in range(1, min(end, 4) + 1):
            piece = word[end - size : end]
            p = theta[pieces.index(piece)] if piece in pieces else np.zeros(3)
            total = total + alpha[end - size] * (np.maximum(p, langid.UNKNOWN) if size == 1 else p)
        alpha.append(total)
    assert np.allclose(langid.forward_long(lattice, theta, word), np.log(alpha[-1]))
    monkeypatch.setattr(langid, "STRETCH", 5)
    assert np.allclose(langid.forward_long(lattice, theta, word), np.log(alpha[-1]))
    assert np.allclose(langid.forward(lattice, theta, [word])[0], np.log(alpha[-1]))


def test_predictions_against_plain_sums():
    """Languages and scores of texts with and without kept words, against sums over words one by one."""
    rng = np.random.default_rng(5)
    pieces = tuple(sorted({"▁", *"abcdef", "▁ab", "cd", "ef", "abc", "fed"}))
    theta = np.vstack([rng.dirichlet(np.ones(len(pieces)), 3).T, np.zeros((1, 3))])
    texts = [" ".join("".join(rng.choice(list("abcdefx"), rng.integers(1, 9))) for _ in range(rng.integers(1, 60))) for _ in range(50)] + ["ab" * 50 + " cd", "", "12"]
    for most in (1 << 20, 300):  # bytes: a cache that holds all words, and one that holds a word
        names, scores = langid.Model(pieces, ["x", "y", "z"], theta, most).predict(texts, group=7)
        for text, name, score in zip(texts, names, scores, strict=True):
            own = langid.split_words(text)
            if not own:
                assert (name, score) == ("und", 0.0)
                continue
            logs = sum(langid.forward(langid.Lattice(list(pieces)), theta, [w])[0] for w in own) / max(1.0, len(own) / 20)
            shares = np.exp(logs - logs.max())
            assert name == "xyz"[int(np.argmax(logs))] and score == pytest.approx(1 / shares.sum())


def test_too_many_languages(make_docs):
    docs = make_docs(["a b c"] * 600).withColumn("lang", F.col("doc_id").cast("string"))
    with pytest.raises(ValueError, match="lang"):
        langid.fit(docs, None)
