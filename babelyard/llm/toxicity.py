"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding look-alike characters."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelyard.llm import workers
from babelyard.llm.tables import fold, materialise

#: Letters of other scripts, and the Latin letter that each looks like.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "i",
    "м": "m", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u",
    "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ƅ": "b", "ո": "n", "ս": "u", "օ": "o", "հ": "h", "զ": "q",
}
#: Digits and signs, and the letter that each stands for inside a word.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}
#: Phrases in which a lexicon word does no harm.
EXCEPTIONS = ("trash can", "trash cans", "trash bag", "trash bin", "trash bins", "clown fish", "class clown", "loser bracket", "pond scum")

_FOLDED = str.maketrans(HOMOGLYPHS | {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)} | dict.fromkeys("​‌‍⁠﻿­"))
_DIGITS = str.maketrans(DIGITS)
_FOREIGN = re.compile("[ıɑɡƅ­Ͱ-֏​-‍⁠﻿！-～]")
_MIXED = re.compile(r"(?=[\d@$!|+]*[^\W\d_])[^\W_]*(?:[\d@$!|+]+[^\W_]+)+|[^\W\d_]+\d+(?![^\W_])")
_WORD = re.compile(r"[^\W_]+")
_SIGN = re.compile(r"[\d@$!|+]")
PREFIXES = (4, 5, 6, 7)
TERM = "term string, toxic_docs long, clean_docs long, toxic_times long, clean_times long"


def folded_words(text: str) -> list[str]:
    """Words in lower case, with look-alikes and digits inside words as the letters they stand for;
    l is written i, as both are written 1."""
    text = text.lower()
    if not text.isascii() and _FOREIGN.search(text):
        text = text.translate(_FOLDED).lower()
    if _SIGN.search(text):
        text = _MIXED.sub(lambda m: m[0].translate(_DIGITS), text)
    return _WORD.findall(text.replace("l", "i"))


def terms(word: str) -> list[str]:
    """The word itself and the starts of longer words, as they are looked for in a spaced text."""
    return [f" {word} ", *(f" {word[:n]}" for n in PREFIXES if len(word) > n)]


class Lexicon:
    """Weighted terms and exception phrases in one automaton."""

    def __init__(self, weights: dict[str, float], exceptions=EXCEPTIONS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.automaton.add_word(term, (len(term), weight))
        for phrase in exceptions:
            term = f" {' '.join(folded_words(phrase))} "
            self.automaton.add_word(term, (len(term), None))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def hits(self, words: list[str]) -> float:
        """Sum over the text's words of the largest weight of a term that starts there; none in exceptions."""
        if self.empty or not words:
            return 0.0
        best, spared = {}, set()
        for end, (length, weight) in self.automaton.iter(f" {' '.join(words)} "):
            start = end - length + 1
            if weight is None:
                spared.update(range(start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        return sum(w for start, w in best.items() if start not in spared)


def features(total: float, n_words: int) -> tuple[float, float]:
    """The weight in the text, and its share of the text's length."""
    return math.log1p(total), math.log1p(100 * total / max(n_words, 1))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Weights and a constant, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    keep = ridge * np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def learning_rows(docs: DataFrame, labels: DataFrame, most: int, held_out: int, folds: int) -> DataFrame:
    """text, toxic, half of at most `most` labelled documents outside the held-out fold, the first by a hash of the id.

    A document is one row here, however many rows have its id: of several texts it is the least.
    """
    one = labels.where((fold("doc_id", folds) != held_out) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = one.where("doc_id is not null").orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(most)
    half = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(2)).alias("half")
    # its size is a parameter, so its broadcast is bounded
    held = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return held.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic", half)


def count_terms(frames):
    """For mapInPandas: term counts over the texts of a partition."""
    for frame in frames:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
            own: Counter = Counter()
            for word, n in Counter(folded_words(text)).items():
                for term in terms(word):
                    own[term] += n
            side = 0 if toxic == 1 else 1
            for term, n in own.items():
                row = counts.setdefault(term, [0, 0, 0, 0])
                row[side] += 1
                row[2 + side] += n
        yield pd.DataFrame([(t, *c) for t, c in counts.items()], columns=[c.split()[0] for c in TERM.split(", ")])


def choose_terms(counted: DataFrame, sides: dict[int, int], most: int, least_docs: int, least_z: float) -> dict[str, float]:
    """Log-odds of the terms that toxic documents hold more often than clean ones, beyond chance."""
    toxic, clean = sides.get(1, 0), sides.get(0, 0)
    if not toxic or not clean:
        return {}
    odds = (
        F.log((F.col("toxic_docs") + 0.5) / (toxic - F.col("toxic_docs") + 0.5))
        - F.log((F.col("clean_docs") + 0.5) / (clean - F.col("clean_docs") + 0.5))
    )
    spread = F.sqrt(
        1 / (F.col("toxic_docs") + 0.5) + 1 / (toxic - F.col("toxic_docs") + 0.5)
        + 1 / (F.col("clean_docs") + 0.5) + 1 / (clean - F.col("clean_docs") + 0.5)
    )
    scored = counted.where(F.col("toxic_docs") >= least_docs).select("term", odds.alias("weight"), (odds / spread).alias("z"))
    best = scored.where((F.col("z") >= least_z) & (F.col("weight") >= 1.5)).orderBy(F.desc("z"), "term").limit(most)
    return {r["term"]: float(r["weight"]) for r in best.collect()}


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, most_terms: int = 2_000, least_docs: int = 4, least_z: float = 3.5, held_out: int = 0, folds: int = 5, exceptions=EXCEPTIONS):
    """(weights of terms, exceptions, logistic weights).

    Terms are learnt from one half of the sample, and how their weight in a text speaks for the
    label from the other half. Without labels of both kinds nothing is toxic. The sample and the lexicon's size
    (the most_terms terms that differ most) are parameters that bound the model; all texts are scored by it.
    """
    spark = docs.sparkSession
    workers.bound_batches(spark)
    learn = materialise(learning_rows(docs, labels.select("doc_id", "toxic"), sample, held_out, folds), "toxicity-sample")
    first = learn.where("half = 0")
    counted = first.mapInPandas(count_terms, TERM).groupBy("term").agg(*(F.sum(c).alias(c) for c in ("toxic_docs", "clean_docs", "toxic_times", "clean_times")))
    sides = {int(r[0]): r[1] for r in first.groupBy((F.col("toxic") == 1).cast("int")).count().collect()}
    weights = choose_terms(counted, sides, most_terms, least_docs, least_z)
    sent = spark.sparkContext.broadcast((weights, exceptions))

    def measure(frames):
        lexicon = Lexicon(*sent.value)
        for frame in frames:
            rows = []
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                words = folded_words(text)
                rows.append((*features(lexicon.hits(words), len(words)), float(toxic == 1)))
            yield pd.DataFrame(rows, columns=["a", "b", "y"])

    # the sample bounds these rows
    got = learn.where("half = 1").mapInPandas(measure, "a double, b double, y double").toPandas()
    if weights and got["y"].nunique() == 2:
        logistic = fit_logistic(got[["a", "b"]].to_numpy(), got["y"].to_numpy())
    else:
        logistic = np.array([0.0, 0.0, -10.0])
    return weights, exceptions, logistic


def score_texts(fitted, texts) -> list[float]:
    weights, exceptions, logistic = fitted
    lexicon = workers.hold(("lexicon", hash((tuple(weights.items()), tuple(exceptions)))), lambda: Lexicon(weights, exceptions))
    out = []
    for text in texts:
        words = folded_words(text) if isinstance(text, str) else []
        a, b = features(lexicon.hits(words), len(words))
        out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, a * logistic[0] + b * logistic[1] + logistic[2])))))
    return out


def score_documents(docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5, **how) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Only labels outside the held-out fold are learnt from. Null and empty texts score as texts
    without a lexicon word. A document with several labels counts as toxic if one says so; null labels, and labels without a
    document, don't count. Equal texts have equal scores; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, held_out=held_out, folds=folds, **how))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(sent.value, texts), dtype=float)

    judged = docs.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), score("text").alias("score"))
    return judged.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """docs without the rows that score at least threshold.

    The columns stay, whatever their names. Null and empty texts score as texts without a lexicon word and so stay where labels
    of both kinds are known or none are; repeated rows stay or go together; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **how))

    @F.pandas_udf("boolean")
    def keeps(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(sent.value, texts), dtype=float) < threshold

    return docs.where(keeps("text"))
