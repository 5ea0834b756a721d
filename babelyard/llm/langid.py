"""Language identification by unigram pieces, summed over all segmentations of a word."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from babelyard.llm import vocab, workers
from babelyard.llm.tables import fold, materialise

PIECES = "piece_bpe_32k.model"
START = "▁"
#: Letters and the marks on them; numbers written with signs of their own (a half, a circled one) are no letters.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
ASCII_WORD = re.compile(r"[a-z]+")
#: Longer words are summed in logarithms, since products of so many probabilities would vanish, and are not kept in caches.
PLAIN = 40
#: Places of a long word that are looked up at once.
STRETCH = 4096
#: P of a letter that is in no piece, in every language.
UNKNOWN = 1e-7
MOST_LANGUAGES = 500
_BASE = 1_000_003


def read_pieces(path: str | None = None) -> list[str]:
    """The vocabulary's pieces of letters in lower case, with or without the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or vocab.vocabulary_path(PIECES))
    own = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
    body = lambda p: p.removeprefix(START)
    return sorted({p for p in own if p == START or WORD.fullmatch(body(p))})


def _hash(codes: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial of the letters, over the last axis."""
    value = np.full(codes.shape[:-1], codes.shape[-1], dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(codes.shape[-1]):
            value = value * np.uint64(_BASE) + codes[..., k].astype(np.uint64)
    return value


class Lattice:
    """Which pieces stand where in words: the same for all languages."""

    def __init__(self, pieces: list[str]):
        self.size, self.lengths = len(pieces), sorted({1, *map(len, pieces)})
        hashes = np.array([_hash(np.array([ord(c) for c in p], dtype=np.uint64)) for p in pieces], dtype=np.uint64)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces have one hash")

    def spans(self, codes: np.ndarray, size: int) -> np.ndarray:
        """By start: the number of the piece of this size, or -1."""
        key = _hash(np.lib.stride_tricks.sliding_window_view(codes, size, axis=-1))
        at = np.minimum(np.searchsorted(self.sorted, key), self.size - 1)
        return np.where(self.sorted[at] == key, self.order[at], -1).astype(np.int32)

    def edges(self, words: list[str]):
        """For words of one length, by end and start: (start, end, piece numbers or -1) of every span
        of one letter or with a piece in some word."""
        n = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), n)
        found = {}
        for size in (x for x in self.lengths if x <= n):
            ids = self.spans(codes, size)
            found[size] = ids, (ids >= 0).any(axis=0) | (size == 1)
        sizes = sorted(found, reverse=True)
        for end in range(1, n + 1):
            for size in sizes:
                if size <= end and found[size][1][end - size]:
                    yield end - size, end, found[size][0][:, end - size]


def by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        out.setdefault(len(w), []).append(k)
    return out


def _weights(theta: np.ndarray, ids: np.ndarray, single: bool) -> np.ndarray:
    """P of each span's piece, a row for each word; theta has a row of zeros (or of UNKNOWN) at its end for -1."""
    own = theta[ids]
    if single:
        own = np.maximum(own, UNKNOWN)
    return own


def _log(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(p)


def forward_long(lattice: Lattice, theta: np.ndarray, word: str) -> np.ndarray:
    """forward() of one word, in logarithms. Only the sums of as many places as the longest piece has are kept, and
    pieces are looked up a stretch at a time, so a word of any length takes bounded memory besides its letters."""
    codes, longest = np.frombuffer(word.encode("utf-32-le"), dtype="<u4"), lattice.lengths[-1]
    single = _log(_weights(theta, np.arange(len(theta)), True))
    longer = _log(theta)
    ring = np.full((longest + 1, theta.shape[1]), -np.inf)
    ring[0] = 0.0
    for low in range(0, len(codes), STRETCH):
        first = max(0, low - longest + 1)
        part = codes[first : low + STRETCH]
        found = [(size, lattice.spans(part, size)) for size in lattice.lengths if size <= len(part)]
        for end in range(low + 1, min(low + STRETCH, len(codes)) + 1):
            terms = [ring[(end - 1) % (longest + 1)] + single[found[0][1][end - 1 - first]]]
            for size, ids in found[1:]:
                if end - size >= first and (k := ids[end - size - first]) >= 0:
                    terms.append(ring[(end - size) % (longest + 1)] + longer[k])
            ring[end % (longest + 1)] = np.logaddexp.reduce(terms)
    return ring[len(codes) % (longest + 1)]


def forward(lattice: Lattice, theta: np.ndarray, words: list[str]) -> np.ndarray:
    """log P(word | language), words by languages: the sum over all segmentations.
    theta: pieces by languages, and a last row of zeros."""
    out = np.empty((len(words), theta.shape[1]))
    for n, numbers in by_length(words).items():
        if n > PLAIN:
            for k in numbers:
                out[k] = forward_long(lattice, theta, words[k])
            continue
        edges = lattice.edges([words[k] for k in numbers])
        alpha = np.zeros((n + 1, len(numbers), theta.shape[1]))
        alpha[0] = 1.0
        for start, end, ids in edges:
            alpha[end] += alpha[start] * _weights(theta, ids, end - start == 1)
        out[numbers] = np.log(alpha[n])
    return out


def expected_counts(lattice: Lattice, theta: np.ndarray, words: list[str], languages: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often each piece is expected in each language, by forward and backward sums.
    A word is read by the pieces of its own language."""
    total = np.zeros(theta.shape[0] * theta.shape[1])
    width = theta.shape[1]
    for n, numbers in by_length(words).items():
        own, count = languages[numbers], times[numbers].astype(float)
        edges = [(s, e, ids, _weights_of(theta, ids, own, e - s == 1)) for s, e, ids in lattice.edges([words[k] for k in numbers])]
        logs = n > PLAIN
        none, sure = (-np.inf, 0.0) if logs else (0.0, 1.0)
        if logs:
            edges = [(s, e, ids, _log(p)) for s, e, ids, p in edges]
        alpha, beta = np.full((n + 1, len(numbers)), none), np.full((n + 1, len(numbers)), none)
        alpha[0] = beta[n] = sure
        for s, e, _, p in edges:
            alpha[e] = np.logaddexp(alpha[e], alpha[s] + p) if logs else alpha[e] + alpha[s] * p
        for s, e, _, p in sorted(edges, key=lambda x: -x[0]):
            beta[s] = np.logaddexp(beta[s], beta[e] + p) if logs else beta[s] + beta[e] * p
        for s, e, ids, p in edges:
            share = (np.exp(alpha[s] + p + beta[e] - alpha[n]) if logs else alpha[s] * p * beta[e] / alpha[n]) * count
            known = ids >= 0
            total += np.bincount(ids[known] * width + own[known], weights=share[known], minlength=len(total))
    return total.reshape(theta.shape)


def _weights_of(theta, ids, own, single):
    p = theta[ids, own]
    return np.maximum(p, UNKNOWN) if single else p


def split_words(text: str | None) -> list[str]:
    """Marked words of a text, in lower case."""
    if not text:
        return []
    text = text.lower()
    return [START + w for w in (ASCII_WORD if text.isascii() else WORD).findall(text)]


def normalise(counts: np.ndarray, smoothing: float) -> np.ndarray:
    """Piece probabilities of each language, and the row for spans without a piece."""
    own = counts[:-1] + smoothing
    return np.vstack([own / own.sum(axis=0), np.zeros((1, counts.shape[1]))])


def learning_rows(docs: DataFrame, held_out: int | None, folds: int, per_language: int) -> DataFrame:
    """text, lang of at most per_language documents of each language, the first by a hash of the id.

    Languages are counted first. What lies far beyond a language's share of the hash is left out where it
    is read, so few rows of each language are ranked, however many it has.
    """
    allowed = docs.where("lang is not null and text is not null and doc_id is not null")
    if held_out is not None:
        allowed = allowed.where(fold("doc_id", folds) != held_out)
    counts = allowed.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    if not counts:
        return allowed.select("lang", "text")
    space = 1 << 40
    cuts = {r[0]: min(space, space * (2 * per_language + 100) // r[1]) for r in counts}
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(space))
    cut = F.create_map(*(F.lit(x) for pair in cuts.items() for x in pair))
    few = allowed.select("lang", "text", "doc_id", place.alias("place")).where(F.col("place") < F.element_at(cut, F.col("lang")))
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    return few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("lang", "text")


class Model:
    """Piece probabilities by language; scores texts, and keeps the words that it has scored up to most_bytes."""

    #: What a kept word takes besides a number for each language.
    ENTRY = 230

    def __init__(self, pieces: tuple[str, ...], languages: list[str], theta: np.ndarray, most_bytes: int = 48 << 20):
        self.lattice, self.languages, self.theta = Lattice(list(pieces)), languages, theta
        self.most = max(1, most_bytes // (self.ENTRY + 8 * len(languages)))
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.empty((1024, len(self.languages)))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.most:
            self.clear()
            new = list(words)
        if not new:
            return
        at = len(self.known)
        if at + len(new) > len(self.table):
            grown = np.empty((max(at + len(new), 2 * len(self.table)), len(self.languages)))
            grown[:at] = self.table[:at]
            self.table = grown
        self.known.update(zip(new, range(at, at + len(new)), strict=True))
        self.table[at : at + len(new)] = forward(self.lattice, self.theta, new)

    def sums(self, texts: list[list[str]]) -> list[np.ndarray]:
        """log P of each text's words by language, added up."""
        every = {w for own in texts for w in own}
        long = {w: forward_long(self.lattice, self.theta, w) for w in every if len(w) > PLAIN}
        self.learn(every - long.keys())
        out, get = [], self.known.__getitem__
        for own in texts:
            kept = [w for w in own if w not in long] if long else own
            total = self.table[np.fromiter(map(get, kept), dtype=np.int64, count=len(kept))].sum(axis=0)
            for w in own if len(kept) < len(own) else ():
                if w in long:
                    total = total + long[w]
            out.append(total)
        return out

    def predict(self, texts: list[str | None], group: int = 256, enough: int = 20) -> tuple[list[str], list[float]]:
        """Language and confidence. Words depend on one another, so what a long text says counts
        as much as `enough` words would."""
        names, scores = [], []
        for at in range(0, len(texts), group):
            words = [split_words(t) for t in texts[at : at + group]]
            if not self.languages:
                words = [[]] * len(words)
            for own, total in zip(words, self.sums(words), strict=True):
                if not own:
                    names.append("und")
                    scores.append(0.0)
                    continue
                logs = total / max(1.0, len(own) / enough)
                best = int(np.argmax(logs))
                names.append(self.languages[best])
                scores.append(float(1 / np.exp(logs - logs[best]).sum()))
        return names, scores


def fit(
    docs: DataFrame, held_out: int | None = 1, folds: int = 3, per_language: int = 400, rounds: int = 3, smoothing: float = 0.01,
    pieces_path: str | None = None, longest_learnt: int = 1000,
):
    """(pieces, languages, theta) by expectation maximisation over the words of learning_rows.

    The words are counted once; each round sends the probabilities (pieces by languages) to all tasks and
    adds up their expected counts. Words of over longest_learnt letters are scored like others but teach nothing. A table
    that names over MOST_LANGUAGES languages is refused: its `lang` holds something else, and the model would have no bound.
    """
    spark = docs.sparkSession
    workers.bound_batches(spark)
    pieces = tuple(read_pieces(pieces_path))

    def count(frames):
        for frame in frames:
            rows = [(lang, w) for lang, text in zip(frame["lang"], frame["text"], strict=True) for w in split_words(text) if len(w) <= longest_learnt]
            got = pd.DataFrame(rows, columns=["lang", "word"]).groupby(["lang", "word"], as_index=False).size()
            yield got.rename(columns={"size": "n"})

    counted = learning_rows(docs, held_out, folds, per_language).mapInPandas(count, "lang string, word string, n long")
    words = materialise(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    languages = sorted(r[0] for r in words.select("lang").distinct().collect())
    place = {lang: k for k, lang in enumerate(languages)}
    theta = normalise(np.zeros((len(pieces) + 1, max(1, len(languages)))), 1.0)
    for _ in range(rounds if languages else 0):
        sent = spark.sparkContext.broadcast((pieces, place, theta))

        def expect(frames, sent=sent):
            own_pieces, own_place, own_theta = sent.value
            lattice = workers.hold(("lattice", hash(own_pieces)), lambda: Lattice(list(own_pieces)))
            total = np.zeros_like(own_theta)
            for frame in frames:
                for at in range(0, len(frame), 5000):
                    part = frame.iloc[at : at + 5000]
                    total += expected_counts(lattice, own_theta, part["word"].tolist(), part["lang"].map(own_place).to_numpy(), part["n"].to_numpy())
            piece, lang = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "lang": lang, "n": total[piece, lang]})

        got = words.mapInPandas(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        found = got.toPandas()  # at most pieces times languages
        counts = np.zeros((len(pieces) + 1, len(languages)))
        counts[found["piece"], found["lang"]] = found["n"]
        theta = normalise(counts, smoothing)
    return pieces, languages, theta


def identify(docs: DataFrame, model=None, folds: int = 3, held_out: int = 1, **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    The score is the best language's share among the learned languages. Texts that are null or have no letter
    are `und` with a score of 0, and so are all texts if no document has a language to learn from.
    Equal texts get equal predictions, of tied languages the first by name; an empty table gives no rows.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model or fit(docs, held_out, folds, **how))

    @F.pandas_udf("struct<lang string, score double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, scores = _model(sent.value).predict([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang": names, "score": scores})

    judged = docs.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), predict("text").alias("got"))
    return judged.select("doc_id", "held_out", F.col("got.lang").alias("lang_pred"), F.col("got.score").alias("score"))


def _model(fitted) -> Model:
    """One model a worker and fit, so that its cache lasts."""
    return workers.hold(("language", hash((fitted[0], tuple(fitted[1]), fitted[2].tobytes()))), lambda: Model(*fitted))


def reject_unknown(docs: DataFrame, least: float = 0.5, **how) -> DataFrame:
    """docs without the rows whose text has no language: no letters, or no language that has at least `least` of the score.

    The columns stay, whatever their names. Null, empty and letterless texts go; repeated rows stay or go together; without
    a document to learn from all rows go; an empty table gives no rows.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(fit(docs, **how))

    @F.pandas_udf("boolean")
    def keeps(texts: pd.Series) -> pd.Series:
        fitted = sent.value
        names, scores = _model(fitted).predict([t if isinstance(t, str) else None for t in texts])
        return pd.Series([n != "und" and s >= least for n, s in zip(names, scores, strict=True)], dtype=bool)

    return docs.where(keeps("text"))
