"""Soft-membership mixing: document rates whose expected domain token totals match targets, in DataFrame functions alone."""

from __future__ import annotations

import warnings
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from babelyard.llm.tables import materialise

DOMAINS = ("good", "poor", "toxic")
#: Share of all tokens that each domain is to have.
TARGETS = {"good": 0.95, "poor": 0.03, "toxic": 0.02}
#: Statistics of a text, each in one of BINS steps.
STATISTICS = ("length", "symbols", "calls", "capitals", "digits", "repeats", "width")
BINS = 64
#: A telling word is known by its hash; two of one slot would count as one feature.
SLOTS = 4096
#: What stands between words: all ASCII characters but letters and digits.
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def domain_column() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")


def labelled_sample(labels: DataFrame, most: int) -> DataFrame:
    """doc_id, domain of at most `most` labelled documents, the first by a hash of the id.
    A document with several labels has its worst one."""
    one = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    named = one.select("doc_id", domain_column().alias("domain")).where("doc_id is not null and domain is not null")
    return named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _words(text: Column) -> Column:
    """Words in lower case; the first and the last part may be empty."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), APART)


def telling_words(docs: DataFrame, sample: DataFrame, most: int, least_docs: int = 5) -> list[str]:
    """The words whose presence says most about the domain (mutual information), from the sample."""
    # the sample's size is a parameter, so its broadcast is bounded
    held = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("domain", F.array_distinct(_words(F.col("text"))).alias("words"))
    totals = {r[0]: r[1] for r in held.groupBy("domain").count().collect()}
    every = sum(totals.values())
    if not every:
        return []
    # outer: else Spark would test each text for words before the join, over all documents
    per_word = held.select("domain", F.explode_outer("words").alias("word")).where("word <> ''").groupBy("word").agg(
        F.count("*").alias("n"), *(F.count_if(F.col("domain") == d).alias(f"n_{d}") for d in DOMAINS)
    ).where(F.col("n") >= least_docs)
    gain = F.lit(0.0)
    for d in DOMAINS:
        share = totals.get(d, 0) / every
        if share:
            for hit, of in ((F.col(f"n_{d}"), F.col("n")), (totals[d] - F.col(f"n_{d}"), every - F.col("n"))):
                gain += F.when(hit > 0, hit / every * F.log(hit / (of * share))).otherwise(0.0)
    best = per_word.select("word", gain.alias("gain")).orderBy(F.desc("gain"), "word").limit(most)
    return [r[0] for r in best.collect()]


def slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int")


def features(docs: DataFrame, words: list[str], keep: tuple[Column, ...]) -> DataFrame:
    """row (the columns to keep), n_tokens, bins (a step of each statistic), slots (of the telling words held)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    chosen = F.array(*(F.lit(w) for w in words)) if words else F.array().cast("array<string>")

    def count(signs: str) -> Column:
        """How many characters of a class stand in the text."""
        return F.length(F.regexp_replace(text, f"[^{signs}]+", ""))

    parts = docs.select(
        F.struct(*keep).alias("row"), _words(F.col("text")).alias("words"), F.split(text, "\n").alias("split_lines"),
        F.length(text).alias("chars"), count("#*$%&|<>").alias("symbols"), count("!").alias("calls"), count("A-Z").alias("capitals"), count("0-9").alias("digits"),
    )
    empty = lambda x: F.when(x == "", 1).otherwise(0)
    n_words = F.size("words") - empty(F.get("words", F.lit(0))) - F.when(F.size("words") > 1, empty(F.element_at("words", -1))).otherwise(0)
    rows = parts.select(
        "row", "chars", "symbols", "calls", "capitals", "digits", F.transform(F.array_intersect("words", chosen), slot).alias("slots"), n_words.cast("long").alias("n_tokens"),
        F.size("split_lines").alias("lines"), F.size(F.array_distinct("split_lines")).alias("distinct"),
    )
    share = lambda part, of: F.when(of > 0, F.floor(F.sqrt(part / of) * 12)).otherwise(0)
    steps = {
        "length": F.floor(F.log2(F.col("n_tokens") + 1)),
        "symbols": share(F.col("symbols"), F.col("chars")),
        "calls": share(F.col("calls"), F.col("chars")),
        "capitals": share(F.col("capitals"), F.col("chars")),
        "digits": share(F.col("digits"), F.col("chars")),
        "repeats": share(F.col("lines") - F.col("distinct"), F.col("lines")),
        "width": F.floor(F.when(F.col("n_tokens") > 0, F.col("chars") / F.col("n_tokens") * 2).otherwise(0)),
    }
    bins = F.array(*(F.least(steps[name], F.lit(BINS - 1)).cast("int") for name in STATISTICS))
    return rows.select("row", "n_tokens", bins.alias("bins"), "slots")


def fit_logistic(rows: list[tuple[str, list[int], list[int]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-3, batch: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression on (domain, bins, slots) by adaptive gradient steps over small batches: weights, a row for
    each bin of each statistic and then for each slot, a column for each domain; and the domains' constants.
    """
    width = len(STATISTICS) * BINS + SLOTS
    weights, constants = np.zeros((width, len(DOMAINS))), np.zeros(len(DOMAINS))
    if not rows:
        return weights, constants
    own = [[k * BINS + x for k, x in enumerate(bins)] + [len(STATISTICS) * BINS + x for x in slots] for _, bins, slots in rows]
    used = sorted({x for r in own for x in r})
    place = {x: k for k, x in enumerate(used)}
    x = np.zeros((len(rows), len(used) + 1), dtype=np.float32)
    x[:, -1] = 1.0
    for k, r in enumerate(own):
        np.add.at(x[k], [place[f] for f in r], 1.0)
    y = np.array([[d == domain for d in DOMAINS] for domain, _, _ in rows], dtype=np.float32)
    w, seen = np.zeros((x.shape[1], len(DOMAINS)), dtype=np.float32), np.full((x.shape[1], len(DOMAINS)), 1e-3, dtype=np.float32)
    shrink = np.full((x.shape[1], 1), decay, dtype=np.float32)
    shrink[-1] = 0.0
    for step in range(rounds):
        for at in range(0, len(x), batch):
            some = x[at : at + batch]
            logs = some @ w
            powers = np.exp(logs - logs.max(axis=1, keepdims=True))
            pull = some.T @ (powers / powers.sum(axis=1, keepdims=True) - y[at : at + batch]) + shrink * w
            seen += pull * pull
            w -= np.float32(rate / (1 + step / 4)) * pull / np.sqrt(seen)
    weights[used], constants = w[:-1], w[-1].astype(float)
    return weights, constants


def _numbers(values) -> Column:
    """A literal array; written as one SQL text, since it may have thousands of numbers."""
    return F.expr("array(" + ", ".join(f"{float(x)!r}D" for x in values) + ")")


def _added(table: Column) -> Column:
    """The sum of table over a document's slots."""
    return F.aggregate("slots", F.lit(0.0), lambda total, x: total + F.get(table, x))


def log_scores(weights: np.ndarray, constants) -> list[Column]:
    """Logs of the posteriors but for one constant a document, a column for each domain."""
    out = []
    for i, constant in enumerate(constants):
        said = F.lit(float(constant))
        for k in range(len(STATISTICS)):
            own = weights[k * BINS : (k + 1) * BINS, i]
            if own.any():
                said = said + F.get(_numbers(own), F.get("bins", F.lit(k)))
        own = weights[len(STATISTICS) * BINS :, i]
        if own.any():
            said = said + _added(_numbers(own))
        out.append(said)
    return out


def softmax(logs: Column) -> Column:
    powers = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    whole = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / whole)


def learn_classifier(rows: DataFrame, sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """From one row of each sample document, whichever of its texts comes first by its features."""
    # the sample's size is a parameter, so both the broadcast and the rows that come back are bounded
    held = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "domain").agg(F.min(F.struct("bins", "slots")).alias("f"))
    ordered = sorted(held.collect(), key=lambda r: hash_order(r["doc_id"]))
    return fit_logistic([(r["domain"], r["f"]["bins"], r["f"]["slots"]) for r in ordered])


def hash_order(doc_id: int) -> int:
    """An order of documents that has nothing to do with how they were numbered."""
    return zlib.crc32(str(doc_id).encode())


def _inverse(matrix: list[list[float]]) -> list[list[float]]:
    """Gauss-Jordan; the matrix has a row for each domain."""
    n = len(matrix)
    rows = [list(r) + [float(i == j) for j in range(n)] for i, r in enumerate(matrix)]
    for i in range(n):
        pivot = max(range(i, n), key=lambda r: abs(rows[r][i]))
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n):
            if r != i:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i], strict=True)]
    return [r[n:] for r in rows]


def fit_rates(members: DataFrame, totals: list[float], ridge: float, max_rate: float | None, rounds: int, tolerance: float) -> tuple[Column, list[float]]:
    """(rate as a column over p_0.., what each domain's expected total comes to).

    Least squares of the expected totals against `totals`, in the metric of the members' second
    moments (and a little, so that a domain with hardly a token doesn't outweigh the others), plus ridge times the token-weighted square of rate - 1, over 0 <= rate, and rate <= max_rate where one is given.
    Each step of projected gradient needs one number a domain from all documents: their totals
    under the present rates. A document's rate is the steps so far, written as one expression, so nothing is kept for a document
    between steps; in this metric a step goes nearly all the way, and rounds should stay below 50, as each makes the expression deeper.
    """
    k = range(len(totals))
    p = [F.col(f"p_{i}") for i in k]
    moments = members.agg(
        F.sum("n_tokens").alias("n"), *(F.sum(F.col("n_tokens") * p[i] * p[j]).alias(f"m_{i}_{j}") for i in k for j in k if j >= i)
    ).first()
    n = float(moments["n"] or 0)
    if not n:
        return F.lit(1.0), [0.0 for _ in k]
    gram = [[(moments[f"m_{min(i, j)}_{max(i, j)}"] or 0.0) / n + (i == j) * 1e-3 for j in k] for i in k]
    metric = _inverse(gram)
    step, rate, reached = 1 / (1 + ridge), F.lit(1.0), []
    for _ in range(rounds):
        got = members.agg(*(F.sum(F.col("n_tokens") * p[i] * rate) for i in k)).first()
        reached = [float(x or 0.0) for x in got]
        off = [(reached[i] - totals[i]) / n for i in k]
        if max(abs(x) for x in off) <= tolerance:
            break
        pull = [sum(metric[i][j] * off[j] for j in k) for i in k]
        slope = p[0] * pull[0]
        for i in k[1:]:
            slope += p[i] * pull[i]
        rate = rate * (1 - step * ridge) + step * ridge - slope * step
        rate = F.greatest(F.lit(0.0), rate if max_rate is None else F.least(F.lit(float(max_rate)), rate))
    else:
        got = members.agg(*(F.sum(F.col("n_tokens") * p[i] * rate) for i in k)).first()
        reached = [float(x or 0.0) for x in got]
    return rate, reached


@dataclass
class Mixer:
    """A fitted classifier and the rates that follow from it."""

    words: list[str]
    weights: np.ndarray
    constants: np.ndarray
    rate: Column | None = None
    #: Shares of the budget by domain: the targets, and what the rates come to.
    wanted: list[float] | None = None
    reached: list[float] | None = None

    def posteriors(self, rows: DataFrame) -> DataFrame:
        """row, n_tokens, p_0.. of the rows of features()."""
        scored = rows.select("row", "n_tokens", F.array(*log_scores(self.weights, self.constants)).alias("logs"))
        scored = scored.select("row", "n_tokens", softmax(F.col("logs")).alias("p"))
        return scored.select("row", "n_tokens", *(F.get("p", F.lit(k)).alias(f"p_{k}") for k in range(len(DOMAINS))))

    def repeat_rows(self, docs: DataFrame) -> DataFrame:
        """docs with every row as often as its rate says. All of it is worked out from the row itself, so no text moves.

        The columns stay, whatever their names. Null and empty texts have rates like others; rows that are equal are rounded alike;
        an empty table gives no rows.
        """
        rows = features(docs, self.words, tuple(docs[c] for c in docs.columns))
        rated = self.posteriors(rows).withColumn("rate", self.rate)
        times = copies(F.col("row.doc_id"), F.xxhash64("row.text"))
        return rated.select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] | None = None,
    tilts: dict[str, float] | None = None,
    budget: float = 1.0,
    max_rate: float | None = None,
    ridge: float = 1e-3,
    rounds: int = 25,
    tolerance: float = 1e-4,
    sample: int = 20_000,
    n_words: int = 256,
) -> tuple[Mixer, DataFrame]:
    """The mixer, and row (doc_id), n_tokens, p_0.. of every row of docs.

    With tilts the targets follow the input: each domain's own share times its tilt, made to add up to 1.
    Such targets can be reached whatever the input holds, where a fixed share of a domain that isn't there can't: the mixer says what was
    reached, and a miss by over a hundredth of the budget is a warning.
    """
    learn = materialise(labelled_sample(labels, sample), "mixing-sample")
    words = telling_words(docs, learn, n_words)
    rows = materialise(features(docs, words, (F.col("doc_id"),)), "mixing-features")
    mixer = Mixer(words, *learn_classifier(rows.select("row.doc_id", "bins", "slots"), learn))
    members = materialise(mixer.posteriors(rows), "mixing-members")
    held = members.agg(F.sum("n_tokens"), *(F.sum(F.col("n_tokens") * F.col(f"p_{k}")) for k in range(len(DOMAINS)))).first()
    tokens, own = float(held[0] or 0), [float(x or 0) for x in held[1:]]
    if tilts:
        tilted = [tilts[d] * x for d, x in zip(DOMAINS, own, strict=True)]
        shares = [x / (sum(tilted) or 1.0) for x in tilted]
    else:
        shares = [(targets or TARGETS)[d] for d in DOMAINS]
    mixer.rate, totals = fit_rates(members, [share * budget * tokens for share in shares], ridge, max_rate, rounds, tolerance)
    mixer.wanted, mixer.reached = shares, [x / (budget * tokens or 1.0) for x in totals]
    if tokens and max(abs(a - b) for a, b in zip(mixer.wanted, mixer.reached, strict=True)) > 0.01:
        warnings.warn(f"mixing targets {mixer.wanted} are out of reach: the rates come to {mixer.reached}", stacklevel=2)
    return mixer, members


def mix(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, n_tokens, a posterior of every domain, rate, miss; one row for each row of docs.

    miss, the same in all rows, is by how much of the budget the total that is furthest from its target is off.

    The classifier learns from at most `sample` labelled documents and holds n_words words. The
    targets are shares of budget times the input's tokens. Without labels every document has the same
    posteriors. Null and empty texts have no tokens and a rate like others; rates say how often a document is to be used on average.
    Labels without a document and null labels don't count. Repeated rows have equal rates; a labelled document that stands in several rows teaches once; an empty table gives no rows.
    """
    mixer, members = fit(docs, labels, **how)
    miss = F.lit(float(max(abs(a - b) for a, b in zip(mixer.wanted, mixer.reached, strict=True)))).alias("miss")
    return members.select("row.doc_id", "n_tokens", *(F.col(f"p_{k}").alias(f"p_{d}") for k, d in enumerate(DOMAINS)), mixer.rate.alias("rate"), miss)


def copies(doc_id: Column, content: Column, seed: int = 11) -> Column:
    """How often a row is to stand: its rate, rounded up or down by a hash of the row, so that the mean is the rate."""
    part = F.pmod(F.xxhash64(doc_id, content, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(F.col("rate") + part).cast("int")
