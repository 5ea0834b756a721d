"""Quality rules with risk-controlled cutoffs, in DataFrame functions alone."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from babelyard.llm.tables import materialise

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Upper ends (words) of the strata; the last has none.
BANDS = (50, 200, 1000)


@dataclass(frozen=True)
class Rule:
    """Rejects a document whose value is over the cutoff; cutoffs: one for each level, laxest first."""

    name: str
    value: str
    cutoffs: tuple[float, ...]


def _steps(first: float, last: float, n: int = 20) -> tuple[float, ...]:
    return tuple(round(first + (last - first) * k / (n - 1), 6) for k in range(n))


RULES = (
    Rule("symbols", "try_divide(n_symbols, word_chars)", _steps(0.40, 0.02)),
    Rule("repeated_lines", "try_divide(n_dup_lines, n_lines)", _steps(0.95, 0.19)),
    Rule("repeated_words", "try_divide(n_repeat_words, n_words)", _steps(0.95, 0.19)),
    Rule("long_words", "try_divide(word_chars, n_words)", _steps(20.0, 8.6)),
    Rule("capitals", "try_divide(n_capitals, word_chars)", _steps(0.95, 0.19)),
)


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once: a lambda variable is never copied into an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of words found twice or more, the first place included.

    Windows are compared by 64-bit hashes; a document of n windows has equal hashes
    of different ones with a chance of n^2 / 2^65.
    """

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda a, b: F.get(s, a)["h"].eqNullSafe(F.get(s, b)["h"])
            twice = F.filter(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda i: (i > 0) & same(i, i - 1) | (i < F.size(s) - 1) & same(i, i + 1),
            )
            return F.sort_array(F.transform(twice, lambda i: F.get(s, i)["i"]))

        def spans(at: Column) -> Column:
            steps = F.transform(at, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - p, F.lit(window))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_let(_let(placed, places), spans))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - window + 1), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) < window, 0).otherwise(_let(hashes, covered))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, content (a hash of the text) and the counts of its whole text; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    without = lambda chars: F.length(F.translate(text, chars, ""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    by_words = _let(words, lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("repeat")))
    by_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct")))
    rows = docs.select(
        "doc_id", F.xxhash64(text).alias("content"), by_words.alias("w"), by_lines.alias("x"), without(WHITE).alias("word_chars"),
        (F.length(text) - without(SYMBOLS)).alias("n_symbols"),
        (F.length(text) - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_capitals"),
    )
    counts = {
        "n_words": F.col("w.n"), "word_chars": F.col("word_chars"), "n_symbols": F.col("n_symbols"),
        "n_dup_lines": F.col("x.n") - F.col("x.distinct"), "n_repeat_words": F.col("w.repeat"),
        "n_lines": F.col("x.n"), "n_capitals": F.col("n_capitals"),
    }
    return rows.select("doc_id", "content", *(c.cast("long").alias(name) for name, c in counts.items()))


def allowed_rejections(n: Column, risk: float, level: float) -> Column:
    """The most good documents of n that may be rejected: P(Binomial(n, risk) <= k) <= level, or -1.

    The exact test of "the false rejection rate is over risk" at this level; the
    probabilities are summed from k = 0, each from the one before.
    """
    start = F.struct((n * math.log1p(-risk)).cast("double").alias("log_p"), F.lit(0.0).alias("cdf"), F.lit(-1).cast("long").alias("k"))

    def step(s: Column, i: Column) -> Column:
        cdf = s["cdf"] + F.exp(s["log_p"])
        grow = F.log((n - i) / (i + 1)) + math.log(risk / (1 - risk))
        return F.struct((s["log_p"] + F.coalesce(grow, F.lit(-1e9))).alias("log_p"), cdf.alias("cdf"), F.when(cdf <= level, i).otherwise(s["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.ceil(n * risk)), start, step, lambda s: s["k"])


def band() -> Column:
    """The length band of a document: 0 for the shortest."""
    return sum((F.col("n_words") >= end).cast("int") for end in BANDS)


def pool(sizes: list[int], least: int) -> list[int]:
    """The stratum of each band: neighbours are joined until a stratum has `least` labelled good documents, and what is left over
    at the end joins the stratum before it. A stratum is named by its first band."""
    out, held = [], 0
    for k, n in enumerate(sizes):
        if not k or held >= least:
            first, held = k, 0
        out.append(first)
        held += n
    if held < least and first:
        before = out[first - 1]
        out = [before if x == first else x for x in out]
    return out


def fewest(risk: float, level: float) -> int:
    """How many labelled documents a test needs to be able to hold at all: (1 - risk)^n <= level."""
    return math.ceil(math.log(level) / math.log1p(-risk) - 1e-9)


def over(rules, level: int) -> Column:
    """Whether a rule rejects the document at this level."""
    out = F.lit(False)
    for rule in rules:
        out = out | F.coalesce(F.expr(rule.value) > F.lit(float(rule.cutoffs[level])), F.lit(False))
    return out


def cutoffs(measured: DataFrame, labels: DataFrame, rules=RULES, max_false_rejection: float = 0.02, confidence: float = 0.95) -> DataFrame:
    """band, stratum, n_good, allowed, level (or null), and the cutoff (or null) of every rule; a row for each band.

    A level is one cutoff of every rule, and levels grow stricter together: what one rejects the next rejects too. From the
    laxest level on a level is taken while the exact binomial test holds that all rules together reject at most
    max_false_rejection of a stratum's good documents; along such a sequence no further correction is due. Over
    strata the error is divided by the number of bands (Bonferroni), so with the given confidence no stratum loses more. A
    stratum is a length band, or several bands where labels are few (pool): how many labels there are says nothing of values.

    The trials must be independent: a text is one trial however many documents have it, good if no label of them says otherwise.
    """
    one = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    values = [c for c in measured.columns if c not in ("doc_id", "content")]
    held = measured.join(one.where("quality is not null"), "doc_id").withColumn("band", band())
    texts = held.groupBy("content").agg(F.min("quality").alias("quality"), F.min(F.struct("band", *values)).alias("own"))
    good = texts.where("quality = 1").select("own.*")
    levels = range(len(rules[0].cutoffs))
    counts = good.groupBy("band").agg(F.count("*").alias("n"), *(F.count_if(over(rules, j)).alias(f"over_{j}") for j in levels))
    counts = materialise(counts, "quality-counts")
    level = (1 - confidence) / (len(BANDS) + 1)
    sizes = {r["band"]: r["n"] for r in counts.select("band", "n").collect()}  # a row for each band
    strata = pool([sizes.get(k, 0) for k in range(len(BANDS) + 1)], fewest(max_false_rejection, level))
    named = F.array(*(F.lit(x) for x in strata))
    pooled = counts.groupBy(F.get(named, F.col("band")).alias("stratum")).agg(F.sum("n").alias("n_good"), *(F.sum(f"over_{j}").alias(f"over_{j}") for j in levels))
    pooled = pooled.withColumn("allowed", allowed_rejections(F.col("n_good"), max_false_rejection, level))
    # a stricter level rejects no fewer, so the strictest that holds ends the sequence
    taken = F.coalesce(*(F.when(F.col(f"over_{j}") <= F.col("allowed"), F.lit(j)) for j in reversed(levels)))
    chosen = pooled.select("stratum", "n_good", "allowed", taken.alias("level"))
    cut = [F.get(F.array(*(F.lit(float(c)) for c in rule.cutoffs)), F.col("level")).alias(f"cutoff_{rule.name}") for rule in rules]
    bands = counts.sparkSession.range(len(strata)).select(F.col("id").cast("int").alias("band")).withColumn("stratum", F.get(named, F.col("band")))
    return bands.join(F.broadcast(chosen), "stratum", "left").select("band", "stratum", F.coalesce("n_good", F.lit(0)).alias("n_good"), "allowed", "level", *cut)


def quality_rules(docs: DataFrame, labels: DataFrame, rules=RULES, max_false_rejection: float = 0.02, confidence: float = 0.95) -> DataFrame:
    """Every row's counts, base_failed, stratum, failed_rules and kept.

    Null and empty texts have counts of 0 and fail the base rule. A rule without a value (nothing to
    divide by) rejects nothing, nor does any rule in a stratum without a level, so without enough labelled good
    documents only the base rules decide. A document with several labels is good if all say so; labels
    without a document and null labels don't count. Repeated rows are judged one by one; empty tables give no rows.
    """
    measured = materialise(measure(docs), "quality-measured")
    chosen = cutoffs(measured, labels.select("doc_id", "quality"), rules, max_false_rejection, confidence)
    # one row for each band, of which there are len(BANDS) + 1
    judged = measured.withColumn("band", band()).join(F.broadcast(chosen), "band", "left")
    failed = F.filter(
        F.array(*(F.when(F.expr(rule.value) > F.col(f"cutoff_{rule.name}"), F.lit(rule.name)) for rule in rules)),
        lambda x: x.isNotNull(),
    )
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = judged.withColumn("base_failed", base).withColumn("failed_rules", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
