"""URL filters: rule list, host word segmentation, and naive Bayes over host and path words."""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from babelyard.llm import vocab, workers

#: (verdict, rule): a host, and from the first slash the start of a path.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Runs of letters whose splits are kept; longer ones are worked out each time.
LONGEST_KEPT = 64


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path. A url that is null or has no :// has both empty."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring({url}, locate('://', {url}) + 3)")).otherwise("")
    return pages.withColumn("host", F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).withColumn(
        "path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    )


def rule_column(rules=RULES) -> Column:
    """The longest rule that fits, as struct(verdict, rule), or null."""
    fits = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, slash, path = rule.partition("/")
        inside = (F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))
        test = inside & F.startswith(F.col("path"), F.lit(slash + path))
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        fits = F.when(test, value) if fits is None else fits.when(test, value)
    return fits if fits is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


class Segmenter:
    """Splits joined words by a unigram Viterbi search.

    A word's probability follows its rank in the vocabulary by Zipf's law; a letter outside
    any word costs more than the rarest word, so unknown stretches are kept short.
    """

    def __init__(self, words: list[str]):
        total = sum(1 / (rank + 10) for rank in range(len(words)))
        self.cost = {w: math.log(total * (rank + 10)) for rank, w in enumerate(words)}
        self.longest = max(map(len, words), default=1)
        # a single letter is a word only where nothing longer fits
        self.unknown = math.log(total * (len(words) + 10)) + 2
        for w in [w for w in self.cost if len(w) == 1]:
            self.cost[w] = self.unknown
        self._kept = lru_cache(maxsize=100_000)(self._split)

    def split(self, text: str) -> tuple[str, ...]:
        return self._kept(text) if len(text) <= LONGEST_KEPT else self._split(text)

    def _split(self, text: str) -> tuple[str, ...]:
        best, back = [0.0], [0]
        for end in range(1, len(text) + 1):
            low, start = best[end - 1] + self.unknown, end - 1
            for at in range(max(0, end - self.longest), end):
                cost = self.cost.get(text[at:end])
                if cost is not None and best[at] + cost < low:
                    low, start = best[at] + cost, at
            best.append(low)
            back.append(start)
        out, end = [], len(text)
        while end:
            out.append(text[back[end] : end])
            end = back[end]
        return tuple(reversed(out))


def tokens(segmenter: Segmenter, host: str, path: str) -> list[str]:
    """Words of the host and of the path, marked by where they stand. Numbers become their
    length and letters outside the vocabulary one mark, so that there is a bounded set of tokens."""
    out = []
    for mark, text in (("h:", host), ("p:", path.lower())):
        for letters, digits, other in re.findall(r"([a-z]+)|([0-9]+)|([^\x00-\x7f]+)", text):
            if letters:
                out += [mark + (w if len(w) > 1 and w in segmenter.cost else "?") for w in segmenter.split(letters)]
            else:
                out.append(f"{mark}#{min(len(digits), 9)}" if digits else f"{mark}~{min(len(other), 9)}")
    return out


def _segmenter(vocabulary: str) -> Segmenter:
    return workers.hold(("segmenter", vocabulary), lambda: Segmenter(vocab.whole_words(vocabulary)))


def fit_naive_bayes(counts: list[tuple[str, int, int]], pages: tuple[int, int], alpha: float = 1.0) -> tuple[float, dict[str, float], float]:
    """(prior, weight of each token, weight of an unseen one); positive speaks for block.
    counts: (token, in allowed pages, in blocked pages)."""
    size = len(counts) + 1
    allowed, blocked = sum(c[1] for c in counts) + alpha * size, sum(c[2] for c in counts) + alpha * size
    weights = {t: math.log((b + alpha) / blocked) - math.log((a + alpha) / allowed) for t, a, b in counts}
    prior = math.log(pages[1] + 1) - math.log(pages[0] + 1)
    return prior, weights, math.log(allowed / blocked)


def filter_urls(pages: DataFrame, rules=RULES, vocabulary_path: str | None = None, id_col: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, score, tokens of every row.

    Rules decide where one fits. The other urls are judged by multinomial naive Bayes that learns
    from all urls a rule decides: hosts are split into words by Segmenter, and host words and path words are
    its tokens (at most twice the vocabulary and a few marks, so the model's broadcast is bounded).
    score is the log-odds for block, and a url is blocked above 0; score and tokens are null where a rule decides. Null urls and urls without ://
    have an empty host and path and no tokens. Without rows that rules block, or rows that they allow, all others are allowed.
    Repeated rows are judged alike, one row each; an empty table gives no rows.
    """
    spark = pages.sparkSession
    words = spark.sparkContext.broadcast(vocab.read_text(vocabulary_path or vocab.vocabulary_path()))

    @F.pandas_udf("array<string>")
    def split(host: pd.Series, path: pd.Series) -> pd.Series:
        own = _segmenter(words.value)
        return pd.Series([tokens(own, h, p) for h, p in zip(host, path, strict=True)], dtype=object)

    ruled = with_host_and_path(pages.select(F.col(id_col).alias("page_id"), "url")).withColumn("fit", rule_column(rules))
    known = ruled.where("fit is not null").select((F.col("fit.verdict") == "block").alias("bad"), "host", "path")
    sides = {r[0]: r[1] for r in known.groupBy("bad").count().collect()}
    counts = (
        known.select("bad", F.explode(split("host", "path")).alias("token"))
        .groupBy("token")
        .agg(F.count_if(~F.col("bad")).alias("a"), F.count_if("bad").alias("b"))
        .collect()  # bounded by the vocabulary
    )
    model = fit_naive_bayes([tuple(r) for r in sorted(counts)], (sides.get(False, 0), sides.get(True, 0)))
    if len(sides) < 2:
        model = (-1.0, {}, 0.0)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<score double, tokens array<string>>")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        own, (prior, weights, unseen) = _segmenter(words.value), sent.value
        found = [tokens(own, h, p) if isinstance(h, str) else None for h, p in zip(host, path, strict=True)]
        return pd.DataFrame({"score": [None if ts is None else prior + sum(weights.get(t, unseen) for t in ts) for ts in found], "tokens": found})

    open_ones = (F.when(F.col("fit").isNull(), F.col(c)) for c in ("host", "path"))
    return ruled.withColumn("judged", judge(*open_ones)).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("judged.score") > 0, "block").otherwise("allow")).alias("verdict"),
        F.col("judged.score").alias("score"), F.col("judged.tokens").alias("tokens"),
    )
