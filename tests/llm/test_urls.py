from __future__ import annotations

import collections
import math
import random
import re

import pytest

from babelyard.llm import urls, vocab

PAGES = "page_id long, url string, html string, host string, score string"
CASES = [
    ("http://a.example.org/es/1", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("http://Example.ORG/en/17?x=/es/", "example.org", "/en/17", "example.org/en/1", "block"),
    ("http://example.org/en/27", "example.org", "/en/27", "org/", "allow"),
    ("http://other.org", "other.org", "", None, None),
    ("http://x.com/fr/1#a?b", "x.com", "/fr/1", "com/fr/", "allow"),
    ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    ("http://xcom/de/", "xcom", "/de/", None, None),
    ("ftp://u@h:80?q", "u@h:80", "", None, None),
    ("no scheme", "", "", None, None),
    (None, "", "", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
    ("", "", "", None, None),
]


def test_rules(spark):
    df = spark.createDataFrame([(k, c[0], "", "x", "y") for k, c in enumerate(CASES)], PAGES)
    got = {r.page_id: r for r in urls.filter_urls(df).collect()}
    assert len(got) == len(CASES)
    for k, (_, host, path, rule, verdict) in enumerate(CASES):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == verdict if verdict else got[k].verdict in ("allow", "block")


def test_words():
    own = urls.Segmenter(vocab.whole_words(vocab.read_text(vocab.vocabulary_path())))
    assert own.split("cheapflightsonline") == ("cheap", "flights", "online")
    assert own.split("") == ()
    assert "".join(own.split("qqzzxxqq")) == "qqzzxxqq"
    assert urls.tokens(own, "news.example.com", "/en/2024") == ["h:news", "h:example", "h:com", "p:en", "p:#4"]


def test_bayes_follows_the_rules(spark):
    rows = [(k, f"http://good{w}.org/fr/{w}", "", "", "") for k, w in enumerate(["garden", "music", "school", "garden", "music"])]
    rows += [(10 + k, f"http://{w}casino.com/de/win", "", "", "") for k, w in enumerate(["free", "best", "free"])]
    rows += [(20, "http://freecasino.net/win", "", "", ""), (21, "http://musicschool.net/garden", "", "", ""), (21, "http://musicschool.net/garden", "", "", "")]
    got = {r.page_id: r.verdict for r in urls.filter_urls(spark.createDataFrame(rows, PAGES)).collect()}
    assert (got[20], got[21]) == ("block", "allow")


def test_one_side_or_none(spark):
    only = spark.createDataFrame([(1, "http://a.org/x", "", "", ""), (2, "http://b.net/x", "", "", "")], PAGES)
    assert {r.verdict for r in urls.filter_urls(only).collect()} == {"allow"}
    assert urls.filter_urls(spark.createDataFrame([], PAGES)).count() == 0


def test_weights():
    prior, weights, unseen = urls.fit_naive_bayes([("a", 3, 0), ("b", 0, 3)], (3, 3))
    assert prior == 0 and weights["a"] == pytest.approx(-weights["b"]) and unseen == pytest.approx(0)


def splits(text):
    if not text:
        yield ()
    for end in range(1, len(text) + 1):
        for rest in splits(text[end:]):
            yield (text[:end], *rest)


def test_split_against_all_splits():
    own = urls.Segmenter(["the", "cat", "at", "a", "he", "then", "hen", "or", "thorn", "on"])
    cost = lambda parts: sum(own.cost.get(p, own.unknown if len(p) == 1 else math.inf) for p in parts)
    rng = random.Random(6)
    for text in ["thecat", "thenorth", "athenon", "xq", *("".join(rng.choice("thecanorx") for _ in range(9)) for _ in range(40))]:
        assert cost(own.split(text)) == pytest.approx(min(cost(p) for p in splits(text)))
        assert "".join(own.split(text)) == text


def test_verdicts_against_plain_python(spark, sf):
    """Rules, counts and log-odds of every url of a table, worked out one by one."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    own = urls.Segmenter(vocab.whole_words(vocab.read_text(vocab.vocabulary_path())))
    rows, counts, sides = [], collections.defaultdict(lambda: [0, 0]), [0, 0]
    for r in pages.collect():
        rest = (r.url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(rule), verdict, rule) for verdict, rule in urls.RULES if (host == rule.partition("/")[0] or host.endswith("." + rule.partition("/")[0])) and path.startswith("/" + rule.partition("/")[2])]
        fit = max(fits, default=None)
        rows.append((r.page_id, host, path, fit))
        if fit:
            bad = fit[1] == "block"
            sides[bad] += 1
            for t in urls.tokens(own, host, path):
                counts[t][bad] += 1
    total = [sum(c[k] for c in counts.values()) + len(counts) + 1 for k in (0, 1)]
    odds = lambda t: math.log((counts[t][1] + 1) / total[1]) - math.log((counts[t][0] + 1) / total[0]) if t in counts else math.log(total[0] / total[1])
    got = {r.page_id: r for r in urls.filter_urls(pages).collect()}
    assert len(got) == len(rows) and min(sides) > 0
    for page_id, host, path, fit in rows:
        r = got[page_id]
        assert (r.host, r.path, r.rule) == (host, path, fit[2] if fit else None)
        if fit:
            assert r.verdict == fit[1] and r.score is None
        else:
            score = math.log((sides[1] + 1) / (sides[0] + 1)) + sum(map(odds, urls.tokens(own, host, path)))
            assert r.score == pytest.approx(score) and r.verdict == ("block" if score > 0 else "allow")


def test_long_urls(spark):
    long = "http://" + "abc" * 20_000 + ".net/" + "x" * 20_000
    rows = [(1, "http://a.org/x", "", "", ""), (2, "http://b.com/de/x", "", "", ""), (3, long, "", "", ""), (3, long, "", "", "")]
    got = urls.filter_urls(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == 4 and [len(r.host) for r in got if r.page_id == 3] == [60_004, 60_004]
