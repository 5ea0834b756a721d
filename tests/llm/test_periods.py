from __future__ import annotations

import random

import numpy as np
import pytest

from babelyard.llm import periods


def brute(words: list, min_exponent: int = 4, min_length: int = 6) -> list[tuple[int, int, int]]:
    """start, length, period of every run, straight from the definition."""
    n, out = len(words), []
    for q in range(1, n // min_exponent + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            length = e - s + q
            if e > s and length >= max(min_length, min_exponent * q):
                part = words[s : s + length]
                if not any(all(part[i] == part[i + d] for i in range(length - d)) for d in range(1, q)):
                    out.append((s, length, q))
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(rng: random.Random, n: int) -> list[list[bytes]]:
    out = []
    for _ in range(n):
        words: list[str] = []
        for _ in range(rng.randint(0, 5)):
            block = rng.choices("abc", k=rng.randint(1, 7))
            words += block * rng.randint(1, 7) + block[: rng.randint(0, len(block))]
            words += rng.choices("abcdxyz", k=rng.randint(0, 6))
        out.append([w.encode() for w in words])
    return out


@pytest.mark.parametrize("exponent", [2, 3, 4, 5])
def test_runs_equal_the_definition(exponent):
    own = texts(random.Random(exponent), 150)
    found = periods.runs_of(own, exponent, 6)
    assert [[tuple(r) for r in x.tolist()] for x in found] == [brute(w, exponent, 6) for w in own]


def test_lag_ranges_give_what_one_scan_gives():
    for words in texts(random.Random(9), 60):
        ids = periods.word_ids([words])
        parts = [periods.find_runs(ids, np.array([len(ids)]), lo, lo + 1) for lo in range(1, len(ids) // 4 + 1, 2)]
        assert sorted(map(tuple, np.concatenate([*parts, np.empty((0, 3), np.int64)]).tolist())) == sorted(map(tuple, periods.runs_of([words])[0].tolist()))


def expected(text: str | None):
    words = (text or "").split(" ") if text else []
    words = [w for w in words if w]
    runs = brute(words) if len(words) < 2000 else None
    return words, runs


def test_operator_near_and_dealt(spark, make_docs):
    rng = random.Random(3)
    rows = [(k, b" ".join(w).decode()) for k, w in enumerate(texts(rng, 80))] + [(3, "a b " * 9), (3, "a b " * 9), (None, "x " * 7)]
    docs = make_docs(rows, extra=True)
    want = []
    for i, t in rows:
        words = t.split()
        runs = brute(words)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((str(i), len(words), runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    for lags in (periods.LAGS, 2):
        got = [(str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periods.periodic_runs(docs, lags=lags).collect()]
        assert sorted(got) == sorted(want)


def test_odd_rows_and_empty_table(odd, empty):
    got = {(r["doc_id"], r["n_words"]): r for r in periods.periodic_runs(odd).collect()}
    assert len(periods.periodic_runs(odd).collect()) == odd.count()
    assert got[(0, 0)]["runs"] == [] and got[(0, 0)]["collapsed"] == ""
    assert [tuple(x) for x in got[(6, 24_000)]["runs"]] == [(0, 24_000, 8)] and got[(6, 24_000)]["collapsed"] == "a b c d e f g h"
    assert periods.periodic_runs(empty).collect() == []


def test_long_periodic_text_takes_few_comparisons():
    words = [b"x"] * 200_000
    assert [tuple(r) for r in periods.runs_of([words])[0].tolist()] == [(0, 200_000, 1)]
    block = [str(k).encode() for k in range(101)]
    found = periods.find_runs(periods.word_ids([block * 1000]), np.array([101_000]), 200, 25_250)
    assert len(found) == 0  # the run has a lesser period
