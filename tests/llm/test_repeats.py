from __future__ import annotations

import hashlib
import random
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from babelyard.llm import repeats, tables


def brute(texts: list[str | None], words: int) -> list[tuple[int, int, str]]:
    """Words, words removed and what is left, by listing every window."""
    split = [(t or "").encode().split() for t in texts]
    windows = Counter(tuple(w[i : i + words]) for w in split for i in range(len(w) - words + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - words + 1):
            if windows[tuple(w[i : i + words])] > 1:
                gone |= set(range(i, i + words))
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def written(spark) -> set[str]:
    """The tables in the scratch folder, with their numbers."""
    return {p.name for p in Path(tables.scratch_root(spark).removeprefix("file://")).glob("repeats-*")}


def got(docs, words: int, anchor: int = 3, digest: bool = False):
    rows = repeats.remove_repeats(docs, words, anchor, digest).collect()
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows), rows


def wanted(pairs, words: int):
    return Counter((i, *x) for (i, _), x in zip(pairs, brute([t for _, t in pairs], words), strict=True))


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(make_docs, seed):
    rng = random.Random(seed)
    vocabulary = "a b c d e".split() if seed else [f"w{k}" for k in range(60)]
    pool = [[rng.choice(vocabulary) for _ in range(rng.randint(4, 30))] for _ in range(8)]
    texts = [" ".join(w for _ in range(rng.randint(1, 5)) for w in (rng.choice(pool) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 15))])) for _ in range(60)]
    pairs = list(enumerate([*texts, *texts[:5]]))
    assert got(make_docs(pairs), 8)[0] == wanted(pairs, 8)


def test_passage_at_any_place_and_length(make_docs):
    own = lambda k, n: " ".join(f"d{k}x{j}" for j in range(n))
    for shared in (9, 10, 11, 25):
        passage = " ".join(f"p{j}" for j in range(shared))
        pairs = [(0, passage), (1, f"{own(1, 30)}\t{passage}\n{own(2, 3)}"), (2, f"{passage} {own(3, 4)}"), (3, own(4, 40)), (4, own(5, 3) + " " + passage)]
        assert got(make_docs(pairs), 10)[0] == wanted(pairs, 10)


def test_odd_rows(odd, spark):
    pairs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found, rows = got(odd, 35, 12)
    assert found == wanted(pairs, 35)
    for r in rows:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_empty_table(empty):
    assert got(empty, 35, 12)[1] == []


def test_hot_group_with_one_difference_each(make_docs):
    base = [f"b{k}" for k in range(60)]
    pairs = [(k, " ".join([*base[:20], f"own{k}", *base[21:]])) for k in range(300)] + [(k, " ".join(base)) for k in range(300, 500)]
    assert got(make_docs(pairs), 12, 4)[0] == wanted(pairs, 12)


def test_digest(make_docs):
    pairs = [(0, "a b c"), (1, "x " * 20), (2, "x " * 20)]
    found, _ = got(make_docs(pairs), 5, 2, digest=True)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found == Counter([(0, 3, 0, sha("a b c")), (1, 20, 20, sha("")), (2, 20, 20, sha(""))])


def test_session_setting_stays(make_docs, spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got(make_docs(["a b c"]), 5)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_steps_leave_neither_tables_nor_shuffle_files(make_docs, spark):
    def shuffled():
        held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
        return {f for f in held.split() if "/shuffle_" in f}

    tables_before, files_before = written(spark), shuffled()
    setting = spark.conf.get(tables.CLEANUP_CONF)
    passage = " ".join(f"p{k}" for k in range(40))
    repeats.remove_repeats(make_docs([f"{passage} own{k} {passage[:60]}" for k in range(50)]), 10, 4)
    assert sorted(name.rsplit("-", 1)[0] for name in written(spark) - tables_before) == ["repeats-copies", "repeats-cut", "repeats-rows"]
    end = time.time() + 20  # files are deleted in the background
    while shuffled() - files_before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() - files_before
    assert spark.conf.get(tables.CLEANUP_CONF) == setting


def test_least_places():
    rng = np.random.default_rng(1)
    for width in range(1, 12):
        x = rng.integers(0, 4, 40)
        assert repeats.least_places(x, width).tolist() == [i + int(np.argmin(x[i : i + width])) for i in range(len(x) - width + 1)]


def test_every_window_lies_in_the_cell_of_its_anchor():
    text = " ".join(random.Random(5).choices("abcdefgh", k=300)).encode()
    _, _, first, last = repeats.cells(text, 10, 4)
    assert [k for a, b in zip(first, last, strict=True) for k in range(a, b + 1)] == list(range(300 - 9))
