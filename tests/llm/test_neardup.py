from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from babelyard.llm import components, neardup, shingles

WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def shingled(text):
    w = WORD.findall((text or "").lower())
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else None


def brute(rows):
    """doc_id -> (class_id, n_copies, n_links) of rows without repeated ids."""
    sets = {d: shingled(t) for d, t in rows}
    by_set = defaultdict(list)
    for d, s in sets.items():
        if s:
            by_set[s].append(d)
    own = list(by_set)
    root = list(range(len(own)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for i, a in enumerate(own):
        for j in range(i):
            n = len(a & own[j])
            if n / (len(a) + len(own[j]) - n) >= 0.8:
                root[find(i)] = find(j)
                links[i] += len(by_set[own[j]])
                links[j] += len(by_set[a])
    groups = defaultdict(list)
    for i, s in enumerate(own):
        groups[find(i)] += by_set[s]
    out = {d: (d, 1, 0) for d, s in sets.items() if not s}
    for i, s in enumerate(own):
        for d in by_set[s]:
            out[d] = (min(groups[find(i)]), len(by_set[s]), links[i] + len(by_set[s]) - 1)
    return out


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"e{rng.randrange(5000)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("chunk", [4, 256])
def test_against_brute_force(make_docs, chunk):
    rng = random.Random(3)
    texts = family(rng, 60, 150, 8) + family(rng, 25, 60, 3) + family(rng, 20, 400, 12)
    texts += [t for t in texts[:10] for _ in range(3)] + [t.upper() + "!" for t in texts[10:14]]
    texts += [" ".join(f"u{rng.randrange(9999)}" for _ in range(80)) for _ in range(60)]
    texts += ["one", "one", "one two", "One, two.", "", " ", "a b c d e", "a b c d e f", "x " * 3000]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    join = neardup.JaccardJoin(make_docs(rows), chunk_rows=chunk)
    got = {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in join.run().collect()}
    assert got == brute(rows)


def test_against_brute_force_on_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in neardup.jaccard_classes(docs).collect()} == brute(rows)


def test_odd_rows(odd, empty):
    rows = neardup.jaccard_classes(odd).collect()
    assert len(rows) == 9
    assert [(r.class_id, r.n_copies, r.n_links) for r in rows if r.doc_id == 3] == [(3, 2, 1)]
    assert [(r.class_id, r.n_links) for r in rows if r.doc_id == 0] == [(0, 0)]
    assert [r.class_id for r in rows if r.doc_id is None] == [None]
    assert neardup.jaccard_classes(empty).count() == 0


def test_large_ids_beside_null(make_docs):
    text = "a text of more than five words that is written twice"
    got = neardup.jaccard_classes(make_docs([(2**60 + 3, text), (2**60 + 1, text), (None, None)])).collect()
    assert {(r.doc_id, r.class_id, r.n_copies) for r in got} == {(2**60 + 3, 2**60 + 1, 2), (2**60 + 1, 2**60 + 1, 2), (None, None, 1)}


def test_one_of_each_group_stays(odd, make_docs):
    text = "a text of more than five words that is written twice"
    docs = make_docs([(4, text), (2, text.upper()), (2, text.upper()), (9, "another text that has nothing in common with it"), (None, text), (None, "only rows without an id hold this"), (None, "only rows without an id hold this")], extra=True)
    kept = neardup.keep_first(docs)
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("2", text.upper()), ("9", "another text that has nothing in common with it"), ("None", "only rows without an id hold this")])
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in neardup.keep_first(odd).collect()) == ["0", "1", "2", "3", "5", "6", "None"]


def test_pruning_keeps_what_may_reach_the_threshold():
    for n in (26, 130):
        least = neardup.least_matches(n, 0.8, 1e-6)
        tail = lambda m: sum(math.comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(m + 1))  # noqa: B023, E731
        assert tail(least) >= 1e-6 > tail(least - 1)
    same = np.zeros((2, 130), dtype=np.uint32)
    other = np.arange(260, dtype=np.uint32).reshape(2, 130)
    both = np.vstack([same, other])
    assert neardup.prune(both, np.array([0, 0]), np.array([1, 2]), 0.8, 1e-6).tolist() == [0]


def test_minhash_estimates_similarity():
    rng = random.Random(5)
    a, b = shingles.parameters(neardup.BANDS * neardup.ROWS)
    x, y = family(rng, 2, 300, 0)[0], None
    words = x.split()
    words[10] = words[100] = words[200] = "new"
    y = " ".join(words)
    p, q = shingles.shingle_set(x), shingles.shingle_set(y)
    true = len(shingled(x) & shingled(y)) / len(shingled(x) | shingled(y))
    assert shingles.jaccard(p, q) == pytest.approx(true)
    assert abs((shingles.minhash(p, a, b) == shingles.minhash(q, a, b)).mean() - true) < 0.12
    assert len(shingles.shingle_set("Ärger: x2 ÄRGER")) == 1 and len(shingles.shingle_set(None)) == 0


def test_components(spark):
    rng = random.Random(7)
    chain = [(k, k + 1) for k in range(0, 60)]
    star = [(1000, 1000 + k) for k in range(1, 50)]
    edges = chain + star + [(5000, 5001), (5001, 5000), (7, 7)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    expected = {k: 0 for k in range(61)} | {1000 + k: 1000 for k in range(50)} | {5000: 5000, 5001: 5000}
    assert got == expected
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_long_words_are_told_apart():
    """Words of more than a table of weights, of the same letters in another order."""
    a, b = "x" * 4096 + "y" * 4096, "y" * 4096 + "x" * 4096
    assert shingles.shingle_set(a).tolist() != shingles.shingle_set(b).tolist()
    assert shingles.shingle_set(a).tolist() == shingles.shingle_set(a.upper()).tolist()
    rng = random.Random(1)
    long = "".join(rng.choice("abc") for _ in range(20_000))
    moved = long[4096:8192] + long[:4096] + long[8192:]
    assert shingles.shingle_set(long)[0] != shingles.shingle_set(moved)[0]


def test_one_row_of_classes_with_null_and_shared_ids(make_docs):
    base = [f"w{k}" for k in range(60)]
    other = [*base[:30], "changed", *base[31:]]
    far = [f"v{k}" for k in range(60)]
    rows = [(None, " ".join(base)), (None, " ".join(other)), (7, " ".join(far)), (7, " ".join([*far[:30], "changed", *far[31:]])), (None, "..."), (None, "..."), (None, None)]
    kept = [(r.doc_id, r.text) for r in neardup.keep_first(make_docs(rows)).collect()]
    assert len(kept) == 5 and sum(i == 7 for i, _ in kept) == 1
    assert sum(i is None and t is not None and "w" in t for i, t in kept) == 1 and kept.count((None, "...")) == 2


def test_common_members():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 30))).astype(np.uint64) for _ in range(30)]
    for split in (0, 11):
        got = neardup.common_members(sets, split, width=8)
        for i, a in enumerate(sets[: split or None]):
            for j, b in enumerate(sets[split:]):
                own = len(set(a.tolist()) & set(b.tolist()))
                assert got[i, j] == own or (not split and i == j)


def test_likely_is_prune_of_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 9, 130)
    signatures = np.array([np.where(rng.random(130) < rng.random() * 0.6, rng.integers(0, 9, 130), base) for _ in range(40)], dtype=np.uint32)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(15), np.arange(15, 40), indexing="ij"))
    kept = np.zeros((15, 25), dtype=bool)
    left = neardup.prune(signatures, a, b, 0.8, 1e-6)
    kept[a[left], b[left] - 15] = True
    assert (neardup.likely(signatures[:15], signatures[15:], 0.8, 1e-6) == kept).all() and kept.any() and not kept.all()


def test_hot_keys_are_spread(spark):
    from babelyard.llm.tables import spread_join

    many = spark.createDataFrame([(0, k) for k in range(1000)] + [(k, -k) for k in range(1, 50)] + [(None, 5)], "key long, v long")
    few = spark.createDataFrame([(k, f"x{k}") for k in range(40)], "key long, name string")
    got = sorted(tuple(r) for r in spread_join(many, few, "key", "v").select("key", "v", "name").collect())
    assert got == sorted([(0, k, "x0") for k in range(1000)] + [(k, -k, f"x{k}") for k in range(1, 40)])
