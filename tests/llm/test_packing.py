from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest

from babelyard.llm import packing, vocab


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocab.vocabulary_path())


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")


def check(rows, texts, tokenizer, capacity, slack):
    own, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, pieces in own.items():
        ids, at = ids_of(tokenizer, texts[doc]), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity and (capacity - at <= slack or at & (at - 1) == 0)
    return own


def test_round_trip(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.pack_documents(docs, group_docs=50).collect()
    assert set(check(rows, texts, tokenizer, 4096, 64)) == set(texts)


def test_odd_rows(odd, empty, tokenizer):
    rows = packing.pack_documents(odd).collect()
    assert sum(r.start == 0 for r in rows) == 9
    assert [r.doc_tokens for r in rows if r.doc_id in (0, 1)] == [1, 1]
    lone = [r for r in rows if r.doc_id is None]
    assert lone and sum(r.length for r in lone) == lone[0].doc_tokens
    assert packing.pack_documents(empty).count() == 0


def test_large_ids_beside_null(make_docs):
    ids = {2**60 + 1, 2**60 + 2, None}
    assert {r.doc_id for r in packing.pack_documents(make_docs([(i, "a b c") for i in ids])).collect()} == ids


def test_tree_is_first_fit():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 100, 300).tolist()
    free, bins = [], []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = next((k for k, f in enumerate(free) if f >= sizes[item]), len(free))
        if at == len(free):
            free.append(100)
            bins.append([])
        free[at] -= sizes[item]
        bins[at].append(item)
    assert packing.first_fit_decreasing(sizes, 100) == bins


def test_loose_bins_need_no_padding():
    docs = [(600, [], 1, [0] * 4) for _ in range(7)]
    pieces = packing.pack_group(docs, 1024, 16)
    filled = defaultdict(int)
    for _, _, size, _, sequence, _ in pieces:
        filled[sequence] += size
    assert sum(filled.values()) == 4200
    assert all(n & (n - 1) == 0 for n in filled.values())


def test_words_coded_alike(tokenizer):
    coder = vocab.CachedEncoder(vocab.read_text(vocab.vocabulary_path()))
    assert coder.words.usable
    texts = [
        "don't stop", "αbeta Σ", "<|endoftext|> x", "İstanbul", "áb", "x y.z", "\x1c a", "naïve Ünder ſt", "²3 1/2 ª",
        " ", "", "aaaa AAAA aaaaaaaa", "\u200bhi", "日本語 text", "a\x00b", "ẞ ß", "Ⅷ ⅷ", "e\u0301 é", "co-op... ###",
    ]
    for text, got in zip(texts, coder.encode(texts), strict=True):
        assert got == np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text


def test_only_new_parts_are_worked_on():
    coder = vocab.CachedEncoder(vocab.read_text(vocab.vocabulary_path()))
    long = "x" * 65
    first = list(coder.encode([f"one two {long}", "two 3!"]))
    assert coder.learn({"one", "two", "3!"}) == set() and long not in coder.known
    assert coder.learn({"two", "four", "4"}) == {"four", "4"}
    assert list(coder.encode([f"one two {long}", "two 3!"])) == first
    every = "".join(map(chr, range(128))) * 2 + "aB1 c-D"
    assert vocab.PLAIN_ASCII.findall(every.lower()) == vocab.PLAIN.findall(every.lower())


def test_repeated_rows_are_dealt_to_many_groups(make_docs):
    docs = make_docs([(None, "")] * 3000 + [(k, f"text {k}") for k in range(500)])
    rows = packing.pack_documents(docs, group_docs=256).collect()
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    groups = {}
    for r in rows:
        groups.setdefault(r.sequence_id >> 32, []).append(r)
    assert len(groups) == 14 and max(sum(r.start == 0 for r in g) for g in groups.values()) < 350
