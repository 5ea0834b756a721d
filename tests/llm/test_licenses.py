from __future__ import annotations

import re

from pyspark.sql import functions as F

from babelyard.llm import licenses


def words(text):
    return [w for w in re.split(licenses.APART, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def windows(own, threshold):
    """label, containment of every window of words that holds enough of a template."""
    for label, template in licenses.TEMPLATES:
        t, size = set(licenses.template_words(template)), licenses.window_length(template, threshold)
        must, never = licenses.TOLD_BY.get(label, ((), ()))
        for i in range(len(own)):
            held = set(own[i : i + size])
            if own[i] in t and len(t & held) >= (len(t) if len(t) < 10 else threshold * len(t) - 1e-9) and set(must) <= held and not held & set(never):
                yield label, len(t & held) / len(t)


def brute(text, threshold=0.8):
    own, at, labels = words(text), [], set()
    for phrase, label in licenses.PHRASES:
        parts = phrase.split()
        hits = [i for i in range(len(own)) if own[i : i + len(parts)] == parts]
        at += hits
        labels |= {label} if hits else set()
    more, best = set(), 0.0
    for label, share in windows(own, threshold):
        more.add(label)
        best = max(best, share)
    return len(own), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more)), 1.0 if at else best


TEXTS = [
    "Mit license mit LICENSE, MIT license", "the GNU General Public\nLicense", "cc-by", "ccby", "Éapache license", "apache  license.", "x",
    "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in it",
    "a\nReleased under the MIT License.\nb\nThis work is licensed under a Creative Commons Attribution 4.0 International License",
    "Redistribution and use in source and binary forms with or without modification are permitted provided",
    "Licensed under CC BY-NC 4.0.", "this program is free software", None, "", "license " * 2000,
]


def test_against_brute_force(make_docs):
    rows = licenses.scan_licenses(make_docs([*TEXTS, (3, "mit license"), (None, "mit license"), (None, "")], extra=True)).collect()
    every = [(k, t) for k, t in enumerate(TEXTS)] + [(3, "mit license"), (None, "mit license"), (None, "")]
    got = sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9))) for r in rows)
    assert got == sorted(str((i, *brute(t)[:-1], round(brute(t)[-1], 9))) for i, t in every)


def test_against_brute_force_on_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.scan_licenses(docs).collect()}
    assert got == {r.doc_id: brute(r.text)[:-1] for r in docs.collect()}


def test_lower_thresholds_find_more(make_docs):
    docs = make_docs(TEXTS)
    for threshold in (0.3, 0.6, 1.0):
        got = {r.doc_id: r.labels for r in licenses.scan_licenses(docs, threshold=threshold).collect()}
        assert got == {k: brute(t, threshold)[5] for k, t in enumerate(TEXTS)}


def test_without_templates(make_docs):
    got = licenses.scan_licenses(make_docs(["Released under the MIT License."]), templates=()).collect()
    assert [(r.labels, r.score) for r in got] == [("mit", 1.0)]


def test_empty(empty):
    assert licenses.scan_licenses(empty).count() == 0


WRAPPED = {
    "mit": "Copyright (c) someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including",
    "bsd": " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:\n * 1. Redistributions",
    "gpl": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU\n# General Public License as published by\n# the Free Software Foundation, either",
    "apache-2.0": "// you may not use this file except\n// in compliance with the License.\n// You may obtain a copy of\n// the License at\n//",
}


def test_notices_wrapped_over_lines(make_docs):
    prose = "a word of the plain text\n" * 300
    texts = [before + t + after for t in WRAPPED.values() for before, after in (("", ""), (prose, "\n" + prose))]
    got = sorted((r.doc_id, r.labels, r.score) for r in licenses.scan_licenses(make_docs(texts)).collect())
    assert [(k, label) for k, label, _ in got] == [(k, name) for k, name in enumerate(n for n in WRAPPED for _ in (0, 1))]
    assert all(score == 1.0 for _, _, score in got)


def test_words_far_apart_are_no_notice(make_docs):
    scattered = "\n".join(w + " other words stand between" for w in licenses.template_words(licenses.TEMPLATES[2][1]))
    assert [(r.labels, r.score) for r in licenses.scan_licenses(make_docs([scattered])).collect()] == [("", 0.0)]


def test_windows_against_brute_force(make_docs):
    notices = [*WRAPPED.values(), "\n".join(WRAPPED.values()), " ".join(WRAPPED.values()), "\n".join("x y " + w for w in WRAPPED["gpl"].split()), "\n".join(WRAPPED["mit"].split()[5:24])]
    for threshold in (0.4, 0.8):
        for r in licenses.scan_licenses(make_docs(notices), threshold=threshold).collect():
            want = brute(notices[r.doc_id], threshold)
            assert (r.labels, round(r.score, 9)) == (want[5], round(want[6], 9))


def labels(make_docs, *texts):
    return [r.labels for r in licenses.scan_licenses(make_docs(list(texts))).orderBy("doc_id").collect()]


def test_a_notice_names_its_own_licence_only(make_docs):
    assert labels(
        make_docs, "Released under the BSD License", "Released under the Apache License, see file", "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "the band released" + " word" * 3000 + " an album under" + " word" * 3000 + " and the license",
        "Licensed under CC BY-NC-SA 4.0", "This work is licensed under the GNU Lesser General Public License, version 3", "Licensed under CC BY-NC 4.0", "This work is licensed under the GNU General Public License, version 3",
    ) == ["", "apache", "cc-by", "", "", "cc-by", "", "cc-by,cc-by-nc-4.0", "gpl,gpl-3.0"]


def test_blocks_overlap(make_docs, spark):
    notice = WRAPPED["bsd"].split(" 1. ")[0]
    texts = ["word " * n + notice + " word" * 300 for n in range(70, 130, 3)]
    rows = make_docs(texts).selectExpr("doc_id", "text", "xxhash64(text) as content").withColumn("spaced", licenses.spaced(F.col("text")))
    known = licenses.known_templates(rows, licenses.TEMPLATES, 0.8)
    for block in (90, 120, 2048):
        best = licenses.similar_blocks(rows, known, block).groupBy("doc_id", "label").agg(F.max("containment").alias("best")).where("label = 'bsd'")
        found = {(r.doc_id, r.label): r.best for r in best.collect()}
        assert found == {(k, "bsd"): 1.0 for k in range(len(texts))}


def test_very_long_texts(make_docs):
    """A million words in one line, of one template word, and of all words of one template beside it."""
    texts = ["merchantability " * 1_000_000, "noninfringement\n" * 300_000, "word " * 500_000 + "Released under the MIT License"]
    assert labels(make_docs, *texts) == ["", "", "mit"]
