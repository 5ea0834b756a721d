"""License scans: phrases, and an exact set-similarity join of text blocks with templates, in DataFrame functions alone."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrase, label.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Notices by which works state their licence, and paragraphs of the licences themselves: label, text.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
)
#: Words that a block must hold, and such that it must not, for the label: they tell licences of one family apart.
TOLD_BY = {
    "cc-by-4.0": (("attribution", "4"), ("noderivatives", "nd", "noncommercial", "nc", "sharealike", "sa")),
    "cc-by-nc-4.0": (("nc", "4"), ("nd", "sa")),
    "gpl-3.0": (("gnu", "3"), ("lesser", "affero")),
}
#: Templates of fewer distinct words name a licence by one or two of them: all have to be there.
SHORT = 10
#: Words of a text that are compared as one block; blocks overlap, so that every window lies in one.
BLOCK = 2048
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(text: Column) -> Column:
    """The words of a text in lower case, one space between them."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), APART, " "))


def template_words(text: str) -> list[str]:
    return list(dict.fromkeys(w for w in re.split(APART, text.lower()) if w))


def window_length(text: str, threshold: float) -> int:
    """As many words as leave the template's own a share of threshold."""
    return math.ceil(len([w for w in re.split(APART, text.lower()) if w]) / max(threshold, 0.1) - 1e-9)


def needed(words: int, threshold: float) -> int:
    """How many of a template's distinct words a window has to hold."""
    return words if words < SHORT else max(1, math.ceil(threshold * words - 1e-9))


def _literals(values) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def phrase_places(words: Column, phrase: str) -> Column:
    """Starts of a phrase in an array of words."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        test = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            test &= F.get(words, i + k) == part
        return test

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def scan_phrases(docs: DataFrame, phrases=PHRASES) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word and base (an array of labels) to docs."""
    padded = F.concat(F.lit(" "), F.col("spaced"), F.lit(" "))
    inside = [F.contains(padded, F.lit(f" {p} ")) for p, _ in phrases]
    found_any = inside[0]
    for x in inside[1:]:
        found_any |= x

    def places(words: Column) -> Column:
        own = [F.when(x, phrase_places(words, p)).otherwise(F.array().cast("array<int>")) for x, (p, _) in zip(inside, phrases, strict=True)]
        return F.flatten(F.array(*own))

    # words are listed only for a text that holds a phrase
    at = F.when(found_any, F.get(F.transform(F.array(F.split(F.col("spaced"), " ")), places), F.lit(0)))
    labels = F.filter(F.array(*(F.when(x, F.lit(label)) for x, (_, label) in zip(inside, phrases, strict=True))), lambda x: x.isNotNull())
    n_words = F.when(F.col("spaced") == "", 0).otherwise(F.length("spaced") - F.length(F.replace(F.col("spaced"), F.lit(" "), F.lit(""))) + 1)
    return (
        docs.withColumn("at", at)
        .withColumn("base", F.array_sort(F.array_distinct(labels)))
        .withColumn("n_words", n_words.cast("long"))
        .withColumn("n_base", F.coalesce(F.size("at"), F.lit(0)).cast("long"))
        .withColumn("first_word", F.array_min("at").cast("long"))
        .withColumn("last_word", F.array_max("at").cast("long"))
        .drop("at")
    )


class Templates:
    """Template words in the order of their global frequency, and what the filters need of them."""

    def __init__(self, templates, threshold: float, frequency: dict[str, int]):
        rank = lambda w: (frequency.get(w, 0), w)
        self.rows = []
        for number, (label, text) in enumerate(templates):
            words = sorted(template_words(text), key=rank)
            need = needed(len(words), threshold)
            # a block with `need` of the words holds one of these at least
            self.rows.append((number, label, words, need, window_length(text, threshold), words[: len(words) - need + 1], *TOLD_BY.get(label, ((), ()))))
        self.universe = sorted({w for r in self.rows for w in r[2]}, key=rank)
        self.prefix = sorted({w for r in self.rows for w in r[5]})
        self.longest = max([1, *(r[4] for r in self.rows)])

    def table(self, spark) -> DataFrame:
        """One row for each word of a prefix: bounded by the templates' words."""
        rows = [
            F.struct(
                F.lit(w).alias("token"), F.lit(at).alias("at"), F.lit(n).alias("template"), F.lit(label).alias("label"), _literals(words).alias("words"),
                F.lit(need).alias("need"), F.lit(span).alias("span"), _literals(must).alias("must"), _literals(never).alias("never"),
            )
            for n, label, words, need, span, prefix, must, never in self.rows for at, w in enumerate(prefix)
        ]
        none = "array<struct<token:string,at:int,template:int,label:string,words:array<string>,need:int,span:int,must:array<string>,never:array<string>>>"
        return spark.range(1).select(F.inline(F.array(*rows) if rows else F.array().cast(none)))


def word_frequency(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many documents each of the given words stands."""
    held = F.array_intersect(F.split("spaced", " "), _literals(words))
    counted = docs.select(F.explode(held).alias("w")).groupBy("w").count()
    return {r[0]: r[1] for r in counted.collect()}  # at most as many rows as words


def known_templates(docs: DataFrame, templates, threshold: float) -> Templates:
    return Templates(templates, threshold, word_frequency(docs, sorted({w for _, t in templates for w in template_words(t)})))


def similar_blocks(docs: DataFrame, known: Templates, block: int = BLOCK) -> DataFrame:
    """key columns, template, label, containment: of each template the windows of words, whatever lines they cross, that hold
    enough of its distinct words, all that it must hold and none that it must not. A window begins with a word of the template and
    has window_length words. docs: doc_id, content, spaced.

    Texts are cut into overlapping blocks of a bounded number of words. Prefix, length and positional filters find the templates
    that a block may hold; only of those its windows are counted.
    """
    prefix = _literals(known.prefix)
    step = max(1, block - known.longest + 1)
    words = F.split("spaced", " ")
    hits = docs.where(F.arrays_overlap(words, prefix)).withColumn("w", words)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(step))
    blocks = hits.select("doc_id", "content", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i + 1, step + known.longest - 1))).alias("w"))
    # words outside the universe are in no template: `held`, in global order, is all that counts of a block
    blocks = blocks.withColumn("held", F.array_intersect(_literals(known.universe), "w"))
    pairs = blocks.select("doc_id", "content", "w", "held", F.explode(F.array_intersect("held", prefix)).alias("token")).join(F.broadcast(known.table(docs.sparkSession)), "token")
    place = F.array_position("held", F.col("token")) - 1
    # of the pair's first common word: no more can follow than either side still has
    first = F.get(F.array_intersect("held", "words"), F.lit(0)) == F.col("token")
    can = 1 + F.least(F.size("words") - F.col("at") - 1, F.size("held") - place - 1)
    near = pairs.where((F.size("held") >= F.col("need")) & first & (can >= F.col("need")))
    near = near.where(F.size(F.array_intersect("held", "words")) >= F.col("need"))
    begins = F.filter(F.sequence(F.lit(1), F.least(F.size("w"), F.lit(step))), lambda k: F.array_contains("words", F.get("w", k - 1)))

    def common(k: Column) -> Column:
        own = F.slice("w", k, F.col("span"))
        told = (F.size(F.array_intersect("must", own)) == F.size("must")) & (F.size(F.array_intersect("never", own)) == 0)
        return F.when(told, F.size(F.array_intersect(own, F.col("words")))).otherwise(0)

    found = near.withColumn("common", F.array_max(F.transform(begins, common))).where(F.col("common") >= F.col("need"))
    return found.select("doc_id", "content", "template", "label", (F.col("common") / F.size("words")).alias("containment"))


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    labels joins the phrases' labels with those of templates that a bounded window of words holds, in one line or over several; score
    is 1 where a phrase stands, else the largest containment found, else 0. Null and empty texts
    have no words and no labels (empty strings). Rows with a null doc_id and rows that share one are told apart by their text;
    repeated rows give equal rows; an empty table gives no rows.
    """
    rows = docs.select("doc_id", spaced(F.col("text")).alias("spaced"), F.xxhash64("text").alias("content"))
    known = known_templates(rows, templates, threshold)
    matches = (
        similar_blocks(rows, known)
        .groupBy("doc_id", "content")
        .agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
        .withColumnsRenamed({"doc_id": "m_id", "content": "m_content"})
    )
    base = scan_phrases(rows).drop("spaced")
    joined = base.join(matches, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("content") == F.col("m_content")), "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"), score.alias("score"),
    )
