"""A corpus from documents to packed sequences, in stages that each call one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read again
before the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from babelyard.llm import langid, mixing, neardup, packing, toxicity
from babelyard.llm.tables import materialise, read_table

#: How the domains' shares of all tokens are to change.
TILTS = {"good": 1.0, "poor": 0.7, "toxic": 0.5}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.reject_unknown(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_first(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixer, _ = mixing.fit(docs, read_table(spark, sf_dir, "labels"), tilts=TILTS)
    return mixer.repeat_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_domains),
    ("packing", pack),
]

#: Lexicon, segmentation and tokenizer stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
