"""Translation of message tables in batches, by a provider."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from babelyard.functions.tokens import detokenize, tokenize, variables
from babelyard.operators.ranks import numbered
from babelyard.operators.sync import deep_merge
from babelyard.sources.scratch import written

BATCH = 100


class Provider(Protocol):
    """Translates a batch of texts; the answer has the same order, with null for what failed. It is sent to
    the tasks, so it must be picklable."""

    def translate_batch(self, texts: list[str], target: str, source: str) -> list[str | None]: ...


class MockProvider:
    """Marks every text with its target language."""

    def translate_batch(self, texts: list[str], target: str, source: str) -> list[str | None]:
        return [f"[TEST_{target.upper()}] {t}" for t in texts]


def mock_translation(text: Column, target: Column) -> Column:
    return F.concat(F.lit("[TEST_"), F.upper(target), F.lit("] "), text)


def chunk_numbers(rows: DataFrame, group: str, *order: str, size: int = BATCH) -> DataFrame:
    """Adds chunk: numbers of batches of `size` rows in order within a group, however large it is. Give only the
    columns that are needed: the rows are dealt in order and written once."""
    return numbered(rows, [group], list(order)).withColumn("chunk", F.floor((F.col("n") - 1) / size).cast("int")).drop("n")


def by_position(source: Column, answer: Column) -> Column:
    """The answer's items in the source's order; the source's item where the answer has none."""
    return F.transform(source, lambda x, k: F.coalesce(F.get(answer, k), x))


def flatten_messages(messages: DataFrame) -> DataFrame:
    """Messages that hold a text; other leaves are not translated."""
    return messages.where("value is not null")


def translate_texts(texts: DataFrame, provider: Provider, source: str) -> DataFrame:
    """target, text, translated, error. texts: target, text (distinct). Each task calls the provider with up to BATCH
    texts of one language; a batch that fails has its error in place of answers, and others go on."""
    schema = "target string, text string, translated string, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for target, own in frame.groupby("target", sort=True):
                for at in range(0, len(own), BATCH):
                    some = own["text"].iloc[at : at + BATCH].tolist()
                    error = None
                    try:
                        answers = provider.translate_batch(some, target, source)
                    except Exception as e:  # noqa: BLE001 - a provider's failure must not end the other languages' work
                        answers, error = [], f"{type(e).__name__}: {e}"
                    answers = list(answers[: len(some)]) + [None] * (len(some) - len(answers))
                    yield pd.DataFrame({"target": target, "text": some, "translated": answers, "error": error})

    return texts.mapInPandas(run, schema)


class TranslationMemory:
    """Answers of providers, by source language, target language and the text's hash: written once, read ever after.

    Each run adds a folder of its own with what it was answered; a folder counts when its write has ended, and none is changed. Of two
    answers to one question (two runs at once) the least is read, so that every reading gives the same.
    """

    SCHEMA = "source string, target string, hash string, translated string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _runs(self) -> list[str]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        system = folder.getFileSystem(conf)
        if not system.exists(folder):
            return []
        runs = [str(s.getPath()) for s in system.listStatus(folder)]
        return sorted(r for r in runs if system.exists(jvm.org.apache.hadoop.fs.Path(f"{r}/_SUCCESS")))

    def answers(self, source: str) -> DataFrame:
        """target, hash, translated."""
        runs = self._runs()
        rows = self.spark.read.schema(self.SCHEMA).parquet(*runs) if runs else self.spark.createDataFrame([], self.SCHEMA)
        return rows.where(F.col("source") == source).groupBy("target", "hash").agg(F.min("translated").alias("translated"))

    def ask(self, texts: DataFrame, provider: Provider, source: str) -> DataFrame:
        """target, text, translated, error of texts (target, text): known answers, and the provider's to the rest, which are kept
        before they are returned. Errors and missing answers aren't kept, so the next run asks again."""
        own = texts.withColumn("hash", F.sha2("text", 256))
        known = own.join(self.answers(source), ["target", "hash"], "left")
        new = written(translate_texts(known.where("translated is null").select("target", "text"), provider, source), "answers")
        kept = new.where("translated is not null and error is null").select(F.lit(source).alias("source"), "target", F.sha2("text", 256).alias("hash"), "translated")
        if not kept.isEmpty():
            kept.write.parquet(f"{self.path}/run-{uuid.uuid4().hex}")
        held = self.answers(source)
        failed = new.where("translated is null or error is not null").select("target", F.sha2("text", 256).alias("hash"), "error")
        return own.join(held, ["target", "hash"], "left").join(failed, ["target", "hash"], "left").select("target", "text", "translated", F.when(F.col("translated").isNull(), F.col("error")).alias("error"))


def translate_messages(messages: DataFrame, targets: list[str], source: str, provider: Provider, memory: TranslationMemory | None = None) -> DataFrame:
    """locale, key, value, error for every target: variables become tags, equal texts are asked for once, answers get
    their variables back, and a text without an answer stays as it is. Where the provider failed, value is null. With
    a memory the provider is asked for texts only that it has no answer to."""
    own = flatten_messages(messages.where(F.col("locale") == source)).select("key", "value")
    own = own.withColumn("text", tokenize(F.col("value"))).withColumn("vars", variables(F.col("value")))
    wanted = F.array(*(F.lit(t) for t in targets if t != source)) if any(t != source for t in targets) else F.array().cast("array<string>")
    spread = own.withColumn("target", F.explode(wanted))
    asked = spread.select("target", "text").distinct()
    found = memory.ask(asked, provider, source) if memory else translate_texts(asked, provider, source)
    answers = found.withColumnsRenamed({"target": "a_target", "text": "a_text"})
    joined = spread.join(answers, (F.col("target") == F.col("a_target")) & (F.col("text") == F.col("a_text")), "left")
    value = detokenize(F.coalesce("translated", "text"), F.col("vars"))
    return joined.select(F.col("target").alias("locale"), "key", F.when(F.col("error").isNull(), value).alias("value"), "error")


def failed_languages(translated: DataFrame) -> DataFrame:
    """locale, n_failed, error (the first by name) of translate_messages' rows, to be reported; write those rows down
    first, since the provider is asked again for each reading of a plan."""
    own = translated.where("error is not null").groupBy("locale")
    return own.agg(F.count("*").alias("n_failed"), F.min("error").alias("error"))


def kept_where_failed(translated: DataFrame, held: DataFrame) -> DataFrame:
    """locale, key, value: translations, or what a locale holds already where its provider failed; nothing without either."""
    old = held.select(F.col("locale").alias("h_locale"), F.col("key").alias("h_key"), F.col("value").alias("h_value"))
    joined = translated.join(old, (F.col("locale") == F.col("h_locale")) & (F.col("key") == F.col("h_key")), "left")
    value = F.when(F.col("error").isNull(), F.col("value")).otherwise(F.col("h_value"))
    return joined.select("locale", "key", value.alias("value")).where("value is not null")


def payload(messages: DataFrame, source: str, keys: DataFrame) -> DataFrame:
    """The source locale's messages for the given keys. A key that is not there is a path into nested messages (a.b.c
    is b.c of the message a), and otherwise stands for itself."""
    own = messages.where(F.col("locale") == source).select("key", "value")
    outer = own.where(F.ltrim("value").startswith("{")).select(F.col("key").alias("outer_key"), F.col("value").alias("nested"))
    parts = F.split("key", r"\.")
    wanted = keys.select("key").distinct().join(own, "key", "left").withColumn("head", F.when(F.col("value").isNull() & (F.size(parts) > 1), parts[0]))
    # names with quotes aren't paths
    path = F.concat(F.lit("$"), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.lit("['"), p, F.lit("']"))), ""))
    found = wanted.join(outer, F.col("head") == F.col("outer_key"), "left")
    return found.select(F.lit(source).alias("locale"), "key", F.coalesce("value", F.call_function("get_json_object", F.col("nested"), path), "key").alias("value"))


def run_translations(messages: DataFrame, targets: list[str], source: str, provider: Provider, delta_keys: DataFrame | None = None, memory: TranslationMemory | None = None) -> DataFrame:
    """messages with new target locales: a full run replaces them, a delta run lays its answers over them. Where a
    provider failed, a locale keeps what it holds."""
    targets = [t for t in dict.fromkeys(targets) if t != source]
    before = messages.where(F.col("locale").isin(targets))
    if delta_keys is None:
        new = kept_where_failed(translate_messages(messages, targets, source, provider, memory), before)
        return messages.where(~F.col("locale").isin(targets)).select("locale", "key", "value").unionByName(new)
    new = kept_where_failed(translate_messages(payload(messages, source, delta_keys), targets, source, provider, memory), before)
    return messages.where(~F.col("locale").isin(targets)).select("locale", "key", "value").unionByName(deep_merge(before.select("locale", "key", "value"), new))
