"""The queries of this subpackage: thin callers of its operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from babelyard.llm import langid, licenses, mixing, neardup, oracles, packing, periods, quality, repeats, sharding, topk, toxicity, tries, urls
from babelyard.llm.tables import read_table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(read_table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "stratum", F.array_join("failed_rules", ",").alias("failed_rules"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.jaccard_classes(read_table(spark, sf_dir, "documents")).drop("content")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty shards, and where the map's next version, for one shard more, has each row."""
    placed = sharding.shard_documents(read_table(spark, sf_dir, "documents"), n_shards=40, next_shards=41)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "next_shard",
    )


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(read_table(spark, sf_dir, "embeddings"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(read_table(spark, sf_dir, "documents"), digest=True)
    return cut.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def _wound(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth id, by its CRC-32, goes round in a circle of its own words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g = F.floor(h / 10)

    def turned(own: Column) -> Column:
        n = F.size(own)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(own, lambda w, i: F.when(i < a, w).otherwise(F.get(own, (a + (i - a) % p).cast("int")))), " ")

    wound = F.get(F.transform(F.array(words), lambda own: F.when(F.size(own) > 0, turned(own)).otherwise(F.lit(""))), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, wound).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(_wound(read_table(spark, sf_dir, "documents")))
    # the greatest length, then the least start, then the least period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(listed, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tries.encode_turns(read_table(spark, sf_dir, "conversations"))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    return tries.prefix_trie(tries.share_starts(own, 100, taken, 5))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_quality_rules, op3_packing, op4_jaccard_join, op5_toxicity, op6_language_id, op7_mixing,
        op8_sharding, op9_license_scans, op10_exact_topk, op11_substring_dedup, op12_periodic_runs, op13_prefix_trie,
    )
}

ORACLE_SQL = oracles.SQL
