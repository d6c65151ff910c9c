"""The operators over the whole documents table, as registered queries."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import (
    chosen_path, collocations, decontam, line_dedup, packing, quality_bayes, quality_rules,
    secret_scan, sharding, simhash, spelling, suffix_dedup, token_count,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that another document holds too."""
    return suffix_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit("")).cast("binary")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(text, 256).alias("kept_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_count.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in ranges of ``doc_id``; each range meets the ledger of those before."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    batches = line_dedup.id_batches(docs, "doc_id", 2)
    found = secret_scan.scan_secrets(docs, secret_scan.BlobLedger(spark), batches=batches)
    counts = [
        F.expr(f"cast(size(filter(findings, f -> f.kind = '{k}')) AS bigint) AS n_{k}")
        for k in ("assign", "access", "hex")
    ]
    spans = secret_scan.spans_text(F.col("findings"))
    return found.select(
        "doc_id", *counts, F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans")
    )


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with numbers, names and units free to differ."""
    leaks = decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "n_windows", "n_matched", "n_slots", "n_changed")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rules = quality_rules.learn(docs, _table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(docs, rules, keep=["doc_id"])
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "rule")


def op8_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    placed = sharding.shard_rows(_table(spark, sf_dir, "documents"), keep={"text_crc32": crc})
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are sources, paths the languages within them."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality_bayes.classify(docs, labels, F.col("source"), F.col("lang"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_line_dedup, op3_token_counts, op4_best_fit_packing, op5_secret_scan,
        op6_benchmark_decontamination, op7_quality_rules, op8_histogram_sharding,
        op9_quality_classifier, op10_simhash_near_dedup, op11_minhash_near_dedup,
        op12_spelling_variants, op13_collocations,
    )
}
