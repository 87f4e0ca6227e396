"""Registered queries of the subpackage: each operator over its whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raincourier.llm import archives, decontaminate, manifest, maxent_lm, mixing, packing, pu_classifier, quality_rules, resampling, secrets, substring_dedup, token_groups, url_filter
from raincourier.llm.twins import llm_sql  # noqa: F401
from raincourier.sources.scratch import scratch


def _table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_classifier(spark, folder: str) -> DataFrame:
    return pu_classifier.score_quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op2_substring_dedup(spark, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_jaccard_join(spark, folder: str) -> DataFrame:
    return token_groups.near_copies(_table(spark, folder, "documents"))


def op4_warc(spark, folder: str) -> DataFrame:
    read = archives.pages_to_warc(_table(spark, folder, "pages"), scratch(spark, "warc"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_lm_scoring(spark, folder: str) -> DataFrame:
    return maxent_lm.score_texts(_table(spark, folder, "documents"))


def op6_quality_rules(spark, folder: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op7_decontamination(spark, folder: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op8_secret_scans(spark, folder: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, folder, "documents"))
    number = lambda name: F.size(F.filter("base", lambda s: s["name"] == name)).cast("long")
    return found.select("doc_id", *[number(k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
                        secrets.joined(F.sort_array(F.concat("base", "added"))).alias("spans"))


def op9_url_filters(spark, folder: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, folder, "pages"))


def op10_mixing(spark, folder: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, folder, "documents"))[0]


def op11_resampling(spark, folder: str) -> DataFrame:
    drawn = resampling.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def op12_merkle_manifest(spark, folder: str) -> DataFrame:
    checked = manifest.verified_manifest(_table(spark, folder, "documents"))
    return checked.select("doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", "proof"), 256).alias("proof_sha256"), "folded_root", "verified")


def op13_best_fit_packing(spark, folder: str) -> DataFrame:
    pieces = packing.pack_documents(_table(spark, folder, "documents"))
    return pieces.select("doc_id", "piece", "start", "length", packing.ids_crc32().alias("ids_crc32"), "sequence_id", "offset")


def llm_queries() -> dict:
    found = [op1_quality_classifier, op2_substring_dedup, op3_jaccard_join, op4_warc, op5_lm_scoring, op6_quality_rules, op7_decontamination, op8_secret_scans, op9_url_filters, op10_mixing,
             op11_resampling, op12_merkle_manifest, op13_best_fit_packing]
    return {f.__name__: f for f in found}
