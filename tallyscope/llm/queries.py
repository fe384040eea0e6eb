"""The registered queries of the training-data operators and their oracle SQL.

Every query reads its whole table; none limits, samples or filters it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontam, divergence, langid, licenses, linedup, lm_score, mixing, neardup, quality, resample, secret_scan,
               toxicity, warc)
from .oracle import DIVERGENCE_SQL, LINE_DEDUP_SQL, RESAMPLE_SQL, SECRET_SCAN_SQL, WARC_SQL, mixing_sql


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    df = mixing.mix(_read(spark, sf, "documents"))
    return df.withColumn("ratio", F.round("ratio", 6)).withColumn("probability", F.round("probability", 6))


def op2_warc_bundles(spark: SparkSession, sf: str) -> DataFrame:
    back = warc.read_archives(*warc.write_archives(_read(spark, sf, "pages")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_prob_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf, "documents")).select("doc_id", "class_id", "representative")


def op4_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = decontam.leaks(_read(spark, sf, "documents"), _read(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


def op5_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return linedup.line_dedup(_read(spark, sf, "documents")).select(
        "row.doc_id", "n_lines", "n_removed", F.md5(F.col("new_text").cast("binary")).alias("text_md5"))


def op6_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.secret_digest(secret_scan.secret_scan(_read(spark, sf, "documents")))


def op7_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = licenses.license_scan(_read(spark, sf, "documents"))
    return found.select("doc_id", F.size("found").cast("bigint").alias("n_found"), F.array_join(F.transform(
        "found", lambda m: F.concat_ws(":", m["license"], F.round(m["coverage"], 4).cast("string"),
                                       m["first"].cast("string"), m["past"].cast("string"))), ",").alias("licenses"))


def op8_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality.quality_rules(_read(spark, sf, "documents"), _read(spark, sf, "labels"))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", F.round("score", 6).alias("score"))


def op9_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    return lm_score.lm_score(_read(spark, sf, "documents"))


def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf, "documents"), _read(spark, sf, "labels")).select(
        "doc_id", "held_out", "score", "predicted", "evidence")


def op11_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify(_read(spark, sf, "documents"))


def op12_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(_read(spark, sf, "documents"))


def op13_target_resampling(spark: SparkSession, sf: str) -> DataFrame:
    drawn = resample.resample(_read(spark, sf, "documents"), _read(spark, sf, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_source_mix, op2_warc_bundles, op3_prob_minhash, op4_decontaminate, op5_line_dedup, op6_secret_scan,
    op7_license_scan, op8_quality_rules, op9_lm_score, op10_toxicity, op11_language_id, op12_source_divergence,
    op13_target_resampling)}
SQL: dict[str, str] = {
    "op1_source_mix": mixing_sql(),
    "op2_warc_bundles": WARC_SQL,
    "op5_line_dedup": LINE_DEDUP_SQL,
    "op6_secret_scan": SECRET_SCAN_SQL,
    "op12_source_divergence": DIVERGENCE_SQL,
    "op13_target_resampling": RESAMPLE_SQL,
}
