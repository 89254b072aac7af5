"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.llm import bpe_codec, decontaminate, html_extract, importance, jaccard_join, language_id, license_scan, oracles, piece_codec, pii, quality_classifier, quality_rules, substring_dedup
from facetmill.llm.common import crc_fold, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_fold(F.col("doc_id"), 4) == 2
    model = language_id.train(docs.where(~held_out))
    held_out = F.coalesce(held_out, F.lit(False))  # a row without an id is in no fold
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_fold(F.col("doc_id"), 3) == 1
    known = labels.where(~held_out).select("doc_id", F.col("quality").alias("label")).distinct()
    held_out = F.coalesce(held_out, F.lit(False))
    return quality_classifier.classify(docs, known).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = piece_codec.PieceModel.load()
    return piece_codec.codec_report(table(spark, sf_dir, "documents"), model)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = importance.resample(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.codec_report(table(spark, sf_dir, "documents"), bpe_codec.BpeModel.load())


def quality_rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op5 that SQL can express."""
    return op5_quality_rules(spark, sf_dir).drop("kept", "distance2")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op8 that SQL can express."""
    return op8_pii(spark, sf_dir).drop("spans", "n_spans", "scores")


#: Queries beside op1 to op10, and the SQL of all that have one.
PARTS = (quality_rules_base, pii_base)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {f.__name__: f for f in PARTS}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_license_scan": oracles.license_sql(),
        "op4_substring_dedup": oracles.dedup_sql(),
        "op6_ngram_jaccard": oracles.jaccard_sql(),
        "op11_importance_resampling": oracles.importance_sql(),
        "quality_rules_base": oracles.rules_base_sql(),
        "pii_base": oracles.pii_base_sql(),
    }
