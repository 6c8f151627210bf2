"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    filter_audit,
    hard_negatives,
    language_id,
    mpeg_audio,
    packing,
    quality_classifier,
    quality_rules,
    secret_scans,
    sentencepiece_codec,
    sharding,
    simhash_dedup,
    token_counts,
    url_filters,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": quality_classifier.op1_quality_classifier,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_secret_scans": secret_scans.op3_secret_scans,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_url_filters": url_filters.op5_url_filters,
        "op6_simhash_dedup": simhash_dedup.op6_simhash_dedup,
        "op7_sentencepiece": sentencepiece_codec.op7_sentencepiece,
        "op8_language_id": language_id.op8_language_id,
        "op9_media_columns": mpeg_audio.op9_media_columns,
        "op10_sharding": sharding.op10_sharding,
        "op11_token_counts": token_counts.op11_token_counts,
        "op12_filter_interaction_audit": filter_audit.op12_filter_interaction_audit,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_secret_scans": secret_scans.ORACLE_SQL, "op5_url_filters": url_filters.ORACLE_SQL, "op12_filter_interaction_audit": filter_audit.ORACLE_SQL, "op13_hard_negatives": hard_negatives.ORACLE_SQL}
