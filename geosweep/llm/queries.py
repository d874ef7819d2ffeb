"""Registered queries of the corpus operators, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from geosweep.llm import (
    decontaminate,
    importance,
    jaccard_join,
    line_dedup,
    lm_scoring,
    quality_classifier,
    quality_rules,
    secret_scan,
    sentencepiece_nbest,
    substring_dedup,
    url_filters,
    vector_codes,
    warc,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": substring_dedup.query,
        "op2_url_filters": url_filters.query,
        "op3_sentencepiece": sentencepiece_nbest.query,
        "op4_lm_scoring": lm_scoring.query,
        "op5_quality_classifier": quality_classifier.query,
        "op6_line_dedup": line_dedup.query,
        "op7_quality_rules": quality_rules.query,
        "op8_jaccard_join": jaccard_join.query,
        "op9_decontaminate": decontaminate.query,
        "op10_warc": warc.query,
        "op11_secret_scan": secret_scan.query,
        "op12_vector_codes": vector_codes.query,
        "op13_importance": importance.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring_dedup.ORACLE,
        "op2_url_filters": url_filters.ORACLE,
        "op6_line_dedup": line_dedup.ORACLE,
        "op7_quality_rules": quality_rules.ORACLE,
        "op10_warc": warc.ORACLE,
        "op12_vector_codes": vector_codes.ORACLE,
        "op13_importance": importance.ORACLE,
    }
