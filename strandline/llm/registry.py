"""The queries of the training-data operators and the SQL that some of them can be checked by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from strandline.llm import decontamination, html_extract, language_id, language_model, lexical_search, line_dedup, mixing, near_dedup, quality, sharding, substring_dedup, token_alignment, token_count


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontamination.query,
        "op2_near_dedup": near_dedup.query,
        "op3_mix_sources": mixing.query,
        "op4_html_extract": html_extract.query,
        "op5_line_dedup": line_dedup.query,
        "op6_rendezvous_sharding": sharding.query,
        "op7_language_model": language_model.query,
        "op8_quality_rules": quality.query,
        "op9_token_counts": token_count.query,
        "op10_substring_dedup": substring_dedup.query,
        "op11_language_id": language_id.query,
        "op12_token_alignment": token_alignment.query,
        "op13_lexical_search": lexical_search.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_near_dedup": near_dedup.ORACLE_SQL,
        "op3_mix_sources": mixing.ORACLE_SQL,
        "op5_line_dedup": line_dedup.ORACLE_SQL,
        "op10_substring_dedup": substring_dedup.ORACLE_SQL,
        "op13_lexical_search": lexical_search.ORACLE_SQL,
        "op6_rendezvous_sharding": sharding.shard_sql("documents"),
    }
