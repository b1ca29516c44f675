"""The ten corpus queries and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import language_id, line_dedup, media, mixing, near_dup, packing, quality_crf, quality_rules, token_counts, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dup": near_dup.op1_near_dup,
        "op2_language_id": language_id.op2_language_id,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_packing": packing.op4_packing,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_mixing": mixing.op6_mixing,
        "op7_quality_crf": quality_crf.op7_quality_crf,
        "op8_media": media.op8_media,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_token_counts": token_counts.op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filter": url_filter.OP3_SQL,
        "op5_line_dedup": line_dedup.OP5_SQL,
    }
