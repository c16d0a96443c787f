"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veclume.llm import jaccard, langid, packing, quality, secrets, simple8b, slots, suffix, toxicity, urlrules


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": suffix.decontamination_report,
        "op2_toxicity": toxicity.toxicity_report,
        "op3_jaccard_join": jaccard.component_report,
        "jaccard_links": jaccard.link_report,
        "op4_token_files": simple8b.token_file_report,
        "op5_language_id": langid.language_report,
        "op6_url_filters": urlrules.url_report,
        "op7_packing": packing.packing_report,
        "op8_sharding": slots.sharding_report,
        "op9_secret_scan": secrets.secret_report,
        "op10_quality_rules": quality.quality_report,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": suffix.report_sql(), "op3_jaccard_join": jaccard.report_sql(), "jaccard_links": jaccard.links_sql(), "op6_url_filters": urlrules.url_sql()}
