"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixmill.llm import decontaminate, html_extract, license_scan, minhash_dedup, packing, pii, quality_classifier, quality_rules, source_divergence, suffix_dedup, token_counts, url_filter
from helixmill.llm.common import table
from helixmill.llm.oracles import ORACLES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": lambda s, d: suffix_dedup.repeats_report(table(s, d, "documents")),
        "op2_quality_classifier": lambda s, d: quality_classifier.classifier_report(table(s, d, "documents"), table(s, d, "labels")),
        "op3_packing": lambda s, d: packing.packing_report(table(s, d, "documents")),
        "op4_token_counts": lambda s, d: token_counts.token_report(table(s, d, "documents")),
        "op5_minhash_dedup": lambda s, d: minhash_dedup.near_report(table(s, d, "documents")),
        "op8_decontaminate": lambda s, d: decontaminate.contamination_report(table(s, d, "documents"), table(s, d, "benchmark")),
        "op6_pii": lambda s, d: pii.pii_report(table(s, d, "documents")),
        "op7_quality_rules": lambda s, d: quality_rules.quality_report(table(s, d, "documents")),
        "op9_license_scan": lambda s, d: license_scan.license_report(table(s, d, "documents")),
        "op10_url_filter": lambda s, d: url_filter.url_verdicts(table(s, d, "pages")),
        "op12_html_extract": lambda s, d: html_extract.extraction_report(table(s, d, "pages")),
        "op11_source_divergence": lambda s, d: source_divergence.divergence_report(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
