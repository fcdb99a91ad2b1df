"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from paperloom.llm import exact_dedup, language_id, license_scan, merkle, mixing, packing, personal_data, quality_classifier, quality_rules, secret_scan, simhash_dedup, suffix_dedup, token_alignment

MODULES = (mixing, license_scan, quality_rules, quality_classifier, personal_data, language_id, simhash_dedup, packing, exact_dedup, secret_scan, merkle, token_alignment, suffix_dedup)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
