"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import bpe, decontaminate, divergence, hard_negatives, html_extract, language_id, line_dedup, packing, quality_classifier, quality_rules, sharding, simhash, substring_dedup

MODULES = [line_dedup, simhash, packing, sharding, quality_rules, substring_dedup, decontaminate, html_extract, language_id, quality_classifier, hard_negatives, divergence, bpe]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in MODULES for k, q in getattr(m, "ORACLES", {}).items()}
