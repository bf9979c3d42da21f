"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from factloom.llm import ann_partitions, best_fit, divergence, license_scan, nbsvm, near_dup, passage_dedup, source_audit, source_mix, suffix_dedup, token_store, url_rules, whitening

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (nbsvm, license_scan, divergence, ann_partitions, near_dup, suffix_dedup, token_store, url_rules, best_fit, source_mix, source_audit, whitening, passage_dedup):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(getattr(_module, "ORACLES", {}))
