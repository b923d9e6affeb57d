"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from tidemark.llm import bpe, class_lm, doc_fingerprints, license_scan, line_dedup, mixing, quality_classifier, quality_rules, simhash, url_filter

MODULES = (bpe, line_dedup, quality_rules, license_scan, mixing, quality_classifier, class_lm, url_filter, simhash, doc_fingerprints)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
