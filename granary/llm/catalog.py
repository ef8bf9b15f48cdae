"""Queries of this package by name, and the SQL for those that SQL can express."""

from granary.llm import ann, language, licenses, line_dedup, mixing, near_duplicates, packing, quality_classifier, quality_rules, substring_dedup

_MODULES = (packing, near_duplicates, quality_classifier, substring_dedup, language, mixing, quality_rules, licenses, line_dedup, ann)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
