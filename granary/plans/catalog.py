"""All queries over the driver's tables, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from granary.plans import knowledge, retrieval

QUERIES = retrieval.QUERIES | knowledge.QUERIES
SQL = retrieval.SQL | knowledge.SQL
FLAGSHIP = retrieval.multipath_rrf
