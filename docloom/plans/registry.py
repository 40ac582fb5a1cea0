"""The registered queries of the document operators, and SQL for the same rows."""

from __future__ import annotations

from docloom.plans import audit_queries, case_queries, match_queries, report_queries, sequence_queries, table_queries, text_queries

_ALL = (text_queries, table_queries, sequence_queries, match_queries, audit_queries, report_queries, case_queries)

QUERIES = {k: f for m in _ALL for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for m in _ALL for k, s in m.ORACLES.items()}
