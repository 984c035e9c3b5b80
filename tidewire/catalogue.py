"""Every registered query with its SQL."""

from __future__ import annotations

from .plans import answers, assembly, impact, knowledge, matching, reconciling, records, reporting  # noqa: F401 - importing registers their queries

QUERIES: dict = reporting.QUERIES
ORACLE_SQL: dict[str, str] = reporting.ORACLE_SQL
FLAGSHIP = "feed_recent"
