"""Registry of the relational, document, retrieval and planning queries."""

from __future__ import annotations

from lectern.plans import content, endpoints, relational, scalars, streams, texts

_PARTS = (relational, content, endpoints, scalars, streams, texts)
QUERIES: dict = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for p in _PARTS for k, s in p.ORACLE_SQL.items()}
