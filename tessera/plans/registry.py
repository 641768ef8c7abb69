"""Every registered query of the retrieval and analytics operators, with its SQL."""

from __future__ import annotations

from . import document_queries, provider_queries, retrieval_queries

_MODULES = (retrieval_queries, document_queries, provider_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
