"""All registered queries and their SQL, by name."""

from __future__ import annotations

from . import market_queries, model_queries, quality_queries, risk_queries, source_queries

MODULES = [market_queries, risk_queries, quality_queries, model_queries, source_queries]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
