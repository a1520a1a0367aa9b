"""All queries of the engine's own operators, and the SQL that another engine answers them with."""

from __future__ import annotations

from . import collection_queries, engine_queries, relational

MODULES = (relational, collection_queries, engine_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
