"""All registered queries of the engine's own operators."""

from __future__ import annotations

from . import advisory, cleaned, dialogue, facts, ingest, logs, naming, retrieval, search, solver

_MODULES = (retrieval, facts, advisory, solver, logs, ingest, dialogue, search, naming, cleaned)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
