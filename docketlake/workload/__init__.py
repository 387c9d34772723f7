"""The registered queries: every operator on the given tables, with its SQL counterpart."""

from __future__ import annotations

from docketlake.workload import extraction, ingestion, listings, relational, search, segments, stored

FLAGSHIP = "hybrid_rrf"
_MODULES = (search, relational, listings, segments, ingestion, extraction, stored)


def queries() -> dict:
    return {name: run for module in _MODULES for name, run in module.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
