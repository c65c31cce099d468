"""The registered queries of the core, and their SQL."""

from __future__ import annotations

from glossmill.plans import ingest, quality, reference_checks, retrieval

_MODULES = [reference_checks, ingest, retrieval, quality]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
