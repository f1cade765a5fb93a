"""All queries outside the llm subpackage."""

from __future__ import annotations

from leafwork.plans import compaction, reference, service

MODULES = (compaction, reference, service)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
