"""All core queries and their SQL by name."""

from __future__ import annotations

from tallyfold.plans import arithmetic, evidence, grid, quality, reading, streams

FLAGSHIP = "sum_report"
MODULES = (arithmetic, grid, reading, evidence, streams, quality)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
