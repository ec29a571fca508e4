"""The query catalogue: every query with its DuckDB oracle."""

from __future__ import annotations

from cairn.plans import code, graphs, memory, repository, retrieval

_ALL = (retrieval, graphs, memory, code, repository)
QUERIES: dict = {name: f for m in _ALL for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in _ALL for name, sql in m.ORACLES.items()}
