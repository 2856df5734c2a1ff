"""All registered queries with their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from tessera.plans import queries_relational, queries_statistics, queries_text

_PARTS = (queries_text, queries_relational, queries_statistics)

QUERIES: dict = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLES: dict = {k: v for part in _PARTS for k, v in part.ORACLES.items()}
