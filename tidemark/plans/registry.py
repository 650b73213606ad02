"""Every registered query of the trace operators and its DuckDB SQL."""

from __future__ import annotations

from . import content, policies, profiles, protocols, scores

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _m in (profiles, scores, policies, content, protocols):
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL
