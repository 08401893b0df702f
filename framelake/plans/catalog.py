"""Where query modules register their queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import AUDIT_SQL, FILES_SQL, FRAMES_SQL, QUERIES_SQL, SEGMENTS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_TABLES = {"frames": FRAMES_SQL, "media_files": FILES_SQL, "audit_logs": AUDIT_SQL, "segments": SEGMENTS_SQL, "queries": QUERIES_SQL}
_NEEDS = {"segments": ("frames",), "queries": ("frames",)}


def query(name: str, sql: str | None = None, uses: str = "") -> Callable[[Query], Query]:
    """Register a query; uses names the derived tables that its SQL reads."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            tables = list(dict.fromkeys(t for u in uses.split() for t in (*_NEEDS.get(u, ()), u)))
            parts = [_TABLES[t] for t in tables]
            body = sql.strip()
            if body.upper().startswith("WITH RECURSIVE "):
                SQL[name] = f"WITH RECURSIVE {', '.join([*parts, body[15:]])}"
            elif body.upper().startswith("WITH "):
                SQL[name] = f"WITH {', '.join([*parts, body[5:]])}"
            else:
                SQL[name] = (f"WITH {', '.join(parts)} " if parts else "") + body
        return f

    return register
