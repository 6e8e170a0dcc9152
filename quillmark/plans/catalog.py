"""Every registered query with the DuckDB SQL that checks it."""

from __future__ import annotations

from quillmark.plans import archive_queries, search_queries

#: ``archive_queries`` registers into the same tables.
QUERIES: dict = search_queries.QUERIES
ORACLES: dict[str, str] = search_queries.ORACLES
__all__ = ["ORACLES", "QUERIES", "archive_queries"]
