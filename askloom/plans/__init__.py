"""Named queries over the test tables, one module per part of the engine, each with QUERIES and SQL."""

from __future__ import annotations

from askloom.plans import files, learning, packed, relational, search, text, tokens

PARTS = (packed, relational, search, text, tokens, learning, files)


def core_queries() -> dict:
    return {k: v for part in PARTS for k, v in part.QUERIES.items()}


def core_sql() -> dict[str, str]:
    return {k: v for part in PARTS for k, v in part.SQL.items()}
