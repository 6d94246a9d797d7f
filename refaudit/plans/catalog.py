"""All named queries and their SQL twins."""

from __future__ import annotations

from . import branches, layout, queries, sql

QUERIES = queries.QUERIES | layout.QUERIES | branches.QUERIES
SQL = sql.SQL | layout.SQL | branches.SQL
