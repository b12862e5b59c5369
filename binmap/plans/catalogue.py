"""All queries and their SQL."""

from __future__ import annotations

from binmap.plans import queries, scans, tables  # noqa: F401  each registers its queries

QUERIES, SQL = queries.QUERIES, queries.SQL
