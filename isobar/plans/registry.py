"""Queries by name, and SQL that gives the same rows."""

from __future__ import annotations

from . import grid_queries, temporal_queries

QUERIES = {**temporal_queries.QUERIES, **grid_queries.QUERIES}
SQL = {**temporal_queries.SQL, **grid_queries.SQL}
