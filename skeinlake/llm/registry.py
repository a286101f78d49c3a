"""Queries of the training-data problems with their SQL, gathered from the modules of this subpackage."""

from __future__ import annotations

from . import task_queries, text_queries

_PARTS = (task_queries, text_queries)
QUERIES = {n: f for p in _PARTS for n, f in p.QUERIES.items()}
ORACLE = {n: s for p in _PARTS for n, s in p.ORACLE.items()}
