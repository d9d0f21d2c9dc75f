"""Registered queries: each applies operators to the views of fixtures.py and, where SQL can say it, names its SQL."""

from __future__ import annotations


def all_queries() -> tuple[dict, dict]:
    """All registered queries and their SQL."""
    from editlake.plans import aggregates, pairs, registry, relational, sequences, splits, statistics  # noqa: F401

    return dict(registry.QUERIES), dict(registry.ORACLE_SQL)
