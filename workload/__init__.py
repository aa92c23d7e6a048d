"""Registered queries over the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from . import catalog


def all_queries():
    from . import q_detect, q_entities, q_explore, q_judge, q_machine, q_scalar, q_sources, q_symbolic, q_traces  # noqa: F401

    return catalog.QUERIES


def all_sql():
    all_queries()
    return catalog.SQL
