"""Named queries over the tables of a data folder."""

from __future__ import annotations

from lectern.plans.registry import ORACLES, QUERIES


def all_queries():
    from lectern.plans import analysis, audits, basics, decided, extras, models  # noqa: F401

    return dict(QUERIES)


def all_oracles():
    all_queries()
    return dict(ORACLES)
