"""The named queries. Importing a module registers its queries."""

from __future__ import annotations


def _load():
    from affinis.queries import registry, scans, similarity, texts  # noqa: F401
    from affinis.queries import encoders, lookups, maps, pages  # noqa: F401

    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
