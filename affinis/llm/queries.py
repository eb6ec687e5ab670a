"""One query per operator, over its whole table. Importing a module registers its query."""

from __future__ import annotations

from affinis.llm import query_chat, query_crosstoken, query_decontaminate, query_jaccard  # noqa: F401
from affinis.llm import query_licences, query_mixing, query_pieces, query_private, query_quality  # noqa: F401
from affinis.llm import query_repair, query_revisits, query_secrets, query_topk  # noqa: F401
from affinis.llm.registry import ORACLES, QUERIES


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLES)
