"""Registered queries: each pairs a Spark plan over the driver tables with the SQL it must agree with."""

from __future__ import annotations

import importlib

MODULES = ("corpus", "lexical", "retrieval", "policy", "routing", "title_routing", "answer_job", "live")


def all_queries():
    from gleaner.plans.registry import ORACLES, QUERIES

    for module in MODULES:
        importlib.import_module(f"gleaner.plans.{module}")
    return dict(QUERIES), dict(ORACLES)
