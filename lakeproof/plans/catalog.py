"""All registered queries."""

from __future__ import annotations

from lakeproof.plans import (
    compare_queries,
    function_queries,
    gate_queries,
    graph_queries,
    inventory_queries,
    lookup_queries,
    report_queries,
    source_queries,
    stream_queries,
    text_queries,
)
from lakeproof.plans.registry import QueryFn

_MODULES = [
    compare_queries,
    graph_queries,
    inventory_queries,
    gate_queries,
    lookup_queries,
    report_queries,
    source_queries,
    stream_queries,
    text_queries,
    function_queries,
]


def queries() -> dict[str, QueryFn]:
    return {key: fn for module in _MODULES for key, fn in module.REG.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {key: sql for module in _MODULES for key, sql in module.REG.oracles.items()}
