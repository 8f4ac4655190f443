"""The driver's contract without the optional parts."""

from __future__ import annotations

import importlib.util

import pytest

import __spark_entry__ as entry
from lakeproof.plans import catalog


@pytest.mark.parametrize("gone", [{"lakeproof.llm"}, {"corpus_pipeline"}, {"lakeproof.llm", "corpus_pipeline"}])
def test_missing_parts_take_only_their_own_queries(monkeypatch, gone):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in gone else real(name, *a))
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(catalog.queries()) <= set(queries) and set(catalog.oracle_sql()) <= set(oracles)
    assert "pipeline" not in queries
    if "lakeproof.llm" in gone:
        assert set(queries) == set(catalog.queries()) and set(oracles) == set(catalog.oracle_sql())
