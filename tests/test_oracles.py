"""Every registered query against its DuckDB oracle (smallest scale)."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from _oracle import compare, duck

SF = "/root/testdata/sf0.001"
_CON = {}


def _con():
    if "c" not in _CON:
        _CON["c"] = duck(SF)
    return _CON["c"]


# The corpus queries have their own tests in tests/llm.
@pytest.mark.parametrize("name", sorted(E.library_queries()))
def test_query_matches_oracle(spark, name):
    ok, msg = compare(E.queries()[name](spark, SF), _con(), E.oracle_sql()[name])
    assert ok, msg


def test_every_library_query_has_an_oracle():
    assert set(E.library_queries()) <= set(E.oracle_sql())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns
