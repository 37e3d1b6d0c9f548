"""Every registered report against its DuckDB statement, and the driver's contract."""

from __future__ import annotations

import importlib
import sys

import __spark_entry__ as driver
import pytest
from conftest import DATA, same_as_sql
from meterbook import ingest_queries, queries  # noqa: F401 - the first registers its queries


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_statement(spark, name):
    same_as_sql(queries.QUERIES[name](spark, DATA), queries.ORACLE_SQL[name])


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_imports_without_the_corpus_operators(spark, monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("meterbook.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    fresh = importlib.import_module("__spark_entry__")
    assert fresh.queries().keys() == queries.QUERIES.keys()
    assert fresh.oracle_sql().keys() == queries.ORACLE_SQL.keys()
    sys.modules["__spark_entry__"] = driver


def test_scan_is_pruned_and_filtered(spark):
    plan = queries.QUERIES["timeseries_daily"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan" in line and "ts#" in line)
    assert "GreaterThanOrEqual(ts" in scan
    assert "user_id" not in scan.split("ReadSchema")[1]
