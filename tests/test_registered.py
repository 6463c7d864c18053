"""Every registered query against its SQL, and the shape of its plan."""

from __future__ import annotations

import re
import sys

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from conftest import SMALL
from lakeward.cases import load_all

# The library's own queries; those of the training-data package have tests beside it.
QUERIES = {n: q for n, q in entry.queries().items() if n in load_all()}
SQL = {n: q for n, q in entry.oracle_sql().items() if n in QUERIES}


# Results without a row on the smallest scale, and why.
EMPTY: dict[str, str] = {}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(built, con, name):
    assert compare(con, built(name), SQL[name]) == ("empty result" if name in EMPTY else None)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(built, name):
    assert built(name).count() > 0


def test_entry_gives_the_flagship_mart(spark):
    mart = entry.entry(spark)
    assert mart.count() == 5
    assert "case_volume_rank" in mart.columns


# The only places rows go through Python are the Arrow export and its reader.
PYTHON_ALLOWED = {"sink_arrow"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_all_pairs_join_and_no_python(plan_of, name):
    plan = plan_of(name)
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan
    if name not in PYTHON_ALLOWED:
        assert not re.search(r"PythonUDF|ArrowEvalPython|MapInArrow|MapInPandas|BatchEvalPython", plan)


@pytest.mark.parametrize("absent", ["lakeward.llm", "corpus_pipeline"])
def test_queries_do_without_the_training_data_package(monkeypatch, absent):
    monkeypatch.setitem(sys.modules, absent, None)  # its import fails
    names = set(entry.queries())
    assert names >= set(load_all()) and "pipeline" not in names and set(entry.oracle_sql()) <= names
