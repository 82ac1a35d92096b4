"""Every query with SQL gives the same rows as DuckDB; the others give rows."""

import re
from pathlib import Path

import pytest
from oracle import compare

import __spark_entry__ as entry
from orefield.plans.registry import CORE

SF = "/root/testdata/sf0.001"
SLOW: set[str] = set()


@pytest.mark.parametrize("name", [n for n in CORE.sql if n not in SLOW])
def test_same_as_sql(spark, name):
    _, difference = compare(spark, CORE.queries, CORE.sql, name, SF)
    assert not difference


@pytest.mark.parametrize("name", [n for n in CORE.queries if n not in CORE.sql and n not in SLOW])
def test_gives_rows(spark, name):
    df = CORE.queries[name](spark, SF)
    assert df.count() > 0


def test_division_same_as_sql(spark):
    rows, difference = compare(spark, CORE.queries, CORE.sql, "girvan_newman", SF.replace("0.001", "0.01"))  # the smallest graph has no edges
    assert rows and not difference


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_only_the_entry_names_the_optional_subpackage():
    root = Path(entry.__file__).parent / "orefield"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"^\s*(?:from|import)\s+\S*\bllm\b", path.read_text(), re.M), path
