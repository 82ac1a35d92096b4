import pytest
from oracle import compare

from orefield.llm.queries import LLM

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(LLM.sql))
def test_same_as_sql(spark, name):
    _, difference = compare(spark, LLM.queries, LLM.sql, name, SF)
    assert not difference


@pytest.mark.parametrize("name", [n for n in LLM.queries if n not in LLM.sql])
def test_runs(spark, name):
    df = LLM.queries[name](spark, SF)
    assert len(df.columns) > 0
    df.count()
