import re

import pytest

from steleworks.plans.registry import ORACLES, QUERIES

from .compare import oracle, rows

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(oracle(ORACLES[name], SMALL))


def test_every_query_has_sql():
    assert not set(QUERIES) - set(ORACLES)


@pytest.mark.parametrize("name", ["clean_corpus", "text_windows", "page_text", "topk_softmax", "otsu_threshold", "strip_punct"])
def test_native_plans(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    # Nodes and functions, as texts in a plan may hold such words.
    assert not re.search("EvalPython|InArrow|InPandas|PythonUDF|Python(UDTF|Map)", plan)


def test_scan_is_pruned(spark):
    plan = QUERIES["file_semi"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan and "PushedFilters: [IsNotNull(quality), EqualTo(quality,1)" in plan
