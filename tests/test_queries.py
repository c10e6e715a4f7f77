"""Every registered query against its checking SQL, and its plan against the scale rules."""

import os
import re

import pytest

import __spark_entry__ as entry
import oracle
from folioworks.plans import catalog

SF = os.environ.get("FOLIOWORKS_TEST_SF", "/root/testdata/sf0.001")
QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, name):
    ok, note, _, _ = oracle.compare(spark, con, SF, QUERIES[name], ORACLES.get(name))
    assert ok, note


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize(
    "name",
    ["vector_topk", "routed_topk", "build_context", "eval_summary", "image_fallback", "ocr_sections", "select_contexts"],
)
def test_plan_has_no_cross_join(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)


@pytest.mark.parametrize("name", ["chunk_overlap", "dedupe_sentences", "clean_records", "tokens", "answer_clean"])
def test_document_rules_need_no_exchange(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"Exchange (\w+)", plan)) <= {"RoundRobinPartitioning"}  # spreads the small test table


def test_one_exchange_per_section_table(spark):
    plan = QUERIES["ocr_sections"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange hashpartitioning", plan)) == 1


def test_topk_is_limited_before_the_exchange(spark):
    plan = QUERIES["select_contexts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_scans_read_only_what_they_need(spark):
    plan = QUERIES["batch_status"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_type:string,value:double>" in plan


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["question_id", "context"]
    assert df.count() > 0
