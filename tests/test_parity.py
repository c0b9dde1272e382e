"""Every registered query against its SQL twin, and what its plan must not contain."""

import pytest

from scriptoria.plans.registry import registered
from tests.conftest import SF_DIR
from tests.parity import connect, difference

QUERIES = registered()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, con, name):
    assert difference(spark, con, QUERIES[name], SF_DIR) is None


@pytest.mark.parametrize("name", ["search_two_terms_per_work", "chapter_for_division", "resolve_division_paths", "notes_of_passages", "equivalent_work_groups"])
def test_no_pairing_without_keys(spark, name):
    plan = QUERIES[name].build(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan


def test_scan_reads_only_what_it_needs(spark):
    plan = QUERIES["works_per_language"].build(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<lang:string,source:string>" in plan
