"""Each query of the subpackage against its SQL twin; the others must give one row for each document."""

from dataclasses import dataclass

import pytest

from scriptoria.llm.queries import QUERIES, SQL
from tests.conftest import SF_DIR
from tests.parity import connect, difference


@dataclass
class Case:
    name: str
    build: object
    sql: str | None


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert difference(spark, con, Case(name, QUERIES[name], SQL[name]), SF_DIR) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_one_row_for_each_document(spark, name):
    ids = [r.doc_id for r in QUERIES[name](spark, SF_DIR).select("doc_id").collect()]
    assert sorted(ids) == sorted(r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect())


def test_thirteen_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op1_url_filter", "op6_sharding", "op12_document_fingerprints"])
def test_native_plans_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoopJoin"))
