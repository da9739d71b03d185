"""Every registered query with SQL, against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as contract
from harness import registry
from harness.compare import compare, connect
from harness.fit_oracles import PROBABILITIES
from harness.oracles import ORACLES
from harness.registry import QUERIES

DATA = "/root/testdata/sf0.001"
# All columns of the whole job; document_scores compares its predictions and routing.
ROWS_ONLY = {"scored_documents"}


@pytest.fixture(scope="module")
def db():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, name):
    assert compare(spark, db, DATA, name) == ""


def test_probabilities_equal_those_of_the_fit_in_sql(spark, db):
    predictions, _ = registry._experiments(spark, DATA)
    got = {(r.experiment, r.source_id, r.true, c["class"]): c.p for r in predictions.collect() for c in r.probs}
    rows = db.execute(PROBABILITIES.replace("round(p, 1) AS p", "p")).fetchall()
    want = {(experiment, source, true, name): p for experiment, source, _, true, _, name, p in rows}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_contract(spark):
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries()) and set(ORACLES) <= set(QUERIES)
    assert contract.entry(spark).limit(1).count() == 1
