"""Every query with SQL must give the same rows as DuckDB; the others must run and give rows."""

import pytest
from compare import compare, integer_widths, oracle_connection

import __spark_entry__ as contract
from hourloom import queries as registry

SF = "/root/testdata/sf0.01"
registry.load()
RUNS, CHECKS = registry.RUNNERS, registry.SQL
LINEAR = {"fit_linear", "fit_forest", "best_model", "residual_table", "residual_histogram", "residual_qq", "predicted_vs_actual"}
SLOW = {"results_table", "horizon_metrics", "horizon_comparison", "horizon_tests", "ablation", "importance_topk",
        "fit_boosting"}  # fmt: skip  # minutes each; covered at small size in test_evaluation_models


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(RUNS) and set(RUNS) <= set(contract.queries())
    assert set(RUNS) - set(CHECKS) == SLOW | LINEAR


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, SF, RUNS[name], CHECKS[name], con) is None
    assert integer_widths(spark, SF, RUNS[name], CHECKS[name], con) == []


@pytest.mark.parametrize("name", sorted(LINEAR))
def test_query_gives_rows(spark, name):
    assert RUNS[name](spark, SF).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() == 5
