import duckdb
import pytest

import __spark_entry__ as entry_module
from check import TABLES, compare

# Quick ones; check.py runs them all.
QUICK = ["cl_5_resolve_review_language", "cl_9_bug_risk_label", "sx_1_c_like_syntax",
         "sx_1b_c_like_syntax_of_pages", "fe_1_features_c_like", "fe_4_rich_c_like",
         "cj_1_nested_loop", "cj_19_missing_break", "cj_25_no_return_value",
         "cj_27_array_out_of_bounds", "py_8_overwritten_accumulators", "py_23_missing_globals",
         "s_3_risk_score", "s_7_template_lookup", "s_14_review_result", "ml_1_stratified_split",
         "ml_6_threshold_sweep", "rh_3_workspace_stats"]


def test_checks_belong_to_queries():
    queries, checks = entry_module.queries(), entry_module.oracle_sql()
    assert set(checks) <= set(queries)
    queries = {k: v for k, v in queries.items() if k not in entry_module.llm()[0]}
    assert set(queries) - set(checks) == {
        "io_9_model_package", "ml_4_tuned_forest", "ml_5_sigmoid_calibration",
        "ml_7_per_language_train", "ml_8_batch_score", "ml_11_issue_classifier",
        "ml_13_severity_classifier", "main_evaluate_model"}


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", QUICK)
def test_query_matches_its_check(spark, sf, con, key):
    fn, sql = entry_module.queries()[key], entry_module.oracle_sql()[key]
    assert compare(spark, con, key, fn, sql, sf) is None


def test_flagship(spark):
    frame = entry_module.entry(spark)
    assert frame.count() == 200 and "issues" in frame.columns
