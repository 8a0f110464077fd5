"""Registered queries against DuckDB; PLINTH_ALL=1 runs every one of them."""

import os

import pytest

import __spark_entry__ as entry
from tools.compare import compare, oracle_connection

SF = os.environ.get("PLINTH_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = [
    "agg_02_group_stats", "agg_13_contribution", "agg_15_group_comparison", "arc_01_archive_clean", "cln_03_explode_parallel_arrays",
    "eco_01_real_terms_by_region", "jn_03_nearest_asof_20_days", "jn_15_path_rules", "lst_04_dedupe_keep_first", "plc_01_canonical_region",
    "pnl_08_regularise", "prf_01_column_profile", "prf_04_period_parse", "qa_02_cross_source_duplicates", "set_06_merge_events",
    "snk_02_observation_log", "src_04_json_columns", "str_05_daily_windows_stream", "top_08_top_per_group", "trn_01_translate_categories",
    "ts_06_breakpoints", "ts_07_turning_points", "txt_03_readable_text", "txt_09_shingle_repeats", "win_03_trailing_mean",
]
NAMES = sorted(entry.queries()) if os.environ.get("PLINTH_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    status, _, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert status in ("ok", "rows")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_python_worker_and_no_nested_loop_in_plans(spark):
    for name in ("agg_02_group_stats", "jn_05_asof_backward", "txt_08_shared_openings", "ts_06_breakpoints"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
