"""The registered queries against their SQL twins on the smallest sample, a few per module."""

import pytest

from oracle_check import compare, duck, sql_rows

SMALL = "/root/testdata/sf0.001"
NAMES = ["a9_read_company_facts", "b14_blackout", "c5_adx", "d7_membership_cut", "d17_monthly_snapshots", "e5_opening_range", "f4_reversal_5d", "g1_insider_cluster", "h9_parameter_grid",
         "i4_bar_news_features", "j1_discrete_quarters", "k3_iv_at_tenor", "l3_barrier_outcomes", "m15_combine_legs", "n12_lineage", "p3_protective_orders", "q5_stream_cluster_signal"]


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, catalog, name):
    con = duck(SMALL)
    df = catalog.QUERIES[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    cols, expected = sql_rows(con, catalog.SQL[name])
    assert compare(df.columns, rows, cols, expected) is None


def test_every_statement_names_a_query(catalog):
    assert set(catalog.SQL) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) >= 250


def test_no_nested_loops_in_headline_plans(spark, catalog):
    for name in ("c16_beta_residual", "d8_membership_mask", "d12_event_window_agg", "f8_sector_reversal", "g1_insider_cluster", "l3_barrier_outcomes"):
        plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_union_recent_joins_the_filings_once(spark, catalog):
    plan = catalog.QUERIES["a4_union_recent"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Union" in plan
