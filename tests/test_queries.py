"""Each query against DuckDB on the smallest tables; the slowest fixpoints only as samples (the driver runs them all)."""

import pytest

from markflow import plans
from tests.conftest import SF, duck_rows, rows_of

SLOW = {"h25_trimmed", "h14_dominator_tree", "h20_h19_live_variables", "h18_null_states", "t10_a12_program_findings", "h22_topological_levels", "h21_components", "t24_confirmed", "p25_meta_annotations", "h15_natural_loops", "h6_include_own", "p26_type_filter"}


@pytest.mark.parametrize("name", sorted(set(plans.SQL) - SLOW))
def test_equals_sql(spark, name):
    df = plans.QUERIES[name](spark, SF)
    names, want = duck_rows(plans.SQL[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == want


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_reach_the_scan(spark):
    plan = plans.QUERIES["p1_find"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(p_brand), EqualTo(p_brand,Brand#7)]" in plan and "ReadSchema: struct<p_partkey:bigint,p_brand:string>" in plan
