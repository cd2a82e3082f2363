"""Every query of the point-cloud and trajectory operators against its SQL twin."""

import pytest

from driftline.plans import catalog
from tests.sql_compare import compare


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    compare(spark, sf_dir, catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", ["join_knn_radius", "join_radius", "join_box_range", "join_box_anti", "dml_delete_points", "join_spline_segment"])
def test_no_nested_loops(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    if name == "join_knn_radius":
        assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("name", ["str_filter_lo", "str_filter_lio"])
def test_events_do_not_go_to_the_driver(spark, sf_dir, name):
    """Neither the events nor their places times 27 cells are broadcast, however small the tables look."""
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
