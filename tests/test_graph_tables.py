"""The graph's edges and what queries build on are written once: no plan holds all that led to it."""

import pytest

from wayweft.plans import queries, registry

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_edges_are_a_written_table(spark):
    assert exchanges(queries._edges(spark, SF)) == 0


@pytest.mark.parametrize("name, most", [("stands_apart", 1), ("render_connections", 1), ("drawable_edges", 5), ("feature_details", 5), ("chunk_exits", 9)])
def test_queries_on_edges_have_small_plans(spark, name, most):
    assert exchanges(registry.QUERIES[name](spark, SF)) <= most
