import pytest

from barflow.plans import registry

from .oracle_check import compare, duck

# One or two per domain; ``python -m tests.oracle_check`` runs them all.
KEYS = (
    "universe_top1", "adx_14", "clean_bars", "html_clean", "asof_backward", "order_flow_score", "cluster_levels", "pattern_score", "rule_anomaly", "regime_persistence", "max_pain",
    "flow_rolling", "sentiment_window", "macro_score", "fundamental_grade", "stabilise", "position_size", "barrier_outcome", "attribution", "equity_curve", "information_value", "psi", "stream_bars",
)


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_sql(spark, con, sf_dir, key):
    status, _ = compare(spark, con, sf_dir, registry.queries()[key], registry.oracles()[key])
    assert status.startswith("ok"), status


def test_registry_is_whole():
    q, o = registry.queries(), registry.oracles()
    assert set(o) <= set(q) and len(q) > 250 and len(o) > 240


@pytest.mark.parametrize("key", ["asof_backward", "sentiment_window", "barrier_outcome", "max_pain", "stabilise", "attribution", "peer_signal", "semi_keywords"])
def test_no_nested_loops(spark, sf_dir, key):
    plan = registry.queries()[key](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = registry.queries()["bars"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "lineitem" in line)
    assert "l_returnflag" not in scan and "l_extendedprice" not in scan
