"""Physical-plan checks: no Python UDF in batch plans, no cross joins in the
mapping layers, pushdown reaches the scan."""
import pytest

from eventlens.plans import REGISTRY
from paths import SF001

BATCH = ["agg01_event_heatmap", "mkt01_asof_price", "txt05_relevance_score", "map02_extract_mentions",
         "map04_expand_graph", "map06_expand_similar", "alr01_match_alerts", "fea06_label_breakout",
         "prd12_chrono_split"]


def plan_of(spark, name):
    df = REGISTRY[name].fn(spark, SF001)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_python_udf_no_cartesian(spark, name):
    p = plan_of(spark, name)
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "CartesianProduct" not in p
    if name in ("map06_expand_similar", "alr01_match_alerts", "map02_extract_mentions"):
        assert "BroadcastNestedLoopJoin" not in p


def test_filter_pushed_to_scan(spark):
    p = plan_of(spark, "flt09_due_predictions")
    assert "ReadSchema" in p
