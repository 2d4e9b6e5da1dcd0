"""Plan shapes that must hold at any data size."""

import re

from skytrace.operators import metrics, reports
from skytrace.operators.features import engineer
from skytrace.plans import QUERIES
from skytrace.plans.views import flight, predictions

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange (?:hash|range|Single)", plan(df)))


def test_top_types_reads_two_columns_and_combines_before_the_shuffle(spark):
    text = plan(reports.top_types(flight(spark, SF_DIR)))
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in text
    assert text.index("HashAggregate") < text.rindex("partial_count") and "TakeOrderedAndProject" in text


def test_windows_and_features_shuffle_once_without_large_keys(spark):
    f = flight(spark, SF_DIR)
    assert shuffles(predictions(f)) == 1
    assert shuffles(engineer(f, "VFR_HUD")) == 1


def test_labelling_has_no_nested_loop(spark):
    text = plan(QUERIES["label_rows"].run(spark, SF_DIR))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_sweep_and_breakdown_scan_once(spark):
    f = predictions(flight(spark, SF_DIR))
    for df in (metrics.threshold_sweep(f, [0.1, 0.5, 0.9], ["run_id"]), metrics.breakdown(f)):
        assert plan(df).count("FileScan") == 1 and "CartesianProduct" not in plan(df)
