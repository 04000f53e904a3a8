"""Every registered query against its SQL twin on the smallest data, and the plans of the scalable ones."""

import contextlib
import io
import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle import compare, duck

# The smallest data has no series of 100 points and too few recent incidents for these.
EMPTY_AT_SMALL = {
    "a13_series_guard", "b1_search_incidents", "f3_most_severe", "i6_predicted_breach", "k11_fit_forecaster",
    "k12_forecast", "k13_next_hour", "k14_breach_alerts", "k15_trend", "k24_stored_forecaster",
}


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, small, name):
    problem = compare(spark, con, small, name, queries()[name], oracle_sql().get(name))
    if name in EMPTY_AT_SMALL:
        assert problem in (None, "no rows on either side")
    else:
        assert problem is None


def test_twins_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["type", "severity", "action_type", "incidents"] and df.count() > 0


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def single_partition_windows(text):
    """Windows of a plan that read their rows through an exchange into one partition."""
    tree, details = text.split("\n\n", 1)
    single = set(re.findall(r"\((\d+)\) Exchange\n(?:.+\n)*?Arguments: SinglePartition", details))
    above, found = [], []
    for line in tree.splitlines():
        m = re.search(r"([A-Z]\w+)(?: \w+)* \((\d+)\)", line)
        if not m:
            continue
        above = [x for x in above if x[0] < m.start()]
        parents = [n for _, n in reversed(above)]
        while parents and parents[0] in ("Sort", "WindowGroupLimit"):
            parents = parents[1:]
        if m[1] == "Exchange" and m[2] in single and parents and parents[0] == "Window":
            found.append(line)
        above.append((m.start(), m[1]))
    return found


def test_single_windows_are_seen(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    df = spark.range(10).withColumn("n", F.row_number().over(Window.partitionBy().orderBy("id")))
    assert single_partition_windows(plan(df))


@pytest.mark.parametrize(
    "name",
    ["c3_match_anomalies", "c4_match_predictions", "c5_match_forecasts", "c6_label_next_hour", "c10_tag_phases", "d3_ml_summary",
     "e1_rolling", "e12_alert_states", "e13_action_counts", "k1_extract_features", "k16_failure_features", "l1_context_pack"],
)
def test_no_nested_loops_or_single_windows(spark, small, name):
    text = plan(queries()[name](spark, small))
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    assert not single_partition_windows(text)


def test_filters_and_columns_reach_the_scan(spark, small):
    text = plan(queries()["d1_remediation_stats"](spark, small))
    assert "GreaterThan(l_shipdate" in text
    scan = next(line for line in text.splitlines() if "ReadSchema" in line)
    assert "l_comment" not in scan and "l_extendedprice" not in scan and "l_quantity" in scan
    text = plan(queries()["b1_search_incidents"](spark, small))
    assert "GreaterThanOrEqual(o_orderdate" in text and "TakeOrderedAndProject" in text
