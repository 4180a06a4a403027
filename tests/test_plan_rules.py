"""Plan guards: no registered query may plan a cartesian product or a
nested-loop join, and the fact scans must be column-pruned."""

import os

import pytest

from shelfwise.plans import catalog as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_text(df):
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_cartesian_or_nested_loop(spark, name):
    text = plan_text(E.queries()[name](spark, SF))
    for op in FORBIDDEN:
        assert op not in text, f"{name} plans {op}"


def test_fact_scan_is_pruned(spark):
    text = plan_text(E.queries()["total_revenue_filtered"](spark, SF))
    schemas = [ln for ln in text.splitlines() if ln.startswith("ReadSchema")]
    # the summary/fact scan reads only the key, the brand and the sales
    assert any("total_sales" in ln and "volume" not in ln for ln in schemas)
    assert any("EqualTo(brand,Brand#13)" in ln for ln in text.splitlines()
               if ln.startswith("PushedFilters"))
