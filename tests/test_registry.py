import pytest

import __spark_entry__ as entry
from oracle import compare, duck

# The rest of the registry is compared the same way by ``python tests/oracle.py <folder>``.
PICKED = ("harmonize_record", "dedupe_record", "record_summary", "calendar_daily", "calendar_by_region", "sensor_factors",
          "climatology_envelope", "transition_calibration", "transition_growth", "zscore_doy_window", "season_bands",
          "streaks", "threat_level", "points_sample", "spread_slice", "merge_budgeted", "coverage_by_year", "prior_for_boxes",
          "cell_panel", "backtest_mase_baselines", "dbscan_members", "customer_region_daily", "events_stream_tumbling")


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_its_sql(spark, con, sf, name):
    text, ok = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], sf)
    assert ok, text


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["date", "count", "raw", "frp"]


def test_calendar_plan_reads_only_what_it_needs(spark, sf):
    plan = entry.queries()["calendar_daily"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan and "BatchEvalPython" not in plan and "CartesianProduct" not in plan
