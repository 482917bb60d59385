"""Registered queries against their SQL on the smallest tables, and the entry contract."""

import os

import pytest

import __spark_entry__ as entry_points
from tools.compare import clean, connect, rows_match

SF = "/root/testdata/sf0.001"
CHECKED = (
    "market_breadth_by_date", "sector_relative_features", "same_date_quintile_labels", "breadth_timeline",
    "sector_rotation_history", "symbol_quality_report", "point_in_time_join", "announcement_period_match",
    "threshold_grid", "backtest_trades", "chart_patterns", "streamed_unique_history",
)
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@needs_data
def test_entry_returns_rows(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@needs_data
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    df = entry_points.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(clean(v) for v in r) for r in df.select(*cols).collect()]
    rel = connect(SF).execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = [tuple(clean(r[names.index(c)]) for c in cols) for r in rel.fetchall()]
    ok, note = rows_match(got, want)
    assert ok, note
