"""Publications of period ends: the search runs once, texts meet no shuffle, repeats and unknown keys."""

import datetime as dt

from pyspark.sql import functions as F

from barloom.functions.text import period_in_text
from barloom.operators.point_in_time import resolve_publications

DAY = dt.date
AT = dt.datetime


def _inputs(spark):
    periods = spark.createDataFrame(
        [("A", DAY(2020, 3, 31), "QUARTERLY"), ("A", DAY(2019, 12, 31), "ANNUAL"), ("A", DAY(2021, 3, 31), "QUARTERLY"),
         ("B", DAY(2020, 2, 15), "QUARTERLY"), (None, DAY(2020, 3, 31), "QUARTERLY"), ("A", None, "QUARTERLY")],
        "symbol string, period_end date, result_type string")
    named = "Unaudited results for the quarter ended March 31, 2020"
    ann = [
        ("A", AT(2020, 6, 29), "Financial Results", named, "r1", "HIGH", "NSE"),  # 90 days after; 181 after the year end
        ("A", AT(2020, 6, 29), "Financial Results", named, "r1", "HIGH", "NSE"),
        ("A", AT(2020, 6, 30), "Financial Results", named, "r2", "HIGH", "NSE"),  # one day late
        ("A", AT(2020, 4, 29), "General update", "Quarterly results of the company", "r3", "MEDIUM", "BSE"),  # 120 days
        ("B", AT(2020, 2, 15), "General update", "Update", "same", "HIGH", "BSE"),  # one key, two texts: the better counts
        ("B", AT(2020, 2, 15), "Financial Results", "Update", "same", "HIGH", "NSE"),
        (None, AT(2020, 4, 1), "Financial Results", named, "r5", "HIGH", "NSE"),
        ("A", None, "Financial Results", named, "r6", "HIGH", "NSE"),
    ]
    ann = spark.createDataFrame(ann, "symbol string, ts timestamp, description string, body string, reference string, confidence string, source string")
    return periods, ann, spark.createDataFrame([(DAY(2020, 7, 1),)], "date date")


def test_best_announcement_of_each_period(spark):
    got = resolve_publications(*_inputs(spark))
    rows = {(r.symbol, r.period_end): (r.reference, r.match_score, r.confidence, r.source, r.effective_date) for r in got.collect()}
    none = (None, 0, "MISSING", "MISSING", None)
    assert rows == {
        ("A", DAY(2020, 3, 31)): ("r1", 120, "HIGH", "NSE", DAY(2020, 7, 1)),
        ("A", DAY(2019, 12, 31)): ("r3", 55, "MEDIUM", "BSE", DAY(2020, 7, 1)),
        ("B", DAY(2020, 2, 15)): ("same", 80, "HIGH", "NSE", DAY(2020, 7, 1)),
        ("A", DAY(2021, 3, 31)): none, (None, DAY(2020, 3, 31)): none, ("A", None): none,
    }


def test_the_search_is_not_repeated_by_the_result(spark):
    plan = resolve_publications(*_inputs(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan.lower() and "rlike" not in plan.lower()


def test_only_matches_are_parsed_as_dates(spark):
    texts = [("quarter ended March 31, 2020",), ("31st december 2019 and June 30, 2020",), ("on 5 May 2021",), ("no date",), ("",), (None,), ("March 77, 2020",)]
    df = spark.createDataFrame(texts, "t string").select(period_in_text(F.col("t")).alias("d"))
    assert [r.d for r in df.collect()] == [DAY(2020, 3, 31), DAY(2020, 6, 30), DAY(2021, 5, 5), None, None, None, None]
