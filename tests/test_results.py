"""Quarterly result analysis against worked quarters."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import results as rs

SCHEMA = (
    "symbol string, period_end date, company string, sector string, revenue double, operating_profit double, net_profit double, eps double, "
    "ratios array<struct<label:string,value:string>>, text string, document string, document_hash string, facts array<string>, warnings int, errors int"
)
PE = lambda v: [("Market Cap", "1,000 Cr."), ("Current Stock P/E", v)]


def quarter(symbol, n, revenue, op, profit, eps=1.0, pe="16.5", sector="Steel", text="", doc="d", found=("x",), warnings=0, errors=None):
    return (symbol, dt.date(2020 + n // 4, n % 4 * 3 + 3, 28), symbol, sector, revenue, op, profit, eps, PE(pe) if pe else None, text, doc, doc, list(found) if found else None, warnings, errors)


def analysed(spark, rows):
    return {(r["symbol"], (r["period_end"].year - 2020) * 4 + r["period_end"].month // 3 - 1): r for r in rs.analysed_results(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_scores_actions_and_lists(spark):
    base = [quarter(s, n, 100.0, 10.0, 5.0) for s in ("UP", "DOWN", "BANK", "LOW") for n in range(4)]
    rows = base + [
        quarter("UP", 4, 120.0, 15.0, 8.0), quarter("DOWN", 4, 90.0, 5.0, 4.0, pe="40", text="Exceptional loss. Other Income rose", doc=None),
        quarter("BANK", 4, 120.0, 24.0, 8.0, sector="Private Bank", pe=None), quarter("LOW", 4, 120.0, 15.0, 8.0, found=("Needs OCR",), doc="d", warnings=1, errors=2),
        quarter("LOSS", 0, 0.0, 0.0, -5.0), quarter("LOSS", 1, 50.0, 1.0, -4.0), quarter("LOSS", 2, 60.0, None, 2.0, pe="(3)"),
        quarter(None, 0, None, None, None, None, pe="-", text=None, doc=None, found=None)]
    got = analysed(spark, rows)
    up, down, bank, low = (got[s, 4] for s in ("UP", "DOWN", "BANK", "LOW"))
    assert (up["score"], up["strength"], up["action"], up["confidence"], up["shortlisted"]) == (72.0, "Strong", "Research priority", "High", True)
    assert (up["revenue_yoy"], up["net_profit_yoy"], round(up["margin_change_bps"], 6), up["improved"], up["risks"]) == ("+20.0%", "+60.0%", 250.0, ["revenue", "profit", "margin"], [])
    # -10 - 16 - 12 - 10 - 8, held at zero
    assert (down["score"], down["strength"], down["valuation"], down["weakened"]) == (0.0, "Weak", "Expensive", ["revenue", "profit", "margin"])
    assert down["risks"] == ["exceptional item", "other income", "no document"] and down["action"] == "Weak results"
    # no margin points for a financial company, no valuation
    assert (bank["score"], bank["strength"], bank["action"]) == (48.0, "Mixed", "Mixed — monitor")
    assert bank["unanswered"] == ["margin of a financial company", "valuation"] and bank["pe"] is None
    assert (low["confidence"], low["action"], low["strength"], low["risks"]) == ("Low", "Needs verification", "Needs verification", ["extraction errors", "validation warnings"])
    # three quarters compare their year with the first one
    assert got["LOSS", 1]["revenue_qoq"] == "Turnaround from zero base" and got["LOSS", 1]["net_profit_qoq"] == "Loss reduced +20.0%"
    last = got["LOSS", 2]
    assert (last["net_profit_yoy"], last["revenue_yoy"], last["operating_margin"], last["pe"]) == ("Turnaround to profit", "Turnaround from zero base", None, -3.0)
    none = got[None, 0]
    assert (none["revenue_yoy"], none["valuation"], none["score"], none["confidence"]) == ("Unavailable", "Insufficient data", 0.0, "Medium")
    assert rs.analysed_results(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("label, want", [("stock p/e", "9"), ("CAP", "1"), ("roe", None)])
def test_loose_label_takes_the_first_hit(spark, label, want):
    df = spark.createDataFrame([([("Market Cap", "1"), ("Stock P/E", "9"), ("Other stock p/e", "8")],)], "r array<struct<label:string,value:string>>")
    assert df.select(rs.loose_value(F.col("r"), label).alias("v")).first()["v"] == want
