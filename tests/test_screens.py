"""Component scores, rejections and actions of the buying screen."""

import datetime as dt

import pytest

from barloom.operators import screens as sn

PROFILE = (
    "symbol string, sector string, revenue_growth double, earnings_growth double, roe double, margin double, debt_to_equity double, "
    "cash_flow double, pe double, pb double, ev_to_ebitda double, analysts int, governance_risk double"
)
GOOD = ("Steel", 0.3, 0.5, 0.2, 0.2, 50.0, 9.0, 20.0, 3.0, 12.0, 12, 2.0)


def bars(spark, lengths):
    d0, rows = dt.date(2024, 1, 1), []
    for symbol, n in lengths.items():
        for i in range(n):
            c = 100.0 + i * 0.4 - (0.9 if i % 3 == 0 else 0.0)
            rows.append((symbol, d0 + dt.timedelta(days=60 - n + i), c, c + 1, c - 1, c, 1000.0 + i))
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def test_profile_scores_and_flags(spark):
    rows = [("all", *GOOD), ("bad", None, -0.9, None, 0.1, 0.0, 300.0, 0.0, -1.0, 9.0, 40.0, 1, 9.0), ("none", *[None] * 12)]
    got = {r["symbol"]: r for r in sn.buying_profile_scores(spark.createDataFrame(rows, PROFILE)).collect()}
    near = lambda r: (pytest.approx(r["growth"]), pytest.approx(r["quality"]), pytest.approx(r["valuation"]), r["red_flags"])
    assert near(got["all"]) == (0.9, 1.0, 7.5, [])
    assert near(got["bad"]) == (0.0, 0.0, 2.0, ["governance", "cash flow", "debt"])
    assert near(got["none"]) == (0.45, 0.45, 5.0, [])


def test_composite_rejects_and_scores(spark):
    panel = bars(spark, {"A": 60, "SHORT": 20, "ONE": 1, "PLAIN": 60, "RED": 60})
    bench = bars(spark, {"X": 60}).drop("symbol").withColumn("close", sn.F.lit(100.0))
    profile = spark.createDataFrame([("A", *GOOD), ("RED", *GOOD[:-1], 8.0), ("ABSENT", *GOOD)], PROFILE)
    got = {r["symbol"]: r for r in sn.buying_composite(panel, bench, profile, min_volume=500).collect()}
    assert set(got) == {"A", "SHORT", "ONE", "PLAIN", "RED"}
    a = got["A"]
    # a flat market: trend 0 of 3.5 (-1 - 0.8 + 0 + 1.5, held at zero)
    assert (a["macro"], a["sector_score"], a["fundamentals"], a["valuation"], a["sentiment"], a["risk"]) == (4.5, 6.0, 10.0, 7.5, 5.8, 7.0)
    assert a["technical"] in (8.5, 9.0, 10.0) and a["passed"] and a["rejections"] == []
    parts = {k: a["sector_score" if k == "sector" else k] for k in sn.BUYING_WEIGHTS}
    assert a["score"] == pytest.approx(sum(parts[k] * 10 * w for k, w in sn.BUYING_WEIGHTS.items()), abs=0.006)
    assert a["action"] == ("BUY" if a["score"] >= 82 else "ACCUMULATE") and a["reward_risk"] == 2.0
    assert a["allocation"] == ("Up to 5% of portfolio" if a["score"] >= 75 else "Up to 3% of portfolio")
    assert got["RED"]["risk"] == 3.0 and got["RED"]["rejections"] == ["governance"] and not got["RED"]["passed"]
    assert got["PLAIN"]["sector_score"] == 5.0 and got["PLAIN"]["fundamentals"] == 4.5
    for s in ("SHORT", "ONE"):
        assert got[s]["action"] is None and "history" in got[s]["rejections"]
    assert sn.buying_composite(panel.limit(0), bench, profile).count() == 0
