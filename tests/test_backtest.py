"""Allocation, fills, metrics and as-of rules on hand-checked frames."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest as bt
from barloom.operators import performance as pf
from barloom.operators import point_in_time as pit


def _sequential_caps(rows, cfg):
    """Reference allocation, one name after the other."""
    vol = pd.Series([r[4] for r in rows], dtype=float)
    raw = 1 / vol.replace(0, np.nan)
    raw = raw.fillna(raw.median()).fillna(1.0)
    raw = raw / raw.sum()
    used, sector, out = 0.0, {}, {}
    for (_, sym, sec, _, _), r in zip(rows, raw, strict=True):
        v = min(r, cfg.max_position, max(0.0, cfg.max_sector - sector.get(sec, 0.0)), 1.0 - used)
        if v > 0 and 1.0 - used > 1e-12:
            out[sym] = v
            used += v
            sector[sec] = sector.get(sec, 0.0) + v
    return out


def test_inverse_volatility_caps_match_sequential_rule(spark):
    cfg = bt.Strategy(weighting="inverse_volatility", max_position=0.3, max_sector=0.45)
    rows = [(1, "A", "x", 9.0, 0.1), (2, "B", "x", 8.0, 0.2), (3, "C", "x", 7.0, 0.05), (4, "D", "y", 6.0, None), (5, "E", "y", 5.0, 0.4)]
    sel = spark.createDataFrame(rows, "rank int, symbol string, sector string, score double, volatility double").withColumns(
        {"signal_date": F.lit("2020-01-31").cast("date"), "side": F.lit(1)})
    got = {r["symbol"]: r["weight"] for r in bt.weights(sel, cfg).collect()}
    want = _sequential_caps(rows, cfg)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def _bars(spark, prices):
    d0 = dt.date(2020, 1, 1)
    rows = [("A", d0 + dt.timedelta(days=i), float(o), float(h), float(lo), float(c), float(c), True, 1e9, 0.0) for i, (o, h, lo, c) in enumerate(prices)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, prev_close double, is_tradable boolean, traded_value double, volatility double")


@pytest.mark.parametrize("stop, trail, want", [
    (0.12, None, ("stop_loss", 85.0)),      # gap below the stop fills at the open
    (None, 0.10, ("trailing_stop", 85.0)),
    (None, None, ("rebalance", 130.0)),
])
def test_exits(spark, stop, trail, want):
    bars = _bars(spark, [(100, 101, 99, 100), (100, 120, 99, 118), (85, 90, 80, 88), (130, 131, 129, 130)])
    cfg = bt.Strategy(stop_loss=stop, trailing_stop=trail)
    days = [r["date"] for r in bars.select("date").orderBy("date").collect()]
    spans = spark.createDataFrame([(days[0], days[0], days[3], 1, d) for d in days], "signal_date date, entry_date date, exit_date date, period_no int, date date")
    picks = spark.createDataFrame([("A", days[0], 1, 0.1, "x")], "symbol string, signal_date date, side int, weight double, sector string")
    r = bt.simulate(picks, bars, spans.drop("exit_date"), cfg).first()
    assert (r["exit_reason"], round(r["exit_price"], 6)) == want


def test_compounding_of_two_periods(spark):
    d = [dt.date(2020, 1, 31), dt.date(2020, 2, 28)]
    per = spark.createDataFrame([(d[0], d[0], 0.1, 0.1, 0.0, 0.5, 1.0), (d[1], d[1], 0.1, 0.1, 0.0, 0.5, 1.0)],
                                "signal_date date, exit_date date, net_return double, gross_return double, benchmark_return double, turnover double, gross_exposure double")
    e = pf.equity(per).orderBy("signal_date").collect()
    assert abs(e[-1]["portfolio_equity"] - 1.21) < 1e-12


def test_facts_are_invisible_before_publication(spark):
    days = [dt.date(2020, 5, x) for x in (10, 20, 30)]
    m = spark.createDataFrame([("A", x) for x in days], "symbol string, date date")
    f = spark.createDataFrame([("A", dt.date(2020, 3, 31), dt.date(2020, 5, 20), 1.5)], "symbol string, period_end date, publication_date date, v double")
    out = {r["date"]: r["v"] for r in pit.merge_point_in_time(m, f).collect()}
    assert out == {days[0]: None, days[1]: 1.5, days[2]: 1.5}


def test_corrected_moments_match_pandas(spark):
    x = np.random.default_rng(1).normal(0, 1, 40) ** 3
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    n = F.lit(40.0)
    r = df.agg(pf.sample_skew(F.skewness("v"), n).alias("s"), pf.sample_excess_kurtosis(F.kurtosis("v"), n).alias("k")).first()
    assert np.isclose(r["s"], pd.Series(x).skew()) and np.isclose(r["k"], pd.Series(x).kurtosis())


def test_folds_to_score_come_from_the_data(spark):
    from barloom.operators.learning import evaluable_folds

    rows = spark.createDataFrame([(4,), (2,), (2,), (9,), (None,)], "fold int")
    assert evaluable_folds(rows) == [4, 9] and evaluable_folds(rows.limit(0)) == []


def test_plan_frequencies_come_from_2000_paths(spark):
    from barloom.plans.catalog import REGISTRY

    shares = [r.target_share for r in REGISTRY["simulated_plan_frequencies"].run(spark, "/root/testdata/sf0.001").collect()]
    whole = lambda n: all(abs(n * x - round(n * x)) < 1e-6 for x in shares)
    assert shares and whole(2000) and not whole(20)
