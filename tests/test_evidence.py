"""Holder links, fundamental snapshots and pattern flags against plain Python."""

from __future__ import annotations

import itertools
import random
import re
from collections import defaultdict
from datetime import date

import pytest

from barloom.operators import evidence as ev

HOLDINGS = [("a", "X", 10.0), ("a", "Y", 5.0), ("a", "Y", 7.0), ("b", "X", 1.0), ("b", "Y", 2.0), ("b", "Z", 3.0), ("c", "Z", 9.0), (None, "X", 1.0), ("d", None, 1.0)]


def holdings(spark, rows):
    return spark.createDataFrame(rows, "holder string, company string, percent double")


def brute_links(rows, hub):
    held = defaultdict(dict)
    for h, c, p in rows:
        if h is not None and c is not None:
            held[h][c] = max(p, held[h].get(c, p))
    out = defaultdict(lambda: [0, 0.0, 0.0])
    for h, cs in held.items():
        if len(cs) > hub:
            for c, p in cs.items():
                out[h, c, "hub"] = [1, 1 / (len(cs) - 1), p]
        else:
            for a, b in itertools.combinations(sorted(cs), 2):
                x = out[a, b, "common"]
                x[0], x[1], x[2] = x[0] + 1, x[1] + 1 / (len(cs) - 1), x[2] + min(cs[a], cs[b])
    return {k: pytest.approx(v) for k, v in out.items()}


@pytest.mark.parametrize("hub", [2, 3, 32])
def test_holder_links_equal_brute_force(spark, hub):
    got = {(r.source, r.target, r.relation): [r.holders, r.weight, r.overlap] for r in ev.holder_links(holdings(spark, HOLDINGS), hub).collect()}
    assert got == brute_links(HOLDINGS, hub)


def test_hot_holder_makes_a_row_per_company(spark):
    rows = [("hot", f"C{k:04d}", 1.0) for k in range(3000)] + [("a", "C0000", 2.0), ("a", "C0001", 3.0)]
    out = ev.holder_links(holdings(spark, rows)).collect()
    assert len(out) == 3001
    assert [(r.source, r.target, r.holders, r.weight, r.overlap) for r in out if r.relation == "common"] == [("C0000", "C0001", 1, 1.0, 2.0)]


def test_holder_links_shuffle_holdings_not_pairs(spark):
    plan = ev.holder_links(holdings(spark, HOLDINGS))._jdf.queryExecution().executedPlan().toString()
    keys = {tuple(re.findall(r"(\w+)#\d+", k)) for k in re.findall(r"hashpartitioning\(([^)]*), \d+\)", plan)}
    assert keys == {("holder", "company"), ("holder",), ("source",)}


def test_holder_links_of_random_holdings(spark):
    rng = random.Random(4)
    rows = [(f"h{int(rng.random() ** 2 * 60)}", f"c{int(rng.random() ** 3 * 40):02d}", rng.choice([0.5, 1.0, 2.5, 7.25])) for _ in range(900)]
    got = {(r.source, r.target, r.relation): [r.holders, r.weight, r.overlap] for r in ev.holder_links(holdings(spark, rows).repartition(7), 9).collect()}
    assert got == brute_links(rows, 9) and {"common", "hub"} == {k[2] for k in got}


def test_holder_links_of_an_empty_table(spark):
    assert ev.holder_links(holdings(spark, [])).collect() == []


def evidence(spark, rows):
    return spark.createDataFrame(rows, "symbol string, field string, value double, source string, precedence int, seen date")


def as_of(spark, *rows):
    return spark.createDataFrame(rows, "symbol string, as_of date")


def test_snapshot_takes_precedence_then_date_and_never_the_future(spark):
    rows = [
        ("A", "sales", 1.0, "market", 0, date(2024, 5, 30)), ("A", "sales", 2.0, "statement", 2, date(2024, 1, 10)),
        ("A", "sales", 3.0, "statement", 2, date(2024, 4, 10)), ("A", "sales", 9.0, "statement", 2, date(2024, 6, 2)),
        ("A", "net_profit", None, "statement", 2, date(2024, 5, 1)), ("A", "net_profit", float("nan"), "statement", 2, date(2024, 5, 2)),
        ("A", "net_profit", 4.0, "annual", 1, date(2023, 3, 1)), ("A", "eps", 5.0, "statement", 2, None),
        ("A", "turnover", 6.0, "market", 0, date(2024, 5, 20)), ("B", "sales", 7.0, "market", 0, date(2024, 7, 1)),
    ]
    days = as_of(spark, ("A", date(2024, 6, 1)), ("A", date(2024, 2, 1)), ("B", date(2024, 6, 1)))
    snap = ev.fundamental_snapshot(days, evidence(spark, rows))
    got = {(r.symbol, r.as_of, r.field): (r.value, r.source, r.age_days, r.freshness) for r in snap.collect()}
    june, feb = date(2024, 6, 1), date(2024, 2, 1)
    assert got == {
        ("A", june, "sales"): (3.0, "statement", 52, "AGING"), ("A", june, "net_profit"): (4.0, "annual", 458, "STALE"),
        ("A", june, "turnover"): (6.0, "market", 12, "FRESH"), ("A", feb, "sales"): (2.0, "statement", 22, "FRESH"),
        ("A", feb, "net_profit"): (4.0, "annual", 337, "STALE"),
    }
    gaps = {(r.symbol, r.as_of): (r.fields, r.sources, r.missing, r.freshness) for r in ev.snapshot_gaps(days, snap).collect()}
    rest = "Operating margin, Debt/equity, Operating cash flow"
    assert gaps["A", june] == (3, "annual, market, statement", rest, "FRESH")
    assert gaps["A", feb] == (2, "annual, statement", rest, "FRESH")
    assert gaps["B", june] == (0, "", f"Revenue growth, Profit growth, {rest}", "MISSING")


def cup_bars(n, handle, before=0):
    """Rim, cup, second rim and a handle over 100 rows, with flat rows before."""
    close = [90.0] * before + [100.0] * 20 + [80.0] * 45 + [100.0] * 25 + [handle] * 9 + [98.5]
    return [("A", date.fromordinal(738000 + k), c, c, c, c, 10.0) for k, c in enumerate(close[:n])]


@pytest.mark.parametrize(("n", "handle", "before", "flag"), [(100, 95.0, 0, True), (99, 95.0, 0, False), (105, 95.0, 5, True), (100, 99.5, 0, False), (100, 85.0, 0, False)])
def test_cup_with_handle(spark, n, handle, before, flag):
    bars = spark.createDataFrame(cup_bars(n, handle, before), "symbol string, date date, open double, high double, low double, close double, volume double")
    last = ev.pattern_shapes(bars).orderBy("date").collect()[-1]
    assert last.cup_with_handle is flag


def test_shapes_equal_pandas(spark, panel):
    import pandas as pd

    got = ev.pattern_shapes(spark.createDataFrame(panel)).toPandas().sort_values(["symbol", "date"]).set_index(["symbol", "date"])
    for symbol, p in panel.groupby("symbol"):
        c, h, lo, v = p["close"], p["high"], p["low"], p["volume"]
        tr = pd.concat([h - lo, (h - c.shift()).abs(), (lo - c.shift()).abs()], axis=1).max(axis=1)
        top, bottom = h.shift().rolling(20).max(), lo.shift().rolling(20).min()
        mine = got.loc[symbol]
        assert list(mine.volume_dry_up) == list(v.rolling(5).mean() < 0.75 * v.rolling(20).mean())
        assert list(mine.atr_contracting) == list(tr.rolling(14).mean() < tr.rolling(50).mean())
        assert list(mine.in_box) == list((top / bottom - 1 <= 0.15) & (c >= top * 0.95))
        assert list(mine.left_box) == list((c > top).astype(float).rolling(5).max() == 1)
        cups = []
        for k in range(len(p)):
            w = p.iloc[k - 99 : k + 1] if k >= 99 else None
            if w is None:
                cups.append(False)
                continue
            rim, low, rim2, near = w.high[:30].max(), w.close[20:75].min(), w.high[60:90].max(), w.close[-12:].min()
            cups.append(bool(-0.35 <= low / rim - 1 <= -0.1 and rim2 >= 0.92 * rim and -0.12 <= near / rim2 - 1 <= -0.02 and w.close.iloc[-1] >= 0.95 * rim2))
        assert list(mine.cup_with_handle) == cups


def test_pairs_of_a_holder_come_without_a_join(spark):
    """The holdings are read once: the only join is that of the degrees; pairs are ordered and counted once."""
    rows = [(h, c, 10.0 * c + h) for h in range(6) for c in range(h + 1)]
    links = ev.holder_links(spark.createDataFrame(rows, "holder long, company long, percent double"), hub=4)
    plan = links.where("relation = 'common'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    got = {(r.source, r.target): (r.holders, round(r.weight, 9), r.overlap) for r in links.where("relation = 'common'").collect()}
    want = {}
    for h in range(1, 4):
        for a in range(h + 1):
            for b in range(a + 1, h + 1):
                n, w, o = want.get((a, b), (0, 0.0, 0.0))
                want[a, b] = (n + 1, round(w + 1 / h, 9), o + 10.0 * a + h)
    assert got == want
