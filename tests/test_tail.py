"""One grouped pass over the rows before a row, in place of frames that slide over every row."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.rolling import Series, Tail
from barloom.operators import features as ft
from barloom.operators import patterns as pt
from barloom.operators import strength as st

C = F.col


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def bench_of(df):
    return df.groupBy("date").agg(*[F.avg(c).alias(c) for c in ("open", "high", "low", "close", "volume")])


def test_tail_equals_series_on_the_last_row(spark, panel):
    df = spark.createDataFrame(panel.head(900)).withColumn("volume", F.when(F.dayofmonth("date") != 9, C("volume")))
    s, t = Series(), Tail()
    kinds = {"mean": ("close", 50, 0), "max": ("high", 20, -1), "min": ("low", 252, 0)}
    cols = {k: getattr(s, k)(c, n, end=e) for k, (c, n, e) in kinds.items()} | {"gaps": s.mean("volume", 30), "lag": s.lag("close", 21), "far": s.mean("close", 301)}
    rows = Window.partitionBy("symbol")
    want = df.withColumns(cols | {"_back_rows": F.count(F.lit(1)).over(rows) - s.position()}).where("_back_rows = 0").select("symbol", *cols)
    past = df.withColumn("_back_rows", F.count(F.lit(1)).over(rows) - s.position())
    got = past.groupBy("symbol").agg(
        *[getattr(t, k)(c, n, end=e).alias(k) for k, (c, n, e) in kinds.items()],
        t.mean("volume", 30).alias("gaps"), t.at("close", 21).alias("lag"), t.mean("close", 301).alias("far"))
    a, b = (x.orderBy("symbol").toPandas() for x in (want, got.select("symbol", *cols)))
    pd.testing.assert_frame_equal(a, b, rtol=1e-12)
    assert b["gaps"].isna().all() and b["far"].isna().all() and b["lag"].notna().all()


def test_strength_records_of_three_dates(spark, panel):
    df = spark.createDataFrame(panel)
    bench, days = bench_of(df), sorted(set(panel["date"]))
    picks = spark.createDataFrame([(days[-1 - k], k) for k in st.BACK], "date date, _back int")
    recs = st.strength_records(df, bench, st.StrengthConfig(), picks)
    assert "-251" not in plan_of(recs) and "-199" not in plan_of(recs)  # no frame of a year slides over the rows
    got = recs.toPandas().set_index(["symbol", "_back"]).sort_index()
    assert len(got) == 18
    for (symbol, back), r in got.iterrows():
        x = panel[panel["symbol"] == symbol].sort_values("date")
        x = x.iloc[: len(x) - back]
        assert r["date"] == x["date"].iloc[-1] and r["history"] == len(x) and r["sector"] == x["sector"].iloc[-1]
        np.testing.assert_allclose(
            [r["sma200"], r["sma200_prior"], r["high52"], r["pivot"], r["ret_1m"], r["volume_ratio"]],
            [x["close"].tail(200).mean(), x["close"].iloc[-220:-20].mean(), x["high"].tail(252).max(), x["high"].iloc[-21:-1].max(),
             x["close"].iloc[-1] / x["close"].iloc[-22] - 1, x["volume"].iloc[-1] / x["volume"].tail(20).mean()])


def test_vcp_scan_reads_the_last_row_only(spark, panel):
    df = spark.createDataFrame(panel.drop(columns="sector"))
    got = pt.vcp_scan(df, bench_of(df)).orderBy("symbol").collect()
    assert [r["symbol"] for r in got] == [f"S{k}" for k in range(6)]
    for r in got:
        x = panel[panel["symbol"] == r["symbol"]].sort_values("date")
        c, mean = x["close"].iloc[-1], lambda n, x=x: x["close"].tail(n).mean()
        assert r["history"] == 300 and r["close"] == c
        assert r["trend_ok"] == (c > mean(50) > mean(150) > mean(200) > x["close"].iloc[-220:-20].mean())
        assert r["near_high"] == (c >= x["high"].tail(252).max() * 0.9)
        assert r["dry_up"] == (x["volume"].tail(5).mean() < x["volume"].tail(20).mean() * 0.75)


def test_local_extrema_makes_the_closes_once(spark, panel):
    closes = panel[panel["symbol"] == "S0"]["close"].tolist()[:60]
    df = spark.createDataFrame([(closes,)], "v array<double>")
    out = df.select(pt.local_extrema(F.transform("v", lambda x: x + 0.0)).alias("e")).first()["e"]
    tree = plan_of(df.select(pt.local_extrema(F.transform("v", lambda x: x * 1.5)).alias("e")))
    assert tree.count("* 1.5") == 1
    for p in out:
        near = closes[p["at"] - 2 : p["at"] + 3]
        assert p["price"] == (max(near) if p["kind"] == "high" else min(near))


def test_recursive_group_keeps_rows_with_gaps(panel):
    x = panel[panel["symbol"] == "S1"].reset_index(drop=True).copy()
    x.loc[[0, 40, 41], "close"] = np.nan
    got = ft._recursive_group(x.sample(frac=1, random_state=1))
    want = x["close"].ewm(span=20, adjust=False, min_periods=0).mean()
    pd.testing.assert_series_equal(got.sort_index()["ema_20"], want, check_names=False)
    assert got.sort_index()["atr_wilder_14"].notna().sum() == 300 - 13


def test_only_spread_plans_size_their_shuffles(spark):
    from barloom.session import SPREAD_CONF, tune

    tune(spark, spread=True)
    assert {k: spark.conf.get(k) for k in SPREAD_CONF} == SPREAD_CONF
    tune(spark)
    assert all(spark.conf.get(k, None) != v for k, v in SPREAD_CONF.items())


def test_recursive_rows_cut_no_symbol(panel, monkeypatch):
    monkeypatch.setattr(ft, "RECURSIVE_ROWS", 400)
    rows = panel.sort_values(["symbol", "date"], ignore_index=True)
    got = pd.concat(ft._recursive_rows(iter([rows.iloc[i : i + 70] for i in range(0, len(rows), 70)])), ignore_index=True)
    want = pd.concat([ft._recursive_group(x) for _, x in rows.groupby("symbol")], ignore_index=True)
    pd.testing.assert_frame_equal(got, want)
    close = rows[rows["symbol"] == "S4"]["close"]
    np.testing.assert_allclose(got[got["symbol"] == "S4"]["ema_50"], close.ewm(span=50, adjust=False).mean())
