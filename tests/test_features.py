"""Window and recursive features: pandas equality and the look-ahead invariance."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.operators import features as ft


def _bench(df):
    return df.groupBy("date").agg(*[F.avg(c).alias(c) for c in ("open", "high", "low", "close")], F.sum("volume").alias("volume"))


def test_future_bars_do_not_change_the_past(spark, panel):
    df = spark.createDataFrame(panel)
    cut = sorted(panel["date"].unique())[270]
    mutated = panel.copy()
    late = mutated["date"] > cut
    mutated.loc[late, ["open", "high", "low", "close"]] *= 3.0
    cols = ["symbol", "date", "ret_20d", "sma_50", "rsi_14", "adx_14", "ema_20", "macd", "rs_vs_bench_60d", "beta_60d"]

    def run(x):
        d = spark.createDataFrame(x)
        out = ft.technical_features(d, _bench(d)).join(ft.recursive_features(d), ["symbol", "date"])
        return out.select(*cols).where(F.col("date") <= F.lit(cut)).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)

    pd.testing.assert_frame_equal(run(panel), run(mutated))
    assert df.count() == len(panel)


def test_wilder_indicators_match_pandas(spark, panel):
    got = ft.recursive_features(spark.createDataFrame(panel)).toPandas()
    one = panel[panel["symbol"] == "S2"].reset_index(drop=True)
    g = got[got["symbol"] == "S2"].sort_values("date").reset_index(drop=True)
    w = dict(alpha=1 / 14, adjust=False, min_periods=14)
    up, dn = one["high"].diff(), -one["low"].diff()
    tr = pd.concat([one["high"] - one["low"], (one["high"] - one["close"].shift()).abs(), (one["low"] - one["close"].shift()).abs()], axis=1).max(axis=1)
    atr = tr.ewm(**w).mean()
    p = 100 * up.where((up > dn) & (up > 0), 0.0).ewm(**w).mean() / atr
    m = 100 * dn.where((dn > up) & (dn > 0), 0.0).ewm(**w).mean() / atr
    adx = (100 * (p - m).abs() / (p + m)).ewm(**w).mean()
    assert np.allclose(g["adx_wilder_14"], adx, equal_nan=True)
    assert np.allclose(g["ema_50"], one["close"].ewm(span=50, adjust=False).mean())


def test_feature_variants_have_documented_sizes():
    assert [len(ft.VARIANTS[v]) for v in ("baseline", "sector", "sector_regime", "advanced")] == [35, 48, 70, 102]


def test_rolling_needs_a_full_frame(spark):
    d = spark.createDataFrame([("A", i, float(i)) for i in range(5)], "symbol string, date int, close double")
    rows = d.withColumn("m", ft.S.mean("close", 3)).orderBy("date").collect()
    assert [r["m"] for r in rows] == [None, None, 1.0, 2.0, 3.0]


def test_pair_windows_equal_plain_frames(spark, panel):
    """Slopes and correlations are those of pandas, across batches and series; a flat series has none; no window frames."""
    df = panel.copy()
    df.loc[(df.symbol == "S1") & (df.index % 97 == 0), "close"] = None
    df.loc[df.symbol == "S5", "close"] = 50.0
    bench = panel.groupby("date", as_index=False).close.mean()
    rows = spark.createDataFrame(df.astype({"close": object}).where(df.notna(), None), "symbol string, date date, open double, high double, low double, close double, volume double, sector string")
    made = ft.add_benchmark(ft.add_returns(rows), spark.createDataFrame(bench))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "covar_samp" not in plan and "corr(" not in plan
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        got = made.toPandas().sort_values(["symbol", "date"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    x = df.sort_values(["symbol", "date"]).merge(bench.rename(columns={"close": "b"}), on="date").sort_values(["symbol", "date"])
    x["r"] = x.groupby("symbol").close.pct_change(fill_method=None)
    x["br"] = x.groupby("symbol").b.pct_change(fill_method=None)
    for n in (60, 120, 252):
        want = np.concatenate([(g.r.rolling(n).cov(g.br) / g.br.rolling(n).var()).to_numpy() for _, g in x.groupby("symbol")])
        flat = np.repeat([s == "S5" for s in sorted(df.symbol.unique())], 300)
        beta = got[f"beta_{n}d"].to_numpy(float)
        assert np.allclose(beta[~flat], want[~flat], atol=1e-9, equal_nan=True)
        assert np.nanmax(np.abs(beta[flat])) == 0
    for n in (20, 60, 120):
        want = np.concatenate([g.r.rolling(n).corr(g.br).to_numpy() for _, g in x.groupby("symbol")])
        corr = got[f"corr_bench_{n}d"].to_numpy(float)
        assert np.allclose(corr[~flat], want[~flat], atol=1e-9, equal_nan=True)
        assert np.isnan(corr[flat]).all()


def test_matrix_shuffles_no_wide_rows(spark, panel):
    """Wide rows meet only broadcast tables; a repeated key meets all recursive rows of its date, as in a join."""
    bars = spark.createDataFrame(panel)
    bench = _bench(bars)
    single = ft.feature_matrix(bars, bench)
    plan = single._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
    wide = [line for line in single._jdf.queryExecution().executedPlan().toString().splitlines() if "SortMergeJoin" in line]
    assert not wide
    n = single.count()
    assert n > 0
    twice = bars.unionByName(bars.where("symbol = 'S2'"))
    got = {r.symbol: r["count"] for r in ft.feature_matrix(twice, bench).groupBy("symbol").count().collect()}
    one = {r.symbol: r["count"] for r in single.groupBy("symbol").count().collect()}
    assert got["S1"] == one["S1"]
    assert got["S2"] % 4 == 0 and got["S2"] > one["S2"]


def test_matrix_equals_window_operators(spark, panel):
    """Array frames over many symbols give what the windows give: gaps, flat and short series, rows without a date, small batches."""
    df = panel.copy()
    df["volume"] = df["volume"].where(~((df.symbol == "S0") & (df.index % 83 == 0)))
    df.loc[(df.symbol == "S1") & (df.index % 7 == 0), "high"] = None
    df.loc[df.symbol == "S3", ["open", "high", "low", "close"]] = 50.0
    df.loc[df.symbol == "S4", "volume"] = 0.0
    df = pd.concat([df, df[df.symbol == "S2"].assign(symbol="S9").iloc[:40], df[df.symbol == "S2"].assign(symbol=None)], ignore_index=True)
    df = pd.concat([df, df[df.symbol == "S5"].iloc[5:7].assign(date=None)], ignore_index=True)
    schema = "symbol string, date date, open double, high double, low double, close double, volume double, sector string"
    bars = spark.createDataFrame(df.astype(object).where(df.notna(), None), schema).withColumn("tag", F.array(F.col("volume"), F.lit(1.0)))
    bench = _bench(bars.where("date IS NOT NULL")).where("date <> '2020-03-05'")
    keep = [f for f in ft.VARIANTS["advanced"] if f in {*ft.BASE_FEATURES, *ft.ADVANCED_FEATURES} and not f.startswith("sector_")]
    want = ft.technical_features(bars, bench).withColumn("_k", F.coalesce("symbol", F.lit("-")))
    same = ft.recursive_features(bars).withColumn("_k", F.coalesce("symbol", F.lit("-"))).drop("symbol")
    want = want.join(same, ["_k", "date"]).dropna(subset=ft.BASE_FEATURES).select("symbol", "date", "close", *keep, "tag")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        got = ft.feature_matrix(bars, bench, carry=["tag"]).select(*want.columns).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroupsInPandas" not in ft.feature_matrix(bars, bench)._jdf.queryExecution().executedPlan().toString()
    a, b = (x.sort_values(["symbol", "date"]).reset_index(drop=True) for x in (got, want.toPandas()))
    assert len(a) == len(b) > 100 and {"S2", "S5"} <= set(a.symbol.dropna()) and a.symbol.isna().any()
    assert [list(t) for t in a["tag"]] == [list(t) for t in b["tag"]]
    pd.testing.assert_frame_equal(a.drop(columns="tag"), b.drop(columns="tag"), rtol=1e-9, atol=1e-9)
    exact = [c for c in keep if not c.startswith(("ema_", "macd"))]
    assert a[exact].astype(float).equals(b[exact].astype(float))


def test_symbols_go_on_many_at_a_time(panel):
    """A block of several symbols equals its symbols alone, and array frames equal plain ones."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    row = np.r_[np.arange(1, 151), np.arange(1, 251)]
    s = ft._Rows(row)
    for n in (1, 2, 5, 20, 100, 252):
        plain = lambda f: np.concatenate([getattr(pd.Series(p).rolling(n), f)().to_numpy() for p in (x[:150], x[150:])])  # noqa: B023, E731
        for f in ("sum", "mean", "max", "min", "std"):
            assert np.allclose(getattr(s, f)(x, n), plain(f), equal_nan=True) or n == 1 and f == "std"
    assert np.nanmax(s.std(np.full(400, 0.1), 20)) == 0
