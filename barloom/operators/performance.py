"""Performance of period returns (one row per period and variant) and trade attribution."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.rolling import Series, ratio

C = F.col
GAMMA = 0.5772156649


def _keys(by: Sequence[str]):
    return list(by) or [F.lit(0)]


def equity(periods: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Compounded portfolio, gross and benchmark equity with drawdown."""
    w = Window.partitionBy(*_keys(by)).orderBy("signal_date")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    curve = lambda c: F.exp(F.sum(F.log1p(c)).over(run))
    df = periods.withColumns(
        {
            "portfolio_equity": curve("net_return"), "gross_equity": curve("gross_return"),
            "benchmark_equity": curve("benchmark_return"),
        }
    )
    return df.withColumn(
        "drawdown", F.round(C("portfolio_equity") / F.max("portfolio_equity").over(run) - 1.0, 12)
    )


def longest_drawdown(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Longest run of consecutive periods below the peak (gaps and islands)."""
    w = Window.partitionBy(*_keys(by)).orderBy("signal_date")
    isl = curve.withColumn("_g", F.sum((C("drawdown") >= 0).cast("int")).over(w))
    runs = isl.groupBy(*by, "_g").agg(F.count(F.when(C("drawdown") < 0, 1)).alias("_n"))
    agg = F.max("_n").alias("max_drawdown_periods")
    return runs.groupBy(*by).agg(agg) if by else runs.agg(agg)


def sample_skew(g: Column, n: Column) -> Column:
    return g * F.sqrt(n * (n - 1)) / (n - 2)


def sample_excess_kurtosis(k: Column, n: Column) -> Column:
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6)


def normal_cdf():
    @F.pandas_udf("double")
    def cdf(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if pd.isna(x) else 0.5 * math.erfc(-x / math.sqrt(2)))

    return cdf


def expected_maximum(trials: int) -> float:
    """Expected best of ``trials`` standard normals (extreme-value approximation)."""
    from statistics import NormalDist

    if trials <= 1:
        return 0.0
    inv = NormalDist().inv_cdf
    return (1 - GAMMA) * inv(1 - 1 / trials) + GAMMA * inv(1 - 1 / (trials * math.e))


def performance(
    periods: DataFrame, trades: DataFrame, by: Sequence[str] = (), trials: int = 1
) -> DataFrame:
    """One row of portfolio, risk, benchmark and trade statistics per ``by``."""
    by = list(by)
    z = Series(by, "signal_date") if by else Series("_k", "signal_date")
    p = periods.withColumn("_k", F.lit(0))
    keys = [*by, "_k"]
    curve = equity(p, keys)
    curve = curve.withColumn("_gap", F.datediff("exit_date", F.lag("exit_date").over(z.w)))
    r, b = C("net_return"), C("benchmark_return")
    last = lambda c: F.max(F.struct("signal_date", c))[c]
    m = curve.groupBy(*keys).agg(
        F.count("net_return").alias("periods"), F.avg(r).alias("_mean"), F.stddev_samp(r).alias("_sd"),
        F.stddev_samp(F.when(r < 0, r)).alias("_down"), F.count(F.when(r < 0, 1)).alias("_nd"),
        last("portfolio_equity").alias("_eq"), last("gross_equity").alias("_geq"),
        last("benchmark_equity").alias("_beq"), F.min("drawdown").alias("max_drawdown"),
        F.datediff(F.max("exit_date"), F.min("exit_date")).alias("_days"),
        F.percentile("_gap", 0.5).alias("_mgap"), F.avg("turnover").alias("average_turnover"),
        F.avg("gross_exposure").alias("average_exposure"), F.covar_samp(r, b).alias("_cov"),
        F.var_samp(b).alias("_var"), F.avg(b).alias("_bmean"), F.skewness(r).alias("_g1"),
        F.kurtosis(r).alias("_g2"),
    )
    n = lambda c: F.count(F.when(c, 1))
    t = trades.where(C("skip_reason").isNull()).withColumn("_k", F.lit(0))
    win, loss = C("net_return") > 0, C("net_return") < 0
    ts = t.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.avg(win.cast("double")).alias("win_rate"),
        F.avg(F.when(win, r)).alias("average_win"), F.avg(F.when(loss, r)).alias("average_loss"),
        ratio(F.sum(F.when(win, r)), -F.sum(F.when(loss, r))).alias("profit_factor"),
        F.avg(r).alias("expectancy"), F.avg("holding_days").alias("average_holding_days"),
    )
    m = m.join(ts, keys, "left").join(longest_drawdown(curve, keys), keys, "left")
    ppy = F.when(C("periods") < 2, 12.0).otherwise(365.25 / F.greatest(C("_mgap"), F.lit(1.0)))
    m = m.withColumns(
        {"_ppy": ppy, "_years": F.greatest(C("_days") / 365.25, F.lit(1 / 252))}
    )
    m = m.withColumns(
        {
            "total_return": C("_eq") - 1, "gross_total_return": C("_geq") - 1,
            "benchmark_total_return": C("_beq") - 1, "cagr": F.pow("_eq", 1 / C("_years")) - 1,
            "annualized_volatility": C("_sd") * F.sqrt("_ppy"),
            "sharpe": F.coalesce(ratio("_mean", "_sd") * F.sqrt("_ppy"), F.lit(0.0)),
            "sortino": F.when((C("_nd") > 1) & (C("_down") > 0), C("_mean") / C("_down") * F.sqrt("_ppy")).otherwise(0.0),
            "beta": F.when((C("periods") > 2) & (C("_var") > 0), C("_cov") / C("_var")).otherwise(0.0),
            "net_cost_drag": C("_geq") - C("_eq"),
        }
    )
    m = m.withColumns(
        {
            "calmar": F.when(C("max_drawdown") < 0, C("cagr") / F.abs("max_drawdown")).otherwise(0.0),
            "alpha_annualized": F.when(
                (C("periods") > 2) & (C("_var") > 0), (C("_mean") - C("beta") * C("_bmean")) * C("_ppy")
            ).otherwise(0.0),
        }
    )
    k = C("periods").cast("double")
    sk, ku = sample_skew(C("_g1"), k), sample_excess_kurtosis(C("_g2"), k) + 3
    ps = C("sharpe") / F.sqrt("_ppy")
    var = (1 - sk * ps + (ku - 1) / 4 * ps * ps) / (k - 1)
    stat = F.when((k > 3) & (C("_sd") > 0) & (var > 0), (ps - expected_maximum(trials) / F.sqrt(k)) / F.sqrt(var))
    m = m.withColumn("deflated_statistic", stat)
    m = m.withColumn("deflated_sharpe_probability", normal_cdf()(C("deflated_statistic")))
    m = m.withColumn("periods_per_year", C("_ppy"))
    return m.drop(*[c for c in m.columns if c.startswith("_")])


def rolling_sharpe(periods: DataFrame, rows: int, periods_per_year: float) -> DataFrame:
    """Sharpe over the trailing ``rows`` periods."""
    z = Series("_k", "signal_date")
    p = periods.withColumn("_k", F.lit(0))
    value = ratio(z.mean("net_return", rows), z.std("net_return", rows)) * math.sqrt(periods_per_year)
    return p.select("signal_date", value.alias("rolling_sharpe"))


def monthly_table(periods: DataFrame) -> DataFrame:
    """Compounded monthly returns, one row per year and one column per month."""
    p = periods.select(F.year("exit_date").alias("year"), F.month("exit_date").alias("month"), "net_return")
    wide = p.groupBy("year").pivot("month", list(range(1, 13))).agg(F.exp(F.sum(F.log1p("net_return"))) - 1)
    return wide.withColumnsRenamed({str(i): f"m{i:02d}" for i in range(1, 13)})


def stock_attribution(trades: DataFrame) -> DataFrame:
    """Per-symbol attribution ranked by total net contribution (trades per symbol <= periods)."""
    t = trades.where(C("skip_reason").isNull())
    r = C("net_return")
    a = t.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("net_contribution").alias("total_net_contribution"),
        F.sum("gross_contribution").alias("total_gross_contribution"), F.avg(r).alias("average_net_return"),
        F.percentile(r, 0.5).alias("median_net_return"), F.avg((r > 0).cast("double")).alias("win_rate"),
        ratio(F.sum(F.when(r > 0, r)), -F.sum(F.when(r < 0, r))).alias("profit_factor"),
        F.max(r).alias("best_trade_return"), F.min(r).alias("worst_trade_return"),
        F.count(F.when(F.abs(r) > 0.5, 1)).alias("extreme_trade_count"),
        F.count(F.when(C("exit_reason") == "stop_loss", 1)).alias("stop_loss_count"),
        F.avg("holding_days").alias("average_holding_days"), F.min("entry_date").alias("first_entry_date"),
        F.max("exit_date").alias("last_exit_date"),
    )
    return a.withColumns(
        {
            "stop_loss_rate": C("stop_loss_count") / C("trades"),
            "data_review": F.when(C("extreme_trade_count") > 0, "REVIEW_EXTREME_MOVE").otherwise("PASS"),
            "sample_quality": F.when(C("trades") >= 5, "SUPPORTED").otherwise("LOW_SAMPLE"),
        }
    )


def top_n_summary(per: DataFrame) -> DataFrame:
    """CAGR, Sharpe, Sortino, drawdown and win rate of the top-n prediction portfolio (20-day periods)."""
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    c = per.withColumn("_e", F.exp(F.sum(F.log1p("portfolio_return")).over(w)))
    c = c.withColumn("_dd", C("_e") / F.max("_e").over(w) - 1)
    r = C("portfolio_return")
    k = math.sqrt(252 / 20)
    m = c.agg(
        F.count(F.lit(1)).alias("periods"), F.avg(r).alias("_m"), F.stddev_samp(r).alias("_s"),
        F.stddev_samp(F.when(r < 0, r)).alias("_d"), F.sum(F.log1p(r)).alias("_l"),
        F.sum(F.log1p("benchmark_return")).alias("_bl"), F.min("_dd").alias("max_drawdown"),
        F.avg((r > C("benchmark_return")).cast("double")).alias("win_rate"), F.avg("turnover").alias("turnover"),
    )
    years = C("periods") * 20 / 252
    return m.select(
        "periods", (F.exp(C("_l") / years) - 1).alias("cagr"), (F.exp(C("_bl") / years) - 1).alias("benchmark_cagr"),
        (ratio("_m", "_s") * k).alias("sharpe"), (ratio("_m", "_d") * k).alias("sortino"), "max_drawdown",
        (C("_s") * k).alias("volatility"), "win_rate", "turnover",
    )
