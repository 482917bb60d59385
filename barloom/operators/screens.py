"""Small rule screens over indicator columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.frames import with_row
from barloom.functions.rolling import Series, ratio
from barloom.functions.text import clamp

C = F.col
S = Series("symbol", "date")


def technical_bias(df: DataFrame) -> DataFrame:
    """Bullish / Bearish / Neutral from signed votes of close, means, RSI, MACD and ADX."""
    vote = lambda c: F.when(c, 1).when(~c, -1).otherwise(0)
    r = C("rsi_14")
    base = (
        vote(C("close") >= C("sma_20")) + vote(C("sma_20") >= C("sma_50")) + vote(C("macd") >= C("macd_signal"))
        + F.when(r.between(45, 70), 1).when((r < 35) | (r > 75), -1).otherwise(0))
    df = df.withColumn("_v", base)
    total = C("_v") + F.when(C("adx_14") >= 25, F.when(C("_v") > 0, 1).otherwise(-1)).otherwise(0)
    return df.withColumn(
        "bias", F.when(total >= 2, "Bullish").when(total <= -2, "Bearish").otherwise("Neutral")).drop("_v")


def buying_scores(panel: DataFrame, bench: DataFrame) -> DataFrame:
    """Trend, volume and relative-strength components of the buying screen per symbol."""
    w = Window.partitionBy("symbol")
    df = panel.withColumn("_rv", F.count(F.lit(1)).over(w) - S.position())
    tail = lambda c, n: F.avg(F.when(C("_rv") < n, C(c)))
    a = df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by("close", "date").alias("_c0"), F.max_by("close", "date").alias("_c1"),
        tail("close", 20).alias("_m20"), tail("close", 50).alias("_m50"), tail("volume", 10).alias("_v10"), tail("volume", 30).alias("_v30"))
    m = bench.agg((F.max_by("close", "date") / F.min_by("close", "date")).alias("_b"))
    a = with_row(a, m).withColumn("_g", ratio("_c1", "_c0"))
    trend = (
        F.when(C("_c1") > C("_m20"), 1.5).otherwise(-1.0) + F.when(C("_m20") > C("_m50"), 1.0).otherwise(-0.8)
        + clamp((C("_g") - 1) * 5, -1.0, 1.5) + 1.5)
    short = C("_n") < 30
    return a.select(
        "symbol", F.when(short, 0.0).otherwise(clamp(trend, 0.0, 3.5)).alias("trend_score"),
        F.when(short, 0.5).when(C("_v10") >= C("_v30"), 1.5).otherwise(0.8).alias("volume_score"),
        F.when(short, 0.8).when(C("_g") > C("_b"), 1.5).otherwise(0.6).alias("relative_score"))


def risk_vetoes(setups: DataFrame, min_reward_risk: float = 2.0) -> DataFrame:
    """Hard vetoes and compact reason codes of a technical setup row."""
    extension = ratio("close", "pivot") - 1
    reward = ratio(C("target_1") - C("close"), C("close") - C("stop_loss"))
    pick = lambda *rules: F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))
    return setups.withColumns(
        {
            "vetoes": pick(
                (C("technical_state").isin("FAILED_BREAKOUT", "LATE_ENTRY"), "technical state"),
                (F.round(reward, 9) < min_reward_risk, "reward-risk"), (C("volume") == 0, "zero volume")),
            "reason_codes": pick(
                (F.lit(True), "TECHNICAL_PRICE_VOLUME"), (extension > 0.03, "LATE_ENTRY_RISK"),
                (C("technical_state") == "BREAKOUT_CONFIRMED", "DARVAS_BREAKOUT")),
        }
    )


# Weights of the component scores, which run from 0 to 10.
BUYING_WEIGHTS = {"macro": 0.10, "sector": 0.15, "technical": 0.20, "fundamentals": 0.25, "valuation": 0.15, "sentiment": 0.05, "risk": 0.10}


def _cents(v):
    return F.round(v * 1.000000000001, 2)


def _known(c, good, yes: float, no: float):
    """``yes`` or ``no`` points for a value that is known, none for a missing one."""
    return F.when(C(c).isNull(), 0.0).when(good(C(c)), yes).otherwise(no)


def buying_profile_scores(profile: DataFrame) -> DataFrame:
    """Growth and quality (0..1) and valuation (0..10) of company profiles, and their red flags."""
    known = lambda c: C(c).isNotNull().cast("int")
    n = known("revenue_growth") + known("earnings_growth")
    mean = (F.coalesce("revenue_growth", F.lit(0.0)) + F.coalesce("earnings_growth", F.lit(0.0))) / F.nullif(n, F.lit(0))
    quality = (
        0.45 + _known("roe", lambda v: v > 0.15, 0.2, -0.1) + _known("margin", lambda v: v > 0.1, 0.15, -0.1)
        + _known("debt_to_equity", lambda v: v < 100, 0.1, -0.2) + _known("cash_flow", lambda v: v > 0, 0.1, -0.25))
    value = (
        5.0 + _known("pe", lambda v: (v > 0) & (v <= 25), 1.0, -1.5) + _known("pb", lambda v: (v > 0) & (v <= 4), 0.8, -0.8)
        + _known("ev_to_ebitda", lambda v: (v > 0) & (v <= 18), 0.7, -0.7))
    flags = [(C("governance_risk") >= 8, "governance"), (C("cash_flow") <= 0, "cash flow"), (C("debt_to_equity") > 200, "debt")]
    return profile.withColumns({
        "growth": F.coalesce(clamp(0.5 + mean, 0.0, 1.0), F.lit(0.45)), "quality": clamp(quality, 0.0, 1.0), "valuation": clamp(value, 0.0, 10.0),
        "red_flags": F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in flags]))})


def buying_composite(panel: DataFrame, bench: DataFrame, profile: DataFrame, min_volume: float = 500_000.0, stale_days: int = 10) -> DataFrame:
    """Two-stage buying screen of every symbol with bars: screen score and rejections, then weighted component scores.

    ``profile`` has one row per symbol: sector, revenue_growth, earnings_growth, roe, margin, debt_to_equity (percent),
    cash_flow, pe, pb, ev_to_ebitda, analysts, governance_risk; any may be NULL, a symbol without a row has none of them.
    Bars are reduced to one row per symbol; the benchmark's row is joined to all. A symbol with fewer than 30 bars has
    component scores but no action; one that is rejected keeps its scores, ``passed`` tells it apart.
    """
    w = Window.partitionBy("symbol")
    df = panel.withColumns({"_rv": F.count(F.lit(1)).over(w) - S.position(), "_r": S.change("close"), "_d": S.diff("close")})
    tail = lambda c, n, fn=F.avg: fn(F.when(C("_rv") < n, C(c) if isinstance(c, str) else c))
    stats = df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.max("date").alias("_last"), F.max_by("close", "date").alias("price"), tail("low", 20, F.min).alias("_low"),
        tail("volume", 20).alias("_v20"), F.coalesce(F.stddev_pop("_r"), F.lit(0.0)).alias("_vol"),
        tail(F.when(C("_d") >= 0, C("_d")), 14).alias("_gain"), tail(F.when(C("_d") < 0, -C("_d")), 14).alias("_loss"))
    market = buying_scores(bench.withColumn("symbol", F.lit("market")), bench).select(C("trend_score").alias("_market"))
    end = bench.agg(F.max("date").alias("_end"))
    a = with_row(with_row(stats.join(buying_scores(panel, bench), "symbol"), market), end)
    a = buying_profile_scores(a.join(profile, "symbol", "left"))
    rsi = F.when(C("bars") < 15, None).when(F.coalesce("_loss", F.lit(0.0)) == 0, 100.0).otherwise(
        100.0 - 100.0 / (1.0 + F.coalesce("_gain", F.lit(0.0)) / F.nullif(C("_loss"), F.lit(0.0))))
    technical = 2.5 + C("trend_score") + C("volume_score") + C("relative_score") + F.when(rsi.isNull(), 0.0).when(rsi.between(45, 70), 1.0).otherwise(-0.5)
    risk = 7.0 - F.when(C("_vol") > 0.045, 1.5).otherwise(0.0)
    a = a.withColumns({
        "macro": _cents(clamp(4.5 + C("_market"), 0.0, 10.0)), "sector_score": F.when(F.coalesce("sector", F.lit("Unknown")) == "Unknown", 5.0).otherwise(6.0),
        "technical": _cents(clamp(technical, 0.0, 10.0)), "fundamentals": _cents(C("quality") * 10), "valuation": _cents(C("valuation")),
        "sentiment": 5.0 + F.when(C("analysts") >= 10, 0.8).otherwise(0.0),
        "risk": _cents(clamp(F.when(F.size("red_flags") > 0, F.least(risk, F.lit(3.0))).otherwise(risk), 0.0, 10.0)),
        "screen_score": _cents(clamp((
            C("growth") * 0.2 + C("quality") * 0.25 + C("trend_score") / 3.5 * 0.2 + C("volume_score") / 1.5 * 0.15 + C("relative_score") / 1.5 * 0.2) * 100, 0.0, 100.0)),
        "stop_loss": _cents(F.least(C("price") * 0.93, C("_low") * 0.99))})
    score = sum((C("sector_score" if k == "sector" else k) * 10 * v for k, v in BUYING_WEIGHTS.items()), F.lit(0.0))
    a = a.withColumns({
        "score": _cents(score), "target_1": _cents(C("price") + (C("price") - C("stop_loss")) * 2), "target_2": _cents(C("price") + (C("price") - C("stop_loss")) * 3)})
    enough = C("bars") >= 30
    reasons = [
        (~enough, "history"), (C("_v20") < min_volume, "liquidity"), (F.datediff("_end", "_last") > stale_days, "outdated"), (C("screen_score") < 55, "screen score")]
    return a.withColumns({
        "reward_risk": _cents(F.greatest(C("target_1") - C("price"), F.lit(0.0)) / F.greatest(C("price") - C("stop_loss"), F.lit(0.01))),
        "rejections": F.concat(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in reasons])), "red_flags"),
    }).withColumns({
        "passed": F.size("rejections") == 0,
        "action": F.when(enough, F.when(C("score") >= 82, "BUY").when(C("score") >= 70, "ACCUMULATE").when(C("score") >= 55, "WATCH").otherwise("AVOID")),
        "allocation": F.when((C("score") >= 85) & (C("risk") >= 7) & (C("reward_risk") >= 3), "Up to 8% of portfolio")
        .when((C("score") >= 75) & (C("risk") >= 6), "Up to 5% of portfolio").otherwise("Up to 3% of portfolio")})
