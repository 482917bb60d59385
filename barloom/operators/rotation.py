"""Sector rotation: index, breadth, relative strength, leadership, velocity, state, priority.

Everything after the stock-level stage is a (date, sector) table. The sector
taxonomy is a fixed list, so its date windows hold a few dozen rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.rolling import Series, flag, ratio
from barloom.operators.features import add_rsi

C = F.col
S = Series("symbol", "date")
Z = Series("sector", "date")


@dataclass(frozen=True)
class RotationConfig:
    min_history: int = 240
    min_constituents: int = 2
    # fixed weights of the leadership and rotation scores
    leadership: tuple[float, ...] = (0.35, 0.30, 0.15, 0.10, 0.10)
    rotation: tuple[float, ...] = (0.40, 0.25, 0.20, 0.15)
    # fixed state thresholds
    emerging_leadership: float = 55.0
    emerging_rotation: float = 70.0
    emerging_breadth50: float = 55.0
    emerging_breadth50_change: float = 5.0
    emerging_rank_improvement: float = 3.0
    emerging_persistence: int = 3
    persistence_rows: int = 5
    leader_leadership: float = 70.0
    leader_rotation: float = 55.0
    leader_breadth50: float = 60.0
    weakening_leadership: float = 60.0
    weakening_rotation: float = 40.0
    lagging_rotation: float = 30.0
    risk_off_breadth50: float = 35.0
    risk_on_breadth50: float = 55.0


def stock_panel(bars: DataFrame, cfg: RotationConfig) -> DataFrame:
    """Stock rows with means, RSI and one-row return; short histories left out."""
    n = Window.partitionBy("symbol")
    df = bars.withColumns(
        {"_n": F.count(F.lit(1)).over(n), "tradable": F.coalesce(C("volume"), F.lit(0.0)) > 0}
    ).where(C("_n") >= cfg.min_history)
    df = df.withColumns(
        {"ret_1d": S.change("close"), **{f"sma{k}": S.mean("close", k) for k in (20, 50, 200)}}
    )
    return add_rsi(df, S, 14, "rsi14").drop("_n")


def _plain_rsi_gt50(close_rsi: str) -> Column:
    return flag(C(close_rsi) > 50)


def sector_index(stocks: DataFrame, bench: DataFrame, cfg: RotationConfig) -> DataFrame:
    """Equal-weight index of tradable rows rebased to 100, with its means and volatility."""
    w = Window.partitionBy("symbol")
    t = stocks.where(C("tradable")).withColumns(
        {"_n": F.count(F.lit(1)).over(w), "_first": F.first("close", ignorenulls=True).over(S.w)}
    )
    t = t.where((C("_n") >= cfg.min_history) & (C("_first") > 0))
    members = t.groupBy("sector").agg(F.countDistinct("symbol").alias("_m"))
    big = members.where(C("_m") >= cfg.min_constituents).select("sector")
    idx = (
        t.groupBy("date", "sector")
        .agg(
            F.avg(ratio("close", "_first") * 100.0).alias("sector_close"),
            F.sum("volume").alias("sector_volume"),
        )
        .join(big, "sector", "left_semi")
    )
    idx = idx.withColumns(
        {
            "sector_ret_20d": Z.change("sector_close", 20),
            "sector_ret_60d": Z.change("sector_close", 60),
            **{f"sector_sma{k}": Z.mean("sector_close", k) for k in (20, 50, 200)},
            "_r": Z.change("sector_close"),
        }
    ).withColumn("sector_volatility_20d", Z.std("_r", 20)).drop("_r")
    one = Series("_k", "date")
    b = bench.where(C("close") > 0).select("date", C("close").alias("bench_close"))
    b = b.withColumn("_k", F.lit(0)).withColumns(
        {f"bench_ret_{k}d": one.change("bench_close", k) for k in (20, 60)}
    ).drop("_k")
    return idx.join(b, "date")


def sector_breadth(stocks: DataFrame) -> DataFrame:
    pct = lambda c: F.avg(flag(c)) * 100.0
    df = (
        stocks.where(C("tradable"))
        .groupBy("date", "sector")
        .agg(
            F.count(F.lit(1)).alias("constituent_count"),
            pct(C("close") > C("sma20")).alias("breadth20"),
            pct(C("close") > C("sma50")).alias("breadth50"),
            pct(C("close") > C("sma200")).alias("breadth200"),
            pct(C("rsi14") > 50).alias("rsi_above_50_fraction"),
            F.sum(F.when(C("ret_1d") > 0, C("volume")).otherwise(0.0)).alias("up_volume"),
            F.sum(F.when(C("ret_1d") < 0, C("volume")).otherwise(0.0)).alias("down_volume"),
        )
    )
    df = df.withColumn("up_volume_ratio", ratio("up_volume", C("up_volume") + C("down_volume")))
    return df.withColumns(
        {
            "breadth_change_10d": Z.diff("breadth50", 10),
            "volume_improvement": Z.diff("up_volume_ratio", 10),
        }
    )


def _pct(name: str) -> Column:
    """Average-tie percentile among the sectors of a date; unknown counts as the middle."""
    order = Window.partitionBy("date").orderBy(C(name).asc_nulls_last())
    ties = Window.partitionBy("date", name)
    n = F.count(name).over(Window.partitionBy("date"))
    avg_rank = F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0
    return F.when(C(name).isNotNull(), avg_rank / n).otherwise(0.5)


def add_relative_strength(df: DataFrame) -> DataFrame:
    df = df.withColumns(
        {
            "excess_return_20d": C("sector_ret_20d") - C("bench_ret_20d"),
            "excess_return_60d": C("sector_ret_60d") - C("bench_ret_60d"),
            "rs_ratio": ratio("sector_close", "bench_close"),
        }
    )
    return df.withColumns(
        {"rs_slope": Z.change("rs_ratio", 20), "rs_acceleration": Z.diff("excess_return_20d", 10)}
    )


def add_trend(df: DataFrame) -> DataFrame:
    above = F.coalesce(C("sector_close") > C("sector_sma50"), F.lit(False))
    stack = F.coalesce(
        (C("sector_close") > C("sector_sma20")) & (C("sector_sma20") > C("sector_sma50"))
        & (C("sector_sma50") > C("sector_sma200")), F.lit(False))
    rising = F.coalesce(Z.diff("sector_sma200", 20) > 0, F.lit(False))
    df = df.withColumns({"sector_above_sma50": above, "sector_trend_stack": stack, "_rise": rising})
    return df.withColumn(
        "trend_score",
        C("sector_above_sma50").cast("double") * 35.0 + C("sector_trend_stack").cast("double") * 45.0
        + C("_rise").cast("double") * 20.0,
    ).drop("_rise")


def add_scores(df: DataFrame, cfg: RotationConfig) -> DataFrame:
    """Volume, leadership, rank velocity and rotation scores."""
    a, b, c, d, e = cfg.leadership
    df = df.withColumns(
        {
            "volume_score": _pct("up_volume_ratio") * 100.0,
            "volume_improvement_score": _pct("volume_improvement") * 100.0,
            "relative_strength_score": _pct("excess_return_20d") * 45.0
            + _pct("excess_return_60d") * 35.0 + _pct("rs_slope") * 20.0,
            "breadth_score": _pct("breadth20") * 25.0 + _pct("breadth50") * 50.0
            + _pct("breadth200") * 25.0,
            "risk_score": 100.0 - _pct("sector_volatility_20d") * 100.0,
            "rs_acceleration_score": _pct("rs_acceleration") * 100.0,
            "breadth_improvement_score": _pct("breadth_change_10d") * 100.0,
        }
    )
    df = df.withColumn(
        "leadership_score",
        F.round(
            C("relative_strength_score") * a + C("breadth_score") * b + C("trend_score") * c
            + C("volume_score") * d + C("risk_score") * e, 9),
    )
    best = Window.partitionBy("date").orderBy(C("leadership_score").desc())
    df = df.withColumn("sector_rank", F.rank().over(best).cast("double"))
    df = df.withColumns({f"rank_{k}d_ago": Z.lag("sector_rank", k) for k in (5, 10, 20)})
    df = df.withColumns(
        {f"rank_change_{k}d": C(f"rank_{k}d_ago") - C("sector_rank") for k in (5, 10, 20)}
    ).withColumn("rank_velocity", C("rank_change_10d"))
    df = df.withColumn("rank_velocity_score", _pct("rank_velocity") * 100.0)
    p, q, r, t = cfg.rotation
    return df.withColumn(
        "rotation_score",
        F.round(
            C("rs_acceleration_score") * p + C("breadth_improvement_score") * q
            + C("rank_velocity_score") * r + C("volume_improvement_score") * t, 9),
    )


def market_regime(stocks: DataFrame, bench: DataFrame, cfg: RotationConfig) -> DataFrame:
    """RISK_ON / RISK_OFF / NEUTRAL per date."""
    one = Series("_k", "date")
    b = bench.withColumn("_k", F.lit(0))
    b = b.withColumns({"_s50": one.mean("close", 50), "_s200": one.mean("close", 200)})
    breadth = stocks.where(C("tradable")).groupBy("date").agg(
        (F.avg(flag(C("close") > C("sma50"))) * 100.0).alias("market_breadth50")
    )
    x = b.join(breadth, "date", "left")
    on = (
        (C("close") > C("_s50")) & (C("_s50") > C("_s200"))
        & (C("market_breadth50") >= cfg.risk_on_breadth50)
    )
    off = F.coalesce(C("close") < C("_s200"), F.lit(False)) | F.coalesce(
        C("market_breadth50") <= cfg.risk_off_breadth50, F.lit(False))
    return x.select(
        "date", "market_breadth50",
        F.when(on, "RISK_ON").when(off, "RISK_OFF").otherwise("NEUTRAL").alias("market_regime"),
    )


def classify(df: DataFrame, cfg: RotationConfig) -> DataFrame:
    """State machine with persistence of the emerging condition."""
    lead, rot = C("leadership_score"), C("rotation_score")
    emerging = F.coalesce(
        (lead >= cfg.emerging_leadership) & (rot >= cfg.emerging_rotation)
        & (C("excess_return_20d") > 0) & (C("rs_acceleration") > 0)
        & (C("breadth50") >= cfg.emerging_breadth50)
        & (C("breadth_change_10d") > cfg.emerging_breadth50_change)
        & (C("rank_velocity") >= cfg.emerging_rank_improvement) & C("sector_above_sma50"),
        F.lit(False),
    )
    df = df.withColumn("emerging_condition", emerging)
    df = df.withColumn(
        "persistence_count",
        F.sum(C("emerging_condition").cast("int")).over(Z.frame(cfg.persistence_rows)),
    )
    falling = lambda c: F.coalesce(C(c) < 0, F.lit(False))
    leader = (
        (lead >= cfg.leader_leadership) & (rot >= cfg.leader_rotation)
        & (C("excess_return_20d") > 0) & (C("excess_return_60d") > 0)
        & (C("breadth50") >= cfg.leader_breadth50) & C("sector_trend_stack")
    )
    lagging = (
        (rot <= cfg.lagging_rotation) & falling("rs_acceleration") & falling("breadth_change_10d")
        & falling("rank_velocity") & ~C("sector_above_sma50")
    )
    weakening = (lead >= cfg.weakening_leadership) & (
        (rot < cfg.weakening_rotation) | falling("rs_acceleration")
        | falling("breadth_change_10d") | falling("rank_velocity")
    )
    return df.withColumn(
        "rotation_state",
        F.when(C("emerging_condition") & (C("persistence_count") >= cfg.emerging_persistence),
               "EMERGING_ROTATION")
        .when(leader, "CONFIRMED_LEADER").when(lagging, "LAGGING_ROTATION_OUT")
        .when(weakening, "WEAKENING").otherwise("NEUTRAL"),
    )


def reason_text() -> Column:
    parts = (
        ("Leadership %.1f", C("leadership_score")),
        ("Rotation %.1f", C("rotation_score")),
        ("20D excess %.2f%%", C("excess_return_20d") * 100),
        ("RS acceleration %.2f%%", C("rs_acceleration") * 100),
        ("Breadth50 %.1f%%", C("breadth50")),
        ("10D breadth change %.1f pp", C("breadth_change_10d")),
        ("10D rank velocity %.1f", C("rank_velocity")),
        ("Persistence %d/5", C("persistence_count")),
    )
    return F.concat_ws("; ", *[F.format_string(f, c) for f, c in parts])


def rank_trend_label() -> Column:
    changes = F.array_compact(F.array(*[C(f"rank_change_{k}d") for k in (5, 10, 20)]))
    total = F.aggregate(changes, F.lit(0.0), lambda a, x: a + x)
    up = F.size(F.filter(changes, lambda x: x > 0))
    down = F.size(F.filter(changes, lambda x: x < 0))
    return (
        F.when((total >= 8) & (up >= 2), "🚀 STRONG IMPROVEMENT")
        .when((total >= 2) & (up >= 2), "↑ IMPROVING")
        .when((total <= -8) & (down >= 2), "🔻 STRONG DETERIORATION")
        .when((total <= -2) & (down >= 2), "↓ WEAKENING")
        .otherwise("→ STABLE")
    )


def _bounded(c: Column) -> Column:
    """Clamp to 0..100; an unknown input scores 100, as min/max over NaN do."""
    return F.when(c.isNull(), 100.0).otherwise(F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0)))


def add_priority(df: DataFrame) -> DataFrame:
    factor = F.when(C("market_regime") == "RISK_ON", 1.05).when(
        C("market_regime") == "RISK_OFF", 0.82).otherwise(1.0)
    base = (
        C("rotation_score") * 0.30 + C("leadership_score") * 0.20
        + _bounded(C("rs_acceleration") * 1000.0 + 50.0) * 0.15
        + _bounded(C("breadth_change_10d") * 2.0 + 50.0) * 0.12
        + _bounded(C("rank_change_20d") * 5.0 + 50.0) * 0.12
        + _bounded(C("persistence_count") / 5.0 * 100.0) * 0.06
        + C("volume_score") * 0.05
    )
    df = df.withColumns(
        {
            "rank_trend_label": rank_trend_label(),
            "volume_confirmation": F.when(C("volume_score") >= 70, "Strong")
            .when(C("volume_score") >= 45, "Neutral").otherwise("Weak"),
            "state_label": F.when(C("rotation_state") == "EMERGING_ROTATION", "EMERGING")
            .when(C("rotation_state") == "CONFIRMED_LEADER", "LEADER")
            .when(C("rotation_state") == "LAGGING_ROTATION_OUT", "ROTATION OUT")
            .otherwise(C("rotation_state")),
            "priority_score": F.round(_bounded(base * factor), 9),
            "classification_reason": reason_text(),
        }
    )
    good = C("rotation_state").isin("EMERGING_ROTATION", "CONFIRMED_LEADER")
    return df.withColumn(
        "action_label",
        F.when(good & (C("priority_score") >= 55), "⭐ HUNT")
        .when(C("rotation_state") == "WEAKENING", "⚠️ CAUTION")
        .when(C("rotation_state") == "LAGGING_ROTATION_OUT", "❌ AVOID")
        .when(C("priority_score") >= 45, "👀 WATCH")
        .otherwise("⚠️ CAUTION"),
    )


def rotation_history(bars: DataFrame, bench: DataFrame, cfg: RotationConfig | None = None) -> DataFrame:
    """Full (date, sector) rotation table. ``bars`` carries a sector column."""
    cfg = cfg or RotationConfig()
    stocks = stock_panel(bars, cfg)
    df = sector_index(stocks, bench, cfg).join(sector_breadth(stocks), ["date", "sector"], "left")
    df = add_scores(add_trend(add_relative_strength(df)), cfg)
    df = df.join(market_regime(stocks, bench, cfg), "date", "left")
    return add_priority(classify(df, cfg))


def latest_report(history: DataFrame) -> DataFrame:
    """Sectors of the latest date by priority."""
    day = history.agg(F.max("date").alias("date"))
    latest = history.join(day, "date", "left_semi")
    w = Window.partitionBy("date").orderBy(C("priority_score").desc(), "sector")
    return latest.withColumns(
        {
            "priority": F.row_number().over(w),
            "stock_selection_priority": C("rotation_state").isin(
                "EMERGING_ROTATION", "CONFIRMED_LEADER"),
        }
    )


def stock_contributions(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """Contribution score of every tradable stock to its sector's rotation, at the sector's
    latest date, ranked by absolute score inside the sector."""
    from barloom.operators.order_stats import with_ranks

    one = Series("_k", "date")
    b = bench.select("date", C("close").alias("bench_close")).withColumn("_k", F.lit(0))
    b = b.withColumns({f"bench_ret_{k}d": one.change("bench_close", k) for k in (20, 60)}).drop("_k")
    df = bars.where(C("volume") > 0).join(b, "date")
    df = df.withColumns(
        {
            "_r20": S.change("close", 20), "_r60": S.change("close", 60),
            "_rs": ratio("close", "bench_close"),
        }
    ).withColumns(
        {
            "rs_20d": C("_r20") - C("bench_ret_20d"),
            "rs_60d": C("_r60") - C("bench_ret_60d"),
        }
    )
    df = df.withColumns(
        {
            "rs_momentum_20d": S.change("_rs", 20),
            "rs_change": S.diff("rs_20d", 10),
            "momentum_change": S.diff("_r20", 10),
        }
    )
    df = df.withColumn(
        "contribution_score",
        F.coalesce("rs_20d", F.lit(0.0)) * 0.60 + F.coalesce("rs_change", F.lit(0.0)) * 0.40,
    )
    last = df.groupBy("sector").agg(F.max("date").alias("date"))
    latest = df.join(last, ["sector", "date"], "left_semi").where(C("rs_20d").isNotNull())
    latest = latest.withColumns(
        {
            "_abs": F.abs("contribution_score"),
            "direction": F.when(C("contribution_score") >= 0, "Positive").otherwise("Negative"),
        }
    )
    return with_ranks(latest, ["sector"], "_abs", {"rank": "min"}, descending=True).drop("_abs")
