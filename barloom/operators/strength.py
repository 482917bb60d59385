"""Relative-strength report: ratings, stages, scans, sector summary and alerts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.frames import with_row
from barloom.functions.rolling import Series, Tail, ratio
from barloom.sources.staging import stage
from barloom.operators.order_stats import quantiles, with_ranks

C = F.col
S = Series("symbol", "date")
#: Benchmark sessions before the as-of date that a snapshot compares.
BACK = (0, 5, 20)


@dataclass(frozen=True)
class StrengthConfig:
    return_rows: tuple[int, ...] = (63, 126, 189, 252)
    return_weights: tuple[float, ...] = (0.40, 0.20, 0.20, 0.20)
    minimum_history: int = 253
    minimum_coverage: float = 0.60
    near_breakout: float = 0.03
    volume_surge: float = 1.50


def common_as_of(bars: DataFrame, bench: DataFrame, cfg: StrengthConfig) -> DataFrame:
    """Latest benchmark date that enough symbols cover within their last ten bars (one row)."""
    w = Window.partitionBy("symbol")
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).where(
        C("_n") >= cfg.minimum_history
    )
    total = n.agg(F.count(F.lit(1)).alias("_symbols"))
    tail = (
        bars.join(n, "symbol")
        .withColumn("_rev", F.count(F.lit(1)).over(w) - S.position())
        .where(C("_rev") < 10)
        .join(bench.select("date").distinct(), "date", "left_semi")
    )
    per_date = tail.groupBy("date").agg(F.count(F.lit(1)).alias("_c"))
    need = F.greatest(F.lit(1), F.ceil(C("_symbols") * F.lit(cfg.minimum_coverage)))
    return with_row(per_date, total).where(C("_c") >= need).agg(F.max("date").alias("as_of"))


def _stage() -> Column:
    c, a, b, l, p = (C(x) for x in ("close", "sma50", "sma150", "sma200", "sma200_prior"))
    up = F.coalesce((c > a) & (a > b) & (b > l) & (l > p), F.lit(False))
    down = F.coalesce((c < a) & (a < b) & (b < l) & (l < p), F.lit(False))
    return (
        F.when(up, "Stage 2").when(down, "Stage 4")
        .when((c >= l) & (a >= l), "Stage 1").otherwise("Stage 3")
    )


def strength_records(bars: DataFrame, bench: DataFrame, cfg: StrengthConfig, picks: DataFrame) -> DataFrame:
    """One strength record per symbol and date of ``picks`` (date, _back: 0, 5, 20), with enough history, before ranking.

    The record of a row is aggregated from the rows before it, so the work per symbol is three passes over its bars.
    """
    t, whole = Tail(), Window.partitionBy("symbol")
    df = bars.withColumn("history", S.position())
    df = df.join(bench.select("date", C("close").alias("_b")), "date", "left")
    df = df.withColumns({"_chg": S.diff("close"), "_ratio": ratio("close", "_b"), "_place": S.position()})
    df = with_row(df, picks.agg(*[F.max(F.when(C("_back") == k, C("date"))).alias(f"_d{k}") for k in BACK]))
    rows = [F.max(F.when(C("date") == C(f"_d{k}"), C("_place"))).over(whole) - C("_place") for k in BACK]
    df = df.withColumn("_o", F.array(*[F.struct(F.lit(k).alias("k"), r.alias("r")) for k, r in zip(BACK, rows, strict=True)]))
    df = df.drop(*[f"_d{k}" for k in BACK]).withColumn("_o", F.explode("_o")).where(C("_o.r").between(0, 252))
    df = df.withColumns({"_back": C("_o.k"), "_back_rows": C("_o.r"), "_dv": F.when(C("_chg") < 0, C("volume"))})
    df = df.groupBy("symbol", "_back").agg(
        *[t.at(c).alias(c) for c in bars.columns if c != "symbol"], t.at("history").alias("history"), t.at("_ratio").alias("_ratio"),
        *[t.at("close", n).alias(f"_lag{n}") for n in dict.fromkeys((1, 21, *cfg.return_rows))],
        *[t.mean("close", n).alias(f"sma{n}") for n in (20, 50, 150, 200)], t.mean("close", 200, end=-20).alias("sma200_prior"),
        t.max("high", 20, end=-1).alias("pivot"), t.max("high", 252).alias("high52"), t.min("low", 252).alias("low52"),
        t.mean("volume", 20).alias("_v20"), t.mean(C("close") * C("volume"), 20).alias("traded_value_20"),
        F.max(t.inside("_ratio", 252, -1)).alias("_rs_prior"), F.count(t.inside("_ratio", 253)).alias("_rs_n"),
        F.max(t.inside("_dv", 10, -1)).alias("_max_dv"), F.count(t.inside("_dv", 10, -1)).alias("_n_dv"),
    )
    change = lambda n: ratio("close", f"_lag{n}") - 1.0
    df = df.withColumns(
        {"ret_1d": change(1), "ret_1m": change(21), **{f"ret_{n}": change(n) for n in cfg.return_rows},
         "volume_ratio": ratio("volume", "_v20")}
    )
    close, p200 = C("close"), C("sma200_prior")
    rising = F.coalesce(C("sma200") > p200, F.lit(False))
    stack = (close > C("sma50")) & (C("sma50") > C("sma150")) & (C("sma150") > C("sma200"))
    composite = sum(
        (C(f"ret_{n}") * wt for n, wt in zip(cfg.return_rows, cfg.return_weights, strict=True)),
        F.lit(0.0),
    )
    df = df.withColumns(
        {
            "rs_composite": composite,
            "stage": _stage(),
            "trend_template": stack & rising & (close >= C("high52") * 0.75)
            & (close >= C("low52") * 1.25),
            "distance_52w_high": ratio("close", "high52") - 1.0,
            "distance_52w_low": ratio("close", "low52") - 1.0,
            "above_sma20": close > C("sma20"),
            "above_sma50": close > C("sma50"),
            "above_sma200": close > C("sma200"),
            "distance_to_pivot": ratio("close", "pivot") - 1.0,
            # a rolling maximum needs ten known values, so mixed up/down stretches give NULL
            "pocket_pivot": F.coalesce(
                (C("ret_1d") > 0) & (close > C("sma50")) & (C("_n_dv") >= 10)
                & (C("volume") > C("_max_dv")), F.lit(False)),
            "rs_line_new_high": F.coalesce(
                (C("_rs_n") >= 127) & (C("_ratio") >= C("_rs_prior")), F.lit(False)),
            "_checks": sum(
                (c.cast("int") for c in (
                    (close > C("sma150")) & (close > C("sma200")),
                    C("sma150") > C("sma200"),
                    rising,
                    (C("sma50") > C("sma150")) & (C("sma50") > C("sma200")),
                    close > C("sma50"),
                    close >= C("low52") * 1.30,
                    close >= C("high52") * 0.75,
                )), F.lit(0)),
        }
    )
    df = df.withColumns(
        {
            "breakout": F.coalesce(
                (close > C("pivot")) & (C("volume_ratio") >= cfg.volume_surge), F.lit(False)),
            "near_breakout": F.coalesce(
                (C("distance_to_pivot") >= -cfg.near_breakout) & (C("distance_to_pivot") <= 0),
                F.lit(False)),
        }
    )
    keep = (C("history") >= cfg.minimum_history) & C("rs_composite").isNotNull()
    return df.where(keep).drop("_ratio", "_max_dv", "_n_dv", "_v20", "_rs_prior", "_rs_n",
                               *[c for c in df.columns if c.startswith("_lag")])


def rate(records: DataFrame) -> DataFrame:
    """1-99 rating from the same-date percentile of the composite return."""
    df = with_ranks(records, ["date"], "rs_composite", {"_pct": "pct"})
    rating = F.least(F.greatest(F.bround(C("_pct") * 98 + 1, 0), F.lit(1.0)), F.lit(99.0))
    return df.withColumn("rs_rating", rating).withColumn(
        "trend_checks", C("_checks") + (C("rs_rating") >= 70).cast("int")
    ).drop("_pct", "_checks")


def strength_snapshot(
    bars: DataFrame, bench: DataFrame, universe: DataFrame, cfg: StrengthConfig | None = None
) -> DataFrame:
    """Ratings at the common as-of date with those of 5 and 20 benchmark sessions before.

    ``bars`` and ``bench`` are read several times: give stored tables.
    """
    cfg = cfg or StrengthConfig()
    as_of = common_as_of(bars, bench, cfg)
    one = Window.partitionBy("_k").orderBy(C("date").desc())
    picks = (
        with_row(bench.select("date").distinct(), as_of).withColumn("_k", F.lit(0))
        .where(C("date") <= C("as_of"))
        .withColumn("_back", F.row_number().over(one) - 1)
        .where(C("_back").isin(*BACK)).select("date", "_back")
    )
    # three dates of records: ranked and read by two branches, so each step is written once
    records = strength_records(bars, bench, cfg, stage(picks, "as-of"))
    rated = stage(rate(stage(records, "strength")), "rated")
    now = rated.where(C("_back") == 0).drop("_back")
    prior = rated.where(C("_back") > 0).groupBy("symbol").agg(
        F.max(F.when(C("_back") == 5, C("rs_rating"))).alias("rs_rating_5d_ago"),
        F.max(F.when(C("_back") == 5, C("stage"))).alias("stage_5d_ago"),
        F.max(F.when(C("_back") == 20, C("rs_rating"))).alias("rs_rating_20d_ago"),
    )
    meta = universe.select("symbol", "company", "sector")
    return (
        now.drop("sector", "company").join(prior, "symbol", "left").join(meta, "symbol", "left")
        .withColumns(
            {
                "company": F.coalesce("company", "symbol"),
                "sector": F.coalesce("sector", F.lit("Unknown")),
                "rs_change_5d": C("rs_rating") - C("rs_rating_5d_ago"),
                "rs_change_20d": C("rs_rating") - C("rs_rating_20d_ago"),
            }
        )
    )


def ready_scans() -> dict[str, Column]:
    """The twelve named predicates over a snapshot."""
    surge = (C("volume_ratio") >= 1.5) & (C("ret_1d") > 0)
    return {
        "RS Leaders": C("rs_rating") >= 90,
        "Stage 2 Leaders": (C("stage") == "Stage 2") & (C("rs_rating") >= 70),
        "Trend Template Leaders": F.coalesce(C("trend_template"), F.lit(False)),
        "Just Entered Stage 2": (C("stage") == "Stage 2")
        & F.coalesce(C("stage_5d_ago") != "Stage 2", F.lit(True)),
        "RS Line New Highs": C("rs_line_new_high"),
        "Near 52-Week High": C("distance_52w_high") >= -0.05,
        "Near Breakout": C("near_breakout"),
        "Confirmed Breakout": C("breakout"),
        "Pocket Pivot": C("pocket_pivot"),
        "Volume Surge": surge,
        "Strong in Weak Market": (C("rs_rating") >= 85) & (C("ret_1m") > 0),
        "Laggards": (C("rs_rating") <= 20) & (C("stage") == "Stage 4"),
    }


def apply_scan(snapshot: DataFrame, name: str) -> DataFrame:
    scans = ready_scans()
    if name not in scans:
        raise ValueError(f"unknown scan {name!r}")
    return snapshot.where(scans[name])


def all_scans(snapshot: DataFrame) -> DataFrame:
    """(scan, symbol) rows of every scan in one pass over the snapshot."""
    hits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in ready_scans().items()]))
    return snapshot.select(F.explode(hits).alias("scan"), "symbol", "rs_rating", "rs_composite")


def breakout_candidates(snapshot: DataFrame) -> DataFrame:
    """One row per candidate with all its setup labels joined."""
    setups = F.array_compact(F.array(
        F.when(C("breakout"), F.lit("Confirmed breakout")),
        F.when(C("near_breakout"), F.lit("Near breakout")),
        F.when(C("pocket_pivot"), F.lit("Pocket pivot")),
        F.when((C("volume_ratio") >= 1.5) & (C("ret_1d") > 0), F.lit("Volume surge")),
    ))
    return (
        snapshot.withColumn("_s", setups).where(F.size("_s") > 0)
        .withColumn("setup", F.array_join("_s", " · ")).drop("_s")
        .orderBy(C("breakout").desc(), C("near_breakout").desc(), C("rs_rating").desc(),
                 C("volume_ratio").desc(), "symbol")
    )


def snapshot_breadth(snapshot: DataFrame) -> DataFrame:
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double")) * 100
    return snapshot.agg(
        F.count(F.lit(1)).alias("eligible_stocks"),
        share(C("above_sma20")).alias("above_sma20_pct"),
        share(C("above_sma50")).alias("above_sma50_pct"),
        share(C("above_sma200")).alias("above_sma200_pct"),
        share(C("ret_1d") > 0).alias("advancing_pct"),
        share(C("stage") == "Stage 2").alias("stage2_pct"),
        share(C("distance_52w_high") >= -0.05).alias("near_high_pct"),
    )


def participation_regime(bench: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Regime label of the as-of date from benchmark trend and the breadth share."""
    z = Series("_k", "date")
    b = bench.withColumn("_k", F.lit(0))
    b = b.withColumns({"s50": z.mean("close", 50), "s200": z.mean("close", 200)})
    day = snapshot.agg(F.max("date").alias("date"))
    row = with_row(b.join(day, "date", "left_semi"), snapshot_breadth(snapshot))
    c, a, l, x = C("close"), C("s50"), C("s200"), C("above_sma50_pct")
    return row.withColumn(
        "market_regime",
        F.when((c > a) & (a > l) & (x >= 55), "BULLISH PARTICIPATION")
        .when((c < a) & (a < l) & (x <= 40), "BEARISH PARTICIPATION")
        .when((c > l) & (x < 45), "NARROW / CAUTIOUS")
        .otherwise("SIDEWAYS / MIXED"),
    ).drop("_k")


def sector_summary(snapshot: DataFrame) -> DataFrame:
    """Per-sector rating statistics; medians come from the distributed quantile operator."""
    stats = snapshot.groupBy("sector").agg(
        F.count(F.lit(1)).alias("stocks"),
        F.avg("rs_rating").alias("sector_rs"),
        (F.avg(C("above_sma50").cast("double")) * 100).alias("breadth50"),
        (F.avg((C("stage") == "Stage 2").cast("double")) * 100).alias("stage2_pct"),
        F.sum((C("rs_rating") >= 80).cast("int")).alias("leaders"),
        F.max(F.struct("rs_rating", "rs_composite", "symbol"))["symbol"].alias("top_stock"),
    )
    for src, out in (("rs_rating", "median_rs"), ("ret_1m", "median_1m"), ("rs_change_20d", "rs_momentum")):
        stats = stats.join(quantiles(snapshot, ["sector"], src, {out: 0.5}), "sector", "left")
    return stats


def watchlist_alerts(snapshot: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Alert rows of watched symbols."""
    def alert(cond, name, severity, value):
        return F.when(cond, F.struct(F.lit(name).alias("alert"), F.lit(severity).alias("severity"),
                                     value.cast("double").alias("value")))
    alerts = F.array_compact(F.array(
        alert(C("rs_rating") >= 90, "RS leader", "Positive", C("rs_rating")),
        alert(C("near_breakout"), "Near breakout", "Watch", C("distance_to_pivot")),
        alert(C("breakout"), "Price-volume breakout", "Positive", C("volume_ratio")),
        alert(C("rs_change_5d") <= -15, "RS deterioration", "Caution", C("rs_change_5d")),
    ))
    watched = snapshot.join(watchlist.select("symbol"), "symbol", "left_semi")
    return watched.select("symbol", F.explode(alerts).alias("a")).select("symbol", "a.*")


def rebased_comparison(bars: DataFrame, sessions: int = 126) -> DataFrame:
    """Last ``sessions`` closes of each symbol, rebased to 100 at the first of them."""
    w = Window.partitionBy("symbol")
    tail = bars.where(C("close").isNotNull()).withColumn(
        "_rev", F.count(F.lit(1)).over(w) - S.position()
    ).where(C("_rev") < sessions)
    return tail.withColumn(
        "normalized", ratio("close", F.first("close").over(S.w)) * 100
    ).drop("_rev")
