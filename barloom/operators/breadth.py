"""Market breadth with per-metric denominators on actual benchmark sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.frames import with_row
from barloom.functions.rolling import Series, known_flag, ratio

C = F.col
EPS = 1e-10


def calendar(bench: DataFrame) -> DataFrame:
    """Numbered sessions of the benchmark: one row per date."""
    one = Window.partitionBy(F.lit(0)).orderBy("date")
    return bench.where(C("close") > 0).select("date").distinct().withColumn(
        "session", F.row_number().over(one)
    )


def valid_bar():
    o, h, lo, c = C("open"), C("high"), C("low"), C("close")
    ok = (
        (o > 0) & (h > 0) & (lo > 0) & (c > 0)
        & (h >= F.greatest(o, lo, c)) & (lo <= F.least(o, h, c)) & (C("volume") > 0)
    )
    return F.coalesce(ok, F.lit(False))


def breadth_panel(bars: DataFrame, bench: DataFrame, breaks: DataFrame | None = None) -> DataFrame:
    """Per-symbol breadth states. A missing session leaves every window that spans it unknown.

    Range frames over the session number stand in for a dense dates x symbols grid,
    so absent bars cost nothing. ``breaks`` (symbol, event_date) starts new segments.
    """
    df = bars.join(calendar(bench), "date")
    if breaks is None:
        df = df.withColumn("segment", F.lit(0))
    else:
        ev = breaks.groupBy("symbol").agg(F.collect_set("event_date").alias("_ev"))
        df = df.join(ev, "symbol", "left").withColumn(
            "segment",
            F.coalesce(F.size(F.filter("_ev", lambda e: e <= C("date"))), F.lit(0)),
        ).drop("_ev")
    df = df.withColumn("tradable", valid_bar())
    df = df.withColumns({f"_{c}": F.when(C("tradable"), C(c)) for c in ("close", "high", "low")})
    w = Window.partitionBy("symbol", "segment").orderBy("session")

    def over(fn, c, n, end=0):
        f = w.rangeBetween(end - n + 1, end)
        return F.when(F.count(c).over(f) == n, fn(c).over(f))

    df = df.withColumns(
        {
            "daily_return": ratio("_close", F.max("_close").over(w.rangeBetween(-1, -1))) - 1.0,
            "_lag20": F.max("_close").over(w.rangeBetween(-20, -20)),
            "_n21": F.count("_close").over(w.rangeBetween(-20, 0)),
            "_ph": over(F.max, "_high", 252, -1),
            "_pl": over(F.min, "_low", 252, -1),
            **{f"_s{n}": over(F.avg, "_close", n) for n in (20, 50, 200)},
        }
    )
    r = C("daily_return")
    df = df.withColumns(
        {
            "advance": F.coalesce(r > EPS, F.lit(False)).cast("int"),
            "decline": F.coalesce(r < -EPS, F.lit(False)).cast("int"),
            "unchanged": F.coalesce(F.abs(r) <= EPS, F.lit(False)).cast("int"),
            "advancing_volume": F.when(r > EPS, C("volume")).otherwise(0.0),
            "declining_volume": F.when(r < -EPS, C("volume")).otherwise(0.0),
            "positive_20d": F.when(C("_n21") == 21, known_flag(C("_close") > C("_lag20"))),
            "new_high": known_flag(C("_high") >= C("_ph")),
            "new_low": known_flag(C("_low") <= C("_pl")),
            **{f"above_sma{n}": known_flag(C("_close") > C(f"_s{n}")) for n in (20, 50, 200)},
        }
    )
    return df


def _metrics():
    out = [
        F.count("close").alias("observed"),
        F.sum(C("tradable").cast("int")).alias("eligible"),
        F.sum("advance").alias("advancers"),
        F.sum("decline").alias("decliners"),
        F.sum("unchanged").alias("unchanged"),
        F.count("daily_return").alias("ad_eligible"),
        F.sum("advancing_volume").alias("advancing_volume"),
        F.sum("declining_volume").alias("declining_volume"),
        F.avg("positive_20d").alias("_p20"),
    ]
    for n in (20, 50, 200):
        out += [
            F.count(f"above_sma{n}").alias(f"sma{n}_eligible"),
            (F.avg(f"above_sma{n}") * 100).alias(f"above_sma{n}_pct"),
        ]
    for c in ("positive_20d", "new_high", "new_low"):
        out += [F.count(c).alias(f"{c}_eligible"), F.sum(c).alias(f"{c}_count")]
    return out


def _derived(df: DataFrame) -> DataFrame:
    volume = C("advancing_volume") + C("declining_volume")
    return df.withColumns(
        {
            "coverage_pct": ratio("eligible", "requested") * 100,
            "positive_20d_pct": C("_p20") * 100,
            "advancing_pct": ratio("advancers", "ad_eligible") * 100,
            "ad_ratio": ratio("advancers", "decliners"),
            "net_advances": C("advancers") - C("decliners"),
            "up_volume_pct": ratio("advancing_volume", volume) * 100,
        }
    ).drop("_p20")


def breadth_levels(panel: DataFrame, universe: DataFrame) -> DataFrame:
    """Metrics per date (sector NULL) and per (date, sector) in one GROUPING SETS pass."""
    members = universe.select("symbol", F.coalesce("sector", F.lit("Unclassified")).alias("sector"))
    members = members.dropDuplicates(["symbol"])
    rows = panel.drop("sector").join(members, "symbol")
    both = rows.groupingSets([["date"], ["date", "sector"]], "date", "sector").agg(
        F.grouping("sector").alias("is_market"), *_metrics()
    )
    requested = members.groupingSets([[], ["sector"]], "sector").agg(
        F.grouping("sector").alias("is_market"), F.count(F.lit(1)).alias("requested")
    )
    key = F.coalesce(C("sector"), F.lit("*"))
    out = both.withColumn("_k", key).join(
        requested.select(key.alias("_k"), "is_market", "requested"), ["_k", "is_market"]
    )
    return _derived(out.drop("_k"))


def breadth_timeline(levels: DataFrame, min_coverage: float = 0.60) -> DataFrame:
    """Market level with the A/D line, which restarts after unreliable sessions."""
    t = levels.where(C("is_market") == 1).drop("sector", "is_market").withColumn("_s", F.lit(0))
    z = Series("_s", "date")
    t = t.withColumn("reliable", ratio("ad_eligible", "requested") >= min_coverage)
    t = t.withColumn("_island", F.sum((~C("reliable")).cast("int")).over(z.w))
    line = F.sum(F.when(C("reliable"), C("net_advances"))).over(
        Window.partitionBy("_s", "_island").orderBy("date")
    )
    t = t.withColumn("ad_line", F.when(C("reliable"), line))
    return t.withColumns(
        {f"breadth50_change_{n}d": z.diff("above_sma50_pct", n) for n in (5, 10, 20)}
    ).drop("_s", "_island")


def sector_breadth(levels: DataFrame) -> DataFrame:
    z = Series("sector", "date")
    return levels.where(C("is_market") == 0).withColumn(
        "breadth50_change_10d", z.diff("above_sma50_pct", 10)
    )


def symbol_status(panel: DataFrame, universe: DataFrame, bench: DataFrame) -> DataFrame:
    """Latest state of every universe member; members without a bar that session are appended."""
    cal = calendar(bench)
    last = cal.agg(F.max("date").alias("date"), F.max("session").alias("_last"))
    latest = panel.join(last.select("date"), "date", "left_semi").select(
        "symbol", "daily_return", "tradable", "above_sma50"
    )
    seen = panel.groupBy("symbol").agg(
        F.max("date").alias("last_date"),
        F.sum((~C("tradable")).cast("int")).alias("excluded_rows"),
        F.count(F.lit(1)).alias("_rows"),
        F.min("session").alias("_first"),
    )
    seen = with_row(seen, last.select("_last")).withColumn(
        "missing_sessions", C("_last") - C("_first") + 1 - C("_rows")
    )
    out = universe.select("symbol", "company", "sector").join(latest, "symbol", "left")
    out = out.join(seen.drop("_rows", "_first", "_last"), "symbol", "left")
    return out.withColumn(
        "status",
        F.when(C("tradable"), "PASS").when(C("last_date").isNull(), "MISSING").otherwise("REVIEW"),
    )
