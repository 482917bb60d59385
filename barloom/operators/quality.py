"""Normalisation, tradability flags and data-quality reports of bar feeds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.frames import with_row
from barloom.functions.rolling import Series, ratio
from barloom.operators.order_stats import WIDE_GROUPS, quantiles

C = F.col
S = Series("symbol", "date")
PRICES = ("open", "high", "low", "close")

# fixed aliases: adjusted columns first, plain ones after
BAR_ALIASES = {
    "date": ("date", "Date"),
    "open": ("adj_open", "adj_Open", "open", "Open"),
    "high": ("adj_high", "adj_High", "high", "High"),
    "low": ("adj_low", "adj_Low", "low", "Low"),
    "close": ("adj_close", "adj_Close", "close", "Close"),
    "volume": ("volume", "Volume"),
}


def normalize_bars(feed: DataFrame, aliases: Mapping[str, Sequence[str]] = BAR_ALIASES) -> DataFrame:
    """Pick columns by alias, cast without raising, turn NaN into NULL, drop NULL dates."""
    have = set(feed.columns)
    out = [C("symbol")]
    for name, options in aliases.items():
        found = next((o for o in options if o in have), None)
        if found is None:
            raise ValueError(f"bar feed lacks {name}")
        kind = "date" if name == "date" else "double"
        c = C(found).try_cast(kind)
        out.append((c if kind == "date" else F.when(~F.isnan(c), c)).alias(name))
    keep = [c for c in ("seq",) if c in have]
    return feed.select(*out, *keep).where(C("date").isNotNull())


def keep_last(feed: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Last written row per key. The maximum of a struct combines map-side, so a key
    rewritten millions of times still costs one row per input partition."""
    rest = [c for c in feed.columns if c not in keys]
    order = [seq, *[c for c in rest if c != seq]]
    packed = F.max(F.struct(*order)).alias("_r")
    return feed.groupBy(*keys).agg(packed).select(*keys, *[C(f"_r.{c}").alias(c) for c in rest])


def adjust_prices(feed: DataFrame) -> DataFrame:
    """Adjusted OHLC from the adj_close / close factor."""
    factor = ratio("adj_close", "close")
    return feed.withColumns({f"adj_{c}": C(c) * factor for c in PRICES if c != "close"}).withColumn(
        "adjustment_factor", factor
    )


def combine_feeds(raw: DataFrame, adjusted: DataFrame) -> DataFrame:
    """Outer combination of a raw and an adjusted feed on (symbol, date)."""
    a = raw.select("symbol", "date", *[C(c).alias(f"raw_{c}") for c in PRICES], C("volume").alias("_rv"))
    b = adjusted.select("symbol", "date", *[C(c).alias(f"adj_{c}") for c in PRICES], C("volume").alias("_av"))
    return a.join(b, ["symbol", "date"], "full").withColumn(
        "volume", F.coalesce("_rv", "_av")
    ).drop("_rv", "_av")


def append_incremental(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cached bars plus a refetched tail; the fresh row wins on equal keys."""
    both = cached.withColumn("_seq", F.lit(0)).unionByName(fresh.withColumn("_seq", F.lit(1)))
    return keep_last(both, ["symbol", "date"], "_seq").drop("_seq")


def _invalid(missing_counts: bool) -> Column:
    o, h, lo, c = (C(x) for x in PRICES)
    bad = (h < lo) | (o > h) | (o < lo) | (c > h) | (c < lo)
    bad = bad | (o <= 0) | (h <= 0) | (lo <= 0) | (c <= 0)
    missing = o.isNull() | h.isNull() | lo.isNull() | c.isNull()
    known = F.coalesce(bad, F.lit(False))
    return missing | known if missing_counts else known


def flag_rows(feed: DataFrame, kind: str = "Stock") -> DataFrame:
    """Duplicate, zero-volume, invalid, stale and tradable flags; ``seq`` orders equal dates."""
    s = Series("symbol", ["date", "seq"])
    pc = s.lag("close")
    same = (C("open") == pc) & (C("high") == pc) & (C("low") == pc) & (C("close") == pc)
    df = feed.withColumns(
        {
            "is_duplicate_date": F.coalesce(s.lead("date") == C("date"), F.lit(False)),
            "is_zero_volume": F.coalesce(C("volume"), F.lit(0.0)) == 0,
            "is_invalid_ohlc": _invalid(True),
            "_same": F.coalesce(same, F.lit(False)),
        }
    )
    df = df.withColumn("is_stale_row", C("is_zero_volume") & C("_same")).drop("_same")
    dead = C("is_zero_volume") | C("is_stale_row") if kind == "Stock" else C("is_stale_row")
    return df.withColumn(
        "is_tradable_row", ~(C("is_duplicate_date") | C("is_invalid_ohlc") | dead)
    )


def tradability(panel: DataFrame, lookback: int = 20) -> DataFrame:
    """Traded value, its mean and the tradable flag used by the backtest."""
    o, h, lo, c = (C(x) for x in PRICES)
    ok = F.coalesce(
        (o > 0) & (h > 0) & (lo > 0) & (c > 0) & (h >= F.greatest(o, c, lo))
        & (lo <= F.least(o, c, h)), F.lit(False))
    df = panel.withColumn("traded_value", c * C("volume"))
    df = df.withColumns(
        {
            "avg_traded_value_20d": S.mean("traded_value", lookback),
            "is_zero_volume": F.coalesce(C("volume"), F.lit(0.0)) <= 0,
            "_flat": F.coalesce(S.diff("close") == 0, F.lit(False)),
        }
    )
    df = df.withColumn("is_stale", C("is_zero_volume") & C("_flat")).drop("_flat")
    return df.withColumn("is_tradable", ok & ~C("is_stale") & ~C("is_zero_volume"))


def segments(feed: DataFrame) -> DataFrame:
    """Valid bars only; every excluded bar opens a new segment."""
    o, h, lo, c, v = (C(x) for x in (*PRICES, "volume"))
    missing = o.isNull() | h.isNull() | lo.isNull() | c.isNull() | v.isNull()
    checks = (
        (missing, "Missing/nonfinite OHLCV"),
        (F.coalesce(v <= 0, F.lit(False)), "Zero/negative volume"),
        (F.coalesce((o <= 0) | (h <= 0) | (lo <= 0) | (c <= 0), F.lit(False)), "Nonpositive price"),
        (F.coalesce((h < F.greatest(o, c)) | (lo > F.least(o, c)), F.lit(False)), "Invalid OHLC relationships"),
    )
    reasons = F.array_compact(F.array(*[F.when(k, F.lit(t)) for k, t in checks]))
    df = feed.withColumn("reasons", F.array_join(reasons, "; "))
    df = df.withColumn("invalid", C("reasons") != "")
    return df.withColumn("segment", F.sum(C("invalid").cast("int")).over(S.w))


def move_bucket(r: Column) -> Column:
    a = F.abs(r)
    return F.when(a > 0.50, ">50%").when(a > 0.30, ">30%").otherwise(">20%")


def extreme_moves(clean: DataFrame, limit: float = 0.20) -> DataFrame:
    """One-row moves above ``limit`` with a bucket and a heuristic class."""
    df = clean.withColumn("daily_return", S.change("close"))
    df = df.withColumn("_vol", S.std("daily_return", 60))
    size = F.abs(C("daily_return"))
    wild = F.coalesce((C("_vol") > 0) & (size > 8 * C("_vol")), F.lit(False))
    return df.where(size > limit).withColumns(
        {
            "bucket": move_bucket(C("daily_return")),
            "classification": F.when((size > 0.50) | wild, "suspicious/bad data")
            .when(F.coalesce(C("volume"), F.lit(0.0)) == 0, "likely corporate-action artifact")
            .otherwise("plausible real market move"),
        }
    ).drop("_vol")


def quality_report(flagged: DataFrame) -> DataFrame:
    """Per-symbol counts, extremes and the PASS / REVIEW / FAIL ladder."""
    clean = flagged.where(C("is_tradable_row")).withColumn("_r", S.change("close"))
    moves = clean.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("clean_rows"),
        F.max("_r").alias("max_return"),
        F.min("_r").alias("min_return"),
        *[F.count(F.when(F.abs("_r") > k / 100, 1)).alias(f"moves_gt_{k}") for k in (20, 30, 50)],
        F.percentile(C("close") * C("volume"), 0.5).alias("median_turnover"),
        F.percentile(C("close") * C("volume"), 0.1).alias("p10_turnover"),
    )
    n = lambda c: F.count(F.when(C(c), 1)).alias(c.removeprefix("is_") + "s")
    missing = sum((F.avg(C(c).isNull().cast("double")) for c in PRICES), F.lit(0.0)) / 4
    base = flagged.groupBy("symbol").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count(F.lit(1)).alias("raw_rows"), n("is_zero_volume"), n("is_stale_row"),
        n("is_duplicate_date"), n("is_invalid_ohlc"), missing.alias("missing_pct"),
    )
    df = base.join(moves, "symbol", "left").fillna(
        0, ["clean_rows", "moves_gt_20", "moves_gt_30", "moves_gt_50"]
    ).withColumn("rows_removed", C("raw_rows") - C("clean_rows"))
    return df.withColumn(
        "status",
        F.when((C("clean_rows") < 252) | (C("missing_pct") > 0.05), "FAIL")
        .when((C("moves_gt_50") > 0) | (C("moves_gt_20") > 0) | (C("rows_removed") > 10)
              | (C("invalid_ohlcs") > 2), "REVIEW")
        .otherwise("PASS"),
    )


def calendar_alignment(panel: DataFrame, bench_dates: DataFrame) -> DataFrame:
    """Missing and extra sessions of each symbol against the benchmark calendar."""
    cal = bench_dates.select("date").distinct()
    total = cal.agg(F.count(F.lit(1)).alias("_total"))
    rows = panel.select("symbol", "date").distinct().join(
        cal.withColumn("_in", F.lit(1)), "date", "left"
    )
    per = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.count("_in").alias("_shared")
    )
    return with_row(per, total).select(
        "symbol", "rows",
        (C("_total") - C("_shared")).alias("missing_dates"),
        (C("rows") - C("_shared")).alias("extra_dates"),
        (C("_shared") / C("_total")).alias("coverage"),
    )


def unpivot(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(features), "feature", "value")


def feature_quality(long: DataFrame) -> DataFrame:
    """Missing share, moments, exact quantiles and outlier counts per feature (id rows unpivoted).

    Features are a fixed list, so their statistics are broadcast: a join on a few keys would make a task of each feature.
    """
    probs = {"p01": 0.01, "p05": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95, "p99": 0.99}
    moments = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(C("value").isNull().cast("double")).alias("missing_pct"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
    )
    stats = moments.join(quantiles(long, ["feature"], "value", probs, per_efold=WIDE_GROUPS), "feature", "left")
    iqr = C("q3") - C("q1")
    v = C("value")
    outliers = long.join(F.broadcast(stats), "feature").groupBy("feature").agg(
        F.count(F.when((iqr > 0) & ((v < C("q1") - 3 * iqr) | (v > C("q3") + 3 * iqr)), 1)).alias("iqr_outliers"),
        F.count(F.when((C("std") > 0) & (F.abs(v - C("mean")) > 5 * C("std")), 1)).alias("z_outliers"),
    )
    return stats.join(outliers, "feature")


def drift_report(long: DataFrame) -> DataFrame:
    """``long``: feature, value, split in train / validation / final_test."""
    splits = ("train", "validation", "final_test")
    per = long.groupBy("feature", "split").agg(
        F.avg("value").alias("mean"), F.avg(C("value").isNull().cast("double")).alias("missing")
    ).join(quantiles(long, ["feature", "split"], "value", {"median": 0.5}, per_efold=WIDE_GROUPS), ["feature", "split"], "left")
    wide = per.groupBy("feature").agg(*[
        F.max(F.when(C("split") == s, C(m))).alias(f"{s}_{m}")
        for s in splits for m in ("mean", "median", "missing")
    ])
    pooled = long.groupBy("feature").agg(F.stddev_samp("value").alias("_sd"))
    df = wide.join(pooled, "feature")
    for s in splits[1:]:
        df = df.withColumn(f"{s}_shift", ratio(C(f"{s}_mean") - C("train_mean"), "_sd"))
    return df.withColumn(
        "max_abs_shift",
        F.greatest(*[F.coalesce(F.abs(C(f"{s}_shift")), F.lit(0.0)) for s in splits[1:]]),
    ).drop("_sd")


def scoped(df: DataFrame, scopes: Mapping[str, Column | None]) -> DataFrame:
    """Repeat each row once per scope with (scope, scope_value); the list of scopes is fixed."""
    items = [
        F.struct(F.lit(n).alias("scope"), (F.lit("all") if c is None else c.cast("string")).alias("scope_value"))
        for n, c in scopes.items()
    ]
    return df.withColumn("_s", F.explode(F.array(*items))).withColumns(
        {"scope": C("_s.scope"), "scope_value": C("_s.scope_value")}
    ).drop("_s")


def label_distribution(labelled: DataFrame, scopes: Mapping[str, Column | None]) -> DataFrame:
    x = scoped(labelled, scopes)
    share = lambda k: F.avg((C("label") == k).cast("double"))
    stats = x.groupBy("scope", "scope_value").agg(
        F.count(F.lit(1)).alias("rows"), share(1).alias("outperform_pct"),
        share(0).alias("neutral_pct"), share(-1).alias("underperform_pct"),
        F.avg("excess_return").alias("mean_excess"),
    )
    med = quantiles(x, ["scope", "scope_value"], "excess_return", {"median_excess": 0.5}, per_efold=WIDE_GROUPS)
    return stats.join(med, ["scope", "scope_value"], "left")


def retained_anomalies(flagged: DataFrame, dataset: DataFrame) -> DataFrame:
    """Flagged rows per symbol and how many of them are still in the dataset."""
    bad = flagged.where(C("is_stale_row") | C("is_invalid_ohlc") | C("is_zero_volume"))
    bad = bad.select("symbol", "date", "is_stale_row").dropDuplicates(["symbol", "date"])
    kept = dataset.select("symbol", "date", F.lit(1).alias("_kept"))
    per = bad.join(kept, ["symbol", "date"], "left").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("flagged_rows"),
        F.count(F.when(C("is_stale_row"), 1)).alias("stale_rows"),
        F.count("_kept").alias("retained_rows"),
    )
    return per.withColumn(
        "status", F.when(C("retained_rows") > 0, "REVIEW_RETAINED")
        .when(C("stale_rows") > 0, "EXCLUDED_STALE").otherwise("EXCLUDED"),
    )


def exclude_event_windows(panel: DataFrame, events: DataFrame) -> DataFrame:
    """Drop rows inside a contaminated (symbol, start, end) window."""
    ev = events.groupBy("symbol").agg(F.collect_set(F.struct("start", "end")).alias("_ev"))
    hit = F.exists("_ev", lambda e: (C("date") >= e["start"]) & (C("date") <= e["end"]))
    return panel.join(ev, "symbol", "left").where(
        ~F.coalesce(hit, F.lit(False))
    ).drop("_ev")


def within_date_variance(long: DataFrame) -> DataFrame:
    """Average same-date variance per feature; market-wide features must be flat on a date."""
    per = long.groupBy("date", "feature").agg(
        F.var_samp("value").alias("_v"), F.min("value").alias("_lo"), F.max("value").alias("_hi")
    )
    return per.groupBy("feature").agg(
        F.avg("_v").alias("mean_variance"),
        F.avg((C("_hi") > C("_lo")).cast("double")).alias("varying_dates_pct"),
    ).withColumn("is_flat", C("varying_dates_pct") == 0)
