"""Same-date comparisons: percentiles, buckets, top-k and rank correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.rolling import ratio
from barloom.operators.order_stats import quantile_bucket, with_percentiles, with_ranks, with_row_number

C = F.col


def rebalance_dates(dates: DataFrame, frequency: str = "monthly") -> DataFrame:
    """Last session of every month or Friday-ended week (Saturday opens the next week)."""
    if frequency == "weekly":
        period = F.next_day(F.date_sub("date", 1), "FRI")
    else:
        period = F.last_day("date")
    return (
        dates.select("date").distinct().groupBy(period.alias("_period"))
        .agg(F.max("date").alias("date")).drop("_period")
    )


def date_percentile(df: DataFrame, value: str, out: str, default: float | None = None) -> DataFrame:
    """Average-tie percentile rank among the non-null values of a date."""
    df = with_ranks(df, ["date"], value, {out: "pct"})
    return df if default is None else df.withColumn(out, F.coalesce(C(out), F.lit(default)))


def date_buckets(df: DataFrame, value: str, q: int, out: str = "quantile") -> DataFrame:
    """Equal-frequency bucket 1..q per date; NULL on dates with fewer than q distinct values."""
    distinct = df.groupBy("date", value).agg(F.count(F.lit(1)))
    distinct = distinct.where(C(value).isNotNull()).groupBy("date").agg(
        F.count(F.lit(1)).alias("_distinct")
    )
    placed = with_row_number(df, ["date"], value, ["symbol"], out="_pos", total="_tot")
    return placed.join(distinct, "date").withColumn(
        out, F.when(C("_distinct") >= q, quantile_bucket(C("_pos"), C("_tot"), q))
    ).drop("_pos", "_tot", "_distinct")


def top_n(
    df: DataFrame, by: Sequence[str], score: str, n: int, ties: Sequence[str] = ("symbol",),
    *, lowest: bool = False, out: str = "rank",
) -> DataFrame:
    """First ``n`` rows per group. The literal limit lets Spark prune each partition before
    the exchange (window group limit), so a hot group never reaches one task whole."""
    order = C(score).asc() if lowest else C(score).desc()
    w = Window.partitionBy(*by).orderBy(order, *ties)
    return df.where(C(score).isNotNull()).withColumn(out, F.row_number().over(w)).where(C(out) <= n)


def top_fraction(df: DataFrame, by: Sequence[str], score: str, fraction: float) -> DataFrame:
    """Top ``ceil(n * fraction)`` rows of each group, at least one."""
    placed = with_row_number(df, by, score, ["symbol"], descending=True)
    keep = F.greatest(F.lit(1), F.ceil(C("group_rows") * F.lit(float(fraction))))
    return placed.where(C("position") <= keep)


def top_percentile(df: DataFrame, value: str, fraction: float) -> DataFrame:
    """Rows whose same-date percentile reaches ``1 - fraction``."""
    return date_percentile(df, value, "_pct").where(C("_pct") >= 1.0 - fraction).drop("_pct")


def rank_ic(
    df: DataFrame, score: str, outcome: str, by: Sequence[str] = ("date",),
    *, min_rows: int = 5, min_distinct: int = 2,
) -> DataFrame:
    """Spearman correlation per group: average ranks first, then one partial-aggregable corr."""
    by = list(by)
    both = df.where(C(score).isNotNull() & C(outcome).isNotNull())
    ranked = with_percentiles(both.select(*by, score, outcome), by, {"_rs": score, "_ro": outcome})
    return (
        ranked.groupBy(*by)
        .agg(
            F.corr("_rs", "_ro").alias("ic"),
            F.count(F.lit(1)).alias("stocks"),
            F.min("_rs").alias("_lo"),
            F.max("_rs").alias("_hi"),
        )
        .where((C("stocks") >= min_rows))
        .where((C("_hi") > C("_lo")) if min_distinct > 1 else F.lit(True))
        .where(C("ic").isNotNull() & ~F.isnan("ic"))
        .drop("_lo", "_hi")
    )


def summarize_ic(ic: DataFrame, groups: Sequence[str]) -> DataFrame:
    return ic.groupBy(*groups).agg(
        F.avg("ic").alias("mean_ic"),
        F.stddev_samp("ic").alias("ic_std"),
        F.count("ic").alias("periods"),
        F.avg((C("ic") > 0).cast("double")).alias("positive_ic_pct"),
    ).withColumn("ic_ir", ratio("mean_ic", "ic_std"))


def ic_verdict(summary: DataFrame, min_mean: float = 0.02, min_positive: float = 0.55) -> DataFrame:
    ok = (C("mean_ic") >= min_mean) & (C("positive_ic_pct") >= min_positive)
    return summary.withColumn("verdict", F.when(ok, "PASS").otherwise("FAIL"))


def benchmark_regime(bench: DataFrame, band: float = 0.02) -> DataFrame:
    """bull / bear / sideways from the close against its 200-row mean."""
    from barloom.functions.rolling import Series

    z = Series("_series", "date")
    df = bench.withColumn("_series", F.lit(0)).withColumn("_s200", z.mean("close", 200))
    return df.select(
        "date",
        F.when(C("close") > C("_s200") * (1 + band), "bull")
        .when(C("close") < C("_s200") * (1 - band), "bear")
        .otherwise("sideways")
        .alias("regime"),
    )


def bucket_returns(sample: DataFrame, horizons: Sequence[int], q: int) -> DataFrame:
    """Mean, median and count of forward returns per (horizon, bucket) plus top minus bottom."""
    from barloom.operators.order_stats import quantiles

    stacked = sample.where(C("quantile").isNotNull() & C("score").isNotNull()).select(
        "quantile",
        F.explode(
            F.array(*[
                F.struct(F.lit(h).alias("horizon"), C(f"forward_return_{h}d").alias("r"))
                for h in horizons
            ])
        ).alias("o"),
    ).select("quantile", "o.horizon", "o.r").where(C("r").isNotNull())
    stats = stacked.groupBy("horizon", "quantile").agg(
        F.avg("r").alias("mean_forward_return"), F.count("r").alias("observations")
    )
    med = quantiles(stacked, ["horizon", "quantile"], "r", {"median_forward_return": 0.5})
    table = stats.join(med, ["horizon", "quantile"]).withColumn("quantile", C("quantile").cast("string"))
    mean = lambda k: F.max(
        F.when(C("quantile") == str(k), C("mean_forward_return"))
    )
    spread = table.groupBy("horizon").agg(
        F.lit("top_minus_bottom").alias("quantile"),
        (mean(q) - mean(1)).alias("mean_forward_return"),
        F.sum("observations").alias("observations"),
        F.lit(None).cast("double").alias("median_forward_return"),
    )
    return table.unionByName(spread)


def daily_top_k(df: DataFrame, score: str, target: str, excess: str, ks: Sequence[int]) -> DataFrame:
    """Precision, recall and coverage of the k best rows of every date, for several k.

    Only the ``max(ks)`` best rows of a date are windowed; each k is a condition on their rank.
    """
    per_date = df.groupBy("date").agg(
        F.count(F.lit(1)).alias("eligible"), F.sum(target).alias("winners")
    )
    best = top_n(df, ["date"], score, max(ks))
    aggs = []
    for k in ks:
        inside = C("rank") <= k
        aggs += [
            F.sum(F.when(inside, C(target)).otherwise(0)).alias(f"hits_{k}"),
            F.count(F.when(inside, F.lit(1))).alias(f"sel_{k}"),
            F.avg(F.when(inside, C(excess))).alias(f"avg_{k}"),
            F.percentile(F.when(inside, C(excess)), 0.5).alias(f"med_{k}"),
            F.avg(F.when(inside, (C(excess) > 0).cast("double"))).alias(f"win_{k}"),
        ]
    wide = best.groupBy("date").agg(*aggs).join(per_date, "date")
    packed = F.array(*[
        F.struct(
            F.lit(k).alias("k"), C(f"hits_{k}").alias("hits"), C(f"sel_{k}").alias("selections"),
            C(f"avg_{k}").alias("average_excess"), C(f"med_{k}").alias("median_excess"),
            C(f"win_{k}").alias("win_rate"),
        )
        for k in ks
    ])
    return wide.select("date", "eligible", "winners", F.explode(packed).alias("o")).select(
        "date", "eligible", "winners", "o.*"
    ).withColumns(
        {
            "precision_at_k": C("hits") / C("k"),
            "recall_at_k": ratio("hits", "winners"),
            "covered": (C("hits") > 0).cast("double"),
        }
    )


def summarize_top_k(daily: DataFrame) -> DataFrame:
    return daily.groupBy("k").agg(
        F.count(F.lit(1)).alias("dates"),
        F.sum((C("winners") == 0).cast("int")).alias("zero_winner_dates"),
        F.sum("selections").alias("total_selections"),
        F.avg("precision_at_k").alias("precision_at_k"),
        F.avg("recall_at_k").alias("recall_at_k"),
        F.avg("covered").alias("winner_coverage"),
        F.avg("average_excess").alias("average_excess"),
        F.percentile("median_excess", 0.5).alias("median_excess"),
        F.avg("win_rate").alias("win_rate"),
        F.sum("winners").alias("actual_winners"),
    )
