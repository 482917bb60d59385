"""Evaluation of scored, labelled rows (date, symbol, fold, score..., y, excess_return).

Medians, percentiles and prefix sums over whole selections come from ``order_stats``;
everything else is a plain aggregate with map-side combine.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.frames import with_row
from barloom.functions.rolling import Series, ratio
from barloom.operators.order_stats import (
    quantile_bucket, quantiles, value_ladder, with_percentiles, with_ranks, with_row_number,
)

C = F.col


def tag(df: DataFrame, rules: Mapping[str, Column], out: str = "rule") -> DataFrame:
    """One row per (row, rule it satisfies). Rules are a fixed list of conditions, so a row
    is copied only for the rules it passes and no threshold table is cross-joined."""
    hits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return df.withColumn(out, F.explode(hits))


def base_rate(df: DataFrame) -> DataFrame:
    return df.agg(F.avg(C("y").cast("double")).alias("base_rate"))


def selection_metrics(sel: DataFrame, by: Sequence[str], rate: DataFrame | None = None) -> DataFrame:
    """Count, precision, average / median excess, win rate and (given a base rate) lift."""
    by = list(by)
    m = sel.groupBy(*by).agg(
        F.count(F.lit(1)).alias("signals"),
        F.avg(C("y").cast("double")).alias("precision"),
        F.avg("excess_return").alias("average_excess"),
        F.avg("future_stock_return").alias("average_return"),
        F.avg((C("excess_return") > 0).cast("double")).alias("win_rate"),
    )
    med = quantiles(sel, by, "excess_return", {"median_excess": 0.5})
    m = m.join(med, by, "left")
    if rate is not None:
        m = with_row(m, rate).withColumn("lift", ratio("precision", "base_rate"))
    return m


def stability_flags(scoped: DataFrame, rule: str = "rule") -> DataFrame:
    """Per rule: worst scope, spread and number of scopes below the base rate."""
    return scoped.groupBy(rule).agg(
        F.count(F.lit(1)).alias("scopes"),
        F.min("precision").alias("worst_precision"),
        F.max("precision").alias("best_precision"),
        F.stddev_samp("precision").alias("precision_std"),
        F.count(F.when(C("precision") < C("base_rate"), 1)).alias("scopes_below_base"),
        F.count(F.when(C("average_excess") <= 0, 1)).alias("scopes_negative_excess"),
    )


def overall_top(df: DataFrame, score: str, fractions: Mapping[str, float]) -> DataFrame:
    """Rows in the top fraction of the whole set by score, tagged by fraction name."""
    ranked = with_ranks(df, [], score, {"_r": "min", "_n": "count"}, descending=True)
    rules = {n: C("_r") <= F.greatest(F.lit(1), F.ceil(C("_n") * F.lit(f))) for n, f in fractions.items()}
    return tag(ranked, rules, "top").drop("_r", "_n")


def date_concentration(sel: DataFrame, by: Sequence[str]) -> DataFrame:
    """Date-level view of a selection: every date counts once."""
    per = sel.groupBy(*by, "date").agg(
        F.count(F.lit(1)).alias("_n"), F.avg(C("y").cast("double")).alias("_p"),
        F.avg("excess_return").alias("_x"),
        F.avg((C("excess_return") > 0).cast("double")).alias("_w"),
    )
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("signal_dates"), F.avg("_n").alias("signals_per_date"),
        F.max("_n").alias("max_signals_one_date"), F.avg("_p").alias("date_precision"),
        F.avg("_x").alias("date_excess"), F.avg("_w").alias("date_win_rate"),
    )


def concentration(sel: DataFrame, by: Sequence[str], value: str, top: int = 10) -> DataFrame:
    """Distinct values, largest share, top-k share and Herfindahl index of a column."""
    by = list(by)
    n = sel.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    total = n.groupBy(*by).agg(F.sum("_c").alias("signals"), F.count(F.lit(1)).alias("distinct_values"))
    w = Window.partitionBy(*by).orderBy(C("_c").desc(), value)
    best = n.withColumn("_r", F.row_number().over(w)).where(C("_r") <= top).groupBy(*by).agg(
        F.sum("_c").alias("_top"), F.max("_c").alias("_max"),
        F.max(F.when(C("_r") == 1, C(value).cast("string"))).alias("largest_value"),
    )
    hhi = n.join(total, by).groupBy(*by).agg(F.sum(F.pow(C("_c") / C("signals"), 2)).alias("herfindahl"))
    return total.join(best, by).join(hhi, by).select(
        *by, "signals", "distinct_values", (C("_top") / C("signals")).alias("top_share"),
        (C("_max") / C("signals")).alias("largest_share"), "largest_value", "herfindahl",
    )


def probability_buckets(df: DataFrame, p: str, edges: Sequence[float]) -> DataFrame:
    """Left-closed probability bins with predicted and actual rates; empty bins are kept."""
    names = [f"{int(round(a * 100))}-{int(round(b * 100))}%" for a, b in zip(edges, edges[1:], strict=False)]
    expr = F.lit(None).cast("string")
    for i in range(len(names) - 1, -1, -1):
        hi = C(p) < edges[i + 1] if i < len(names) - 1 else C(p) <= edges[i + 1]
        expr = F.when((C(p) >= edges[i]) & hi, names[i]).otherwise(expr)
    m = df.groupBy(expr.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("predicted"),
        F.avg(C("y").cast("double")).alias("actual"), F.avg("excess_return").alias("average_excess"),
    )
    bins = df.sparkSession.createDataFrame([(n,) for n in names], "bucket string")
    return bins.join(m, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_curve(df: DataFrame, p: str, bins: int = 10) -> DataFrame:
    """Mean predicted and observed rate per quantile bin (edges from exact quantiles)."""
    probs = {f"_e{i}": i / bins for i in range(1, bins)}
    x = with_row(df, quantiles(df, [], p, probs))
    b = sum(((C(p) > C(e)).cast("int") for e in probs), F.lit(0))
    return x.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(p).alias("predicted"),
        F.avg(C("y").cast("double")).alias("observed"),
    )


def calibration_mae(curve: DataFrame) -> DataFrame:
    return curve.agg(F.avg(F.abs(C("predicted") - C("observed"))).alias("calibration_mae"))


def classification_metrics(df: DataFrame, y: str, yhat: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Binary metrics from one pass of conditional counts."""
    a, b = C(y) == 1, C(yhat) == 1
    q = F.least(F.greatest(C(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    n = lambda c: F.count(F.when(c, 1))
    m = df.groupBy(*by).agg(
        n(a & b).alias("tp"), n(~a & b).alias("fp"), n(a & ~b).alias("fn"), n(~a & ~b).alias("tn"),
        F.avg(-F.when(a, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"),
        F.avg(F.pow(C(p) - C(y), 2)).alias("brier"),
    )
    m = m.withColumns(
        {
            "accuracy": (C("tp") + C("tn")) / (C("tp") + C("fp") + C("fn") + C("tn")),
            "precision": F.coalesce(ratio("tp", C("tp") + C("fp")), F.lit(0.0)),
            "recall": F.coalesce(ratio("tp", C("tp") + C("fn")), F.lit(0.0)),
            "specificity": F.coalesce(ratio("tn", C("tn") + C("fp")), F.lit(0.0)),
        }
    )
    return m.withColumns(
        {
            "balanced_accuracy": (C("recall") + C("specificity")) / 2,
            "f1": F.coalesce(ratio(2 * C("precision") * C("recall"), C("precision") + C("recall")), F.lit(0.0)),
        }
    )


def confusion_matrix(df: DataFrame, y: str, yhat: str, labels: Sequence[int]) -> DataFrame:
    return df.groupBy(C(y).alias("actual")).agg(*[
        F.count(F.when(C(yhat) == k, 1)).alias(f"predicted_{'m' if k < 0 else ''}{abs(k)}") for k in labels
    ])


def ranking_quality(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Average precision (PR-AUC) and ROC-AUC with tied scores taken together."""
    by = list(by)
    lad = value_ladder(df, by, score, {"pos": C("y").cast("bigint")}, descending=True)
    done, hits = C("before") + C("cnt"), C("pos_before") + C("pos")
    neg_after = C("total") - C("pos_total") - (C("before") - C("pos_before")) - (C("cnt") - C("pos"))
    agg = lad.groupBy(*by).agg(
        F.sum(C("pos") * hits / done).alias("_ap"),
        F.sum(C("pos") * (neg_after + (C("cnt") - C("pos")) / 2.0)).alias("_auc"),
        F.max("pos_total").alias("positives"), F.max("total").alias("rows"),
    )
    return agg.select(
        *by, "rows", "positives", ratio("_ap", "positives").alias("pr_auc"),
        ratio("_auc", C("positives") * (C("rows") - C("positives"))).alias("roc_auc"),
    )


def prefix_frontier(df: DataFrame, score: str, levels: Sequence[float]) -> DataFrame:
    """Largest best-first prefix with precision >= level (a tie is taken whole), and its recall."""
    lad = value_ladder(df, [], score, {"pos": C("y").cast("bigint")}, descending=True)
    done, hits = C("before") + C("cnt"), C("pos_before") + C("pos")
    aggs = [
        F.max(F.when(hits / done >= lv, F.struct(done.alias("n"), hits.alias("h")))).alias(f"_{i}")
        for i, lv in enumerate(levels)
    ]
    one = lad.agg(F.max("pos_total").alias("_p"), *aggs)
    items = F.array(*[
        F.struct(F.lit(float(lv)).alias("level"), C(f"_{i}.n").alias("n"), C(f"_{i}.h").alias("hits"))
        for i, lv in enumerate(levels)
    ])
    return one.select("_p", F.explode(items).alias("o")).select(
        "o.level", F.coalesce("o.n", F.lit(0)).alias("signals"),
        ratio("o.hits", "o.n").alias("precision"), ratio("o.hits", "_p").alias("recall"),
    )


def equal_signal_rows(df: DataFrame, baseline: Column, score: str) -> DataFrame:
    """The n best rows by ``score`` where n is the number of baseline signals."""
    n = df.agg(F.count(F.when(baseline, 1)).alias("_n"))
    placed = with_row_number(df, [], score, ["symbol", "date"], descending=True)
    return with_row(placed, n).where(C("position") <= C("_n")).drop("_n")


def rank_slices(df: DataFrame, score: str, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Best-first slices of the whole set by percentile bounds."""
    placed = with_row_number(df, [], score, ["symbol", "date"], descending=True)
    n = C("group_rows")
    rules = {
        name: (C("position") > F.floor(n * F.lit(lo)))
        & (C("position") <= (n if hi == 1.0 else F.floor(n * F.lit(hi))))
        for name, (lo, hi) in bounds.items()
    }
    return tag(placed, rules, "slice")


def quantile_groups(df: DataFrame, value: str, q: int, out: str = "bucket") -> DataFrame:
    placed = with_row_number(df, [], value, ["symbol", "date"])
    return placed.withColumn(out, quantile_bucket(C("position"), C("group_rows"), q))


def monotonic(metrics: DataFrame, bucket: str, columns: Sequence[str]) -> DataFrame:
    """Whether every metric never falls from bucket to bucket (a few rows)."""
    w = Window.partitionBy(F.lit(0)).orderBy(bucket)
    falls = [F.coalesce(C(c) < F.lag(c).over(w), F.lit(False)).alias(f"_{c}") for c in columns]
    return metrics.select(*falls).agg(*[(~F.max(f"_{c}")).alias(c) for c in columns])


def membership(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer membership of two selections: BOTH, A_ONLY, B_ONLY."""
    x = a.select(*keys).distinct().withColumn("_a", F.lit(1))
    y = b.select(*keys).distinct().withColumn("_b", F.lit(1))
    return x.join(y, list(keys), "full").withColumn(
        "membership",
        F.when(C("_a").isNotNull() & C("_b").isNotNull(), "BOTH")
        .when(C("_a").isNotNull(), "A_ONLY").otherwise("B_ONLY"),
    ).drop("_a", "_b")


def diversity(df: DataFrame, a: str, b: str, top_a: Column, top_b: Column) -> DataFrame:
    """Pearson, Spearman, overlap and Jaccard of two scores on the same rows."""
    # percentile = average rank / n, which leaves a correlation of ranks unchanged
    r = with_percentiles(df, [], {"_ra": a, "_rb": b})
    return r.agg(
        F.count(F.lit(1)).alias("rows"), F.corr(a, b).alias("pearson"), F.corr("_ra", "_rb").alias("spearman"),
        F.count(F.when(top_a, 1)).alias("top_a"), F.count(F.when(top_b, 1)).alias("top_b"),
        F.count(F.when(top_a & top_b, 1)).alias("overlap"),
        F.count(F.when(top_a | top_b, 1)).alias("_union"),
    ).withColumn("jaccard", ratio("overlap", "_union")).drop("_union")


def date_winner(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Per date, which of two rules was more precise."""
    per = df.groupBy("date").agg(
        F.count(F.when(a, 1)).alias("a_signals"), F.count(F.when(b, 1)).alias("b_signals"),
        F.count(F.when(a & b, 1)).alias("overlap"),
        F.avg(F.when(a, C("y").cast("double"))).alias("a_precision"),
        F.avg(F.when(b, C("y").cast("double"))).alias("b_precision"),
    )
    pa, pb = C("a_precision"), C("b_precision")
    return per.withColumn(
        "result",
        F.when(pa.isNull() & pb.isNull(), "EQUAL").when(pa.isNull(), "B_BEATS").when(pb.isNull(), "B_LOSES")
        .when(pb > pa, "B_BEATS").when(pb < pa, "B_LOSES").otherwise("EQUAL"),
    )


def interaction(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """2x2 table of two flags with margins (CUBE)."""
    x = df.select(
        F.when(a, "high").otherwise("low").alias("a"), F.when(b, "high").otherwise("low").alias("b"),
        "y", "excess_return",
    )
    return x.cube("a", "b").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(C("y").cast("double")).alias("precision"),
        F.avg("excess_return").alias("average_excess"),
    ).select(F.coalesce("a", F.lit("all")).alias("a"), F.coalesce("b", F.lit("all")).alias("b"),
             "rows", "precision", "average_excess")


def fold_funnel(df: DataFrame, folds: DataFrame, a: Column, b: Column) -> DataFrame:
    """Rows passing A, B and both per fold; folds without rows are kept with a cause."""
    n = lambda c: F.count(F.when(c, 1))
    per = df.groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"), n(a).alias("pass_a"), n(b).alias("pass_b"), n(a & b).alias("pass_both")
    )
    out = folds.select("fold").join(per, "fold", "left").fillna(0)
    return out.withColumn(
        "cause",
        F.when(C("pass_both") > 0, "OK").when(C("rows") == 0, "NO_ROWS").when(C("pass_a") == 0, "A_EMPTY")
        .when(C("pass_b") == 0, "B_EMPTY").otherwise("NO_OVERLAP"),
    )


def fold_improvements(candidate: DataFrame, baseline: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Number of folds in which the candidate beats the baseline, per metric."""
    b = baseline.select("fold", *[C(m).alias(f"_b_{m}") for m in metrics])
    j = candidate.select("fold", *metrics).join(b, "fold")
    return j.agg(F.count(F.lit(1)).alias("folds"), *[
        F.count(F.when(C(m) > C(f"_b_{m}"), 1)).alias(f"{m}_improved") for m in metrics
    ])


def non_overlapping(sel: DataFrame, dates: DataFrame, every: int) -> DataFrame:
    """Selection restricted to every ``every``-th date of each fold (``dates``: fold, date)."""
    w = Window.partitionBy("fold").orderBy("date")
    keep = dates.distinct().withColumn("_r", F.row_number().over(w) - 1).where(C("_r") % every == 0)
    return sel.join(keep.drop("_r"), ["fold", "date"], "left_semi")


def pareto_rank(table: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """1 + number of dominating rows. The table has one row per trial of a parameter list,
    so it travels as one small array instead of a self join."""
    row = F.struct(C(key).alias("key"), *metrics)
    j = with_row(table, table.agg(F.collect_list(row).alias("_all")))

    def dominates(o):
        ge, gt = F.lit(True), F.lit(False)
        for m in metrics:
            ge, gt = ge & (o[m] >= C(m)), gt | (o[m] > C(m))
        return (o["key"] != C(key)) & ge & gt

    return j.withColumn("pareto_rank", F.size(F.filter("_all", dominates)) + 1).drop("_all")


def forecast_summary(f: DataFrame) -> DataFrame:
    """Direction, error and baseline measures per sample count."""
    pct = lambda c: F.avg(c.cast("double")) * 100
    hit = C("predicted_direction") == C("actual_direction")
    err = C("predicted_return_pct") - C("actual_return_pct")
    main = f.groupBy("sample_count").agg(
        F.count(F.lit(1)).alias("forecasts"), F.countDistinct("date").alias("unique_dates"),
        F.countDistinct("symbol").alias("stocks"), F.countDistinct("seed").alias("seeds"),
        pct(hit).alias("direction_accuracy_pct"),
        F.count(F.when(C("predicted_direction") != "SIDEWAYS", 1)).alias("up_down_calls"),
        (F.avg(F.when(C("predicted_direction") != "SIDEWAYS", hit.cast("double"))) * 100).alias("up_down_accuracy_pct"),
        F.avg(F.abs(err)).alias("return_mae_pp"), F.avg(F.abs("actual_return_pct")).alias("unchanged_mae_pp"),
        F.sqrt(F.avg(err * err)).alias("return_rmse_pp"),
        pct(C("actual_direction") == "UP").alias("always_up_pct"),
        pct(C("actual_direction") == "DOWN").alias("always_down_pct"),
    )
    recall = f.groupBy("sample_count", "actual_direction").agg(F.avg(hit.cast("double")).alias("_r"))
    balanced = recall.groupBy("sample_count").agg((F.avg("_r") * 100).alias("balanced_accuracy_pct"))
    agree = f.groupBy("sample_count", "symbol", "date").agg(
        F.min("predicted_direction").alias("_lo"), F.max("predicted_direction").alias("_hi")
    ).groupBy("sample_count").agg(pct(C("_lo") == C("_hi")).alias("same_direction_pct"))
    return main.join(balanced, "sample_count").join(agree, "sample_count")


def direction(value: Column, band: Column | float) -> Column:
    return F.when(value > band, "UP").when(value < -band, "DOWN").otherwise("SIDEWAYS")


def signal_samples(df: DataFrame, signals: Mapping[str, Column], cost: float, by: Sequence[str] = ()) -> DataFrame:
    """Net-return statistics per experiment."""
    x = tag(df, signals, "experiment").withColumn("net", C("future_stock_return") - cost)
    keys = [*by, "experiment"]
    m = x.groupBy(*keys).agg(
        F.count("net").alias("sample_size"), F.avg("net").alias("mean_net"), F.stddev_samp("net").alias("_sd"),
        F.avg((C("net") > 0).cast("double")).alias("win_rate"),
    ).join(quantiles(x, keys, "net", {"median_net": 0.5}), keys)
    z = ratio(C("mean_net") * F.sqrt("sample_size"), "_sd")
    return m.withColumns({"sharpe_proxy": ratio("mean_net", "_sd"), "z_score": z}).drop("_sd")


def add_p_values(m: DataFrame, z: str = "z_score") -> DataFrame:
    """Two-sided normal p-value of an aggregate table (Spark SQL has no erf)."""
    from math import erfc

    @F.pandas_udf("double")
    def two_sided(v: pd.Series) -> pd.Series:
        return v.map(lambda x: 1.0 if pd.isna(x) else erfc(abs(x) / 2**0.5))

    return m.withColumn("p_value", two_sided(C(z)))


def benjamini_hochberg(m: DataFrame, p: str = "p_value", key: str = "experiment") -> DataFrame:
    """q = running minimum of p * m / rank from the largest p down. One row per experiment."""
    one = Window.partitionBy(F.lit(0))
    up = one.orderBy(p, key)
    df = m.withColumns({"_rank": F.row_number().over(up), "_m": F.count(F.lit(1)).over(one)})
    down = one.orderBy(C("_rank").desc())
    return df.withColumn(
        "q_value", F.least(F.min(C(p) * C("_m") / C("_rank")).over(down), F.lit(1.0))
    ).drop("_rank", "_m")


def winner_profile(sel: DataFrame, features: Sequence[str]) -> DataFrame:
    """Means of the selected winners and losers per feature, and their difference."""
    long = sel.unpivot(["y"], list(features), "feature", "value")
    return long.groupBy("feature").agg(
        F.avg(F.when(C("y") == 1, C("value"))).alias("winner_mean"),
        F.avg(F.when(C("y") == 0, C("value"))).alias("loser_mean"),
    ).withColumn("difference", C("winner_mean") - C("loser_mean"))


def realised_outcomes(signals: DataFrame, panel: DataFrame, bench: DataFrame, horizon: int = 20) -> DataFrame:
    """Outcome ``horizon`` sessions after each signal by session number of stock and benchmark."""
    s = Series("symbol", "date")
    stock = panel.select(
        "symbol", "date", (ratio(s.lead("close", horizon), "close") - 1.0).alias("stock_return"),
        s.lead("date", horizon).alias("outcome_date"),
    )
    one = Series("_k", "date")
    b = bench.withColumn("_k", F.lit(0)).select(
        "date", (ratio(one.lead("close", horizon), "close") - 1.0).alias("bench_return")
    )
    return signals.join(stock, ["symbol", "date"]).join(b, "date").where(
        C("stock_return").isNotNull() & C("bench_return").isNotNull()
    ).withColumn("excess", C("stock_return") - C("bench_return"))


def sequences(df: DataFrame, features: Sequence[str], n: int) -> DataFrame:
    """Last ``n`` rows x features per (symbol, date), only where every value is known."""
    s = Series("symbol", "date")
    vals = F.array(*[C(f) for f in features])
    ok = sum((C(f).isNull().cast("int") for f in features), F.lit(0))
    f = s.frame(n)
    return df.withColumns(
        {"_n": F.count(F.lit(1)).over(f), "_bad": F.sum(ok).over(f), "sequence": F.collect_list(vals).over(f)}
    ).where((C("_n") == n) & (C("_bad") == 0)).drop("_n", "_bad")
