"""Forward-looking labels. Never joined to features before the same row's date is fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.frames import with_row
from barloom.functions.rolling import Series, ratio
from barloom.operators.order_stats import quantiles

S = Series("symbol", "date")
C = F.col

HORIZON = 20
CLASS_BAND = 0.05


def forward_open_returns(panel: DataFrame, horizons=(5, 10, 20, 60), s: Series = S) -> DataFrame:
    """Return from the next session's open to the open ``h`` sessions later."""
    entry = s.lead("open", 1)
    return panel.withColumns(
        {f"forward_return_{h}d": ratio(s.lead("open", h + 1), entry) - 1.0 for h in horizons}
    )


def forward_benchmark(bench: DataFrame, horizon: int = HORIZON) -> DataFrame:
    z = Series("_series", "date")
    return (
        bench.withColumn("_series", F.lit(0))
        .withColumn("future_bench_return", ratio(z.lead("close", horizon), C("close")) - 1.0)
        .select("date", "future_bench_return")
    )


def three_way(excess, band: float = CLASS_BAND):
    return F.when(excess > band, 1).when(excess < -band, -1).when(excess.isNotNull(), 0)


def excess_labels(panel: DataFrame, bench: DataFrame, horizon: int = HORIZON, s: Series = S) -> DataFrame:
    """Future return, benchmark return, their difference and its class; open horizons dropped."""
    df = panel.withColumn("future_stock_return", ratio(s.lead("close", horizon), "close") - 1.0)
    df = df.join(F.broadcast(forward_benchmark(bench, horizon)), "date", "left")  # one row per session
    df = df.withColumn("excess_return", C("future_stock_return") - C("future_bench_return"))
    return df.withColumn("label", three_way(C("excess_return"))).where(
        C("excess_return").isNotNull()
    )


def peer_labels(
    labelled: DataFrame, peer_bench: DataFrame, group_col: str, peer_group: str, peer_name: str,
    default_name: str,
) -> DataFrame:
    """Excess over the benchmark of the symbol's own group."""
    peer = forward_benchmark(peer_bench).withColumnRenamed("future_bench_return", "_peer")
    is_peer = C(group_col) == peer_group
    df = labelled.join(peer, "date", "left").withColumns(
        {
            "target_benchmark": F.when(is_peer, peer_name).otherwise(default_name),
            "future_peer_return": F.when(is_peer, C("_peer")).otherwise(C("future_bench_return")),
        }
    )
    df = df.withColumn("future_peer_excess", C("future_stock_return") - C("future_peer_return"))
    df = df.withColumn("peer_label", three_way(C("future_peer_excess")))
    return df.where(C("future_peer_excess").isNotNull()).drop("_peer")


def quintile_labels(labelled: DataFrame, value: str = "excess_return") -> DataFrame:
    """1 / -1 for the same-date top and bottom fifth, from exact distributed quantiles."""
    cuts = quantiles(labelled, ["date"], value, {"_lo": 0.20, "_hi": 0.80})
    return labelled.join(cuts, "date").withColumn(
        "quintile_label",
        F.when(C(value) >= C("_hi"), 1).when(C(value) <= C("_lo"), -1).otherwise(0),
    ).drop("_lo", "_hi")


def downside_flags(labelled: DataFrame, worst) -> DataFrame:
    """Downside flags from ``worst``, the lowest close of the horizon; open horizons dropped."""
    df = labelled.withColumn("future_max_drawdown", ratio(worst, "close") - 1.0)
    a = C("future_stock_return") < -0.05
    df = df.withColumns(
        {
            "sell_target_a": a.cast("int"),
            "sell_target_b": (a & (C("excess_return") < 0)).cast("int"),
            "sell_target_c": (C("future_max_drawdown") < -0.08).cast("int"),
        }
    )
    both = (C("sell_target_a") == 1) & (C("sell_target_b") == 1)
    return df.withColumn(
        "sell_target_combined", (both | (C("sell_target_c") == 1)).cast("int")
    ).where(C("future_max_drawdown").isNotNull())


def clear_cases(labelled: DataFrame, low: float = 0.02, high: float = 0.05) -> DataFrame:
    """Leave out the ambiguous band between ``low`` and ``high`` excess return."""
    return labelled.where((C("excess_return") <= low) | (C("excess_return") > high))


def time_decay_weights(rows: DataFrame, half_life_days: float) -> DataFrame:
    """Weights halved every half-life before the newest date, scaled to mean 1.

    Both scalars come from one row per date, so nothing is windowed over the rows.
    """
    per_date = rows.groupBy("date").agg(F.count(F.lit(1)).alias("_n"))
    newest = per_date.agg(F.max("date").alias("_newest"))
    raw = lambda: F.pow(
        F.lit(0.5), F.greatest(F.datediff(C("_newest"), C("date")), F.lit(0)) / half_life_days
    )
    w = with_row(per_date, newest).withColumn("_w", raw())
    scale = w.agg((F.sum(C("_w") * C("_n")) / F.sum("_n")).alias("_mean"))
    weights = with_row(w, scale).select("date", (C("_w") / C("_mean")).alias("weight"))
    return rows.join(weights, "date")
