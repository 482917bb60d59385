"""Exact ranks, quantiles and prefix sums for groups of any size.

A rank window over ``partitionBy(date)`` puts a whole cross-section in one task.
Here the group is first reduced to its distinct values (map-side combine, so a
value shared by a third of the rows is one row), the values are spread over
order-preserving buckets, prefix sums run inside each bucket, and the bucket
totals - a few thousand rows per group whatever the data size - supply the
offsets. Nothing is sampled: the results equal the single-window ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.rolling import col

BUCKETS_PER_EFOLD = 64
#: For a few groups that hold the whole table each: buckets stay small, and the totals of a group some ten thousand rows.
WIDE_GROUPS = 1024


def order_bucket(value: Column | str, per_efold: int = BUCKETS_PER_EFOLD) -> Column:
    """Monotone bucket number of a double: log-spaced, fixed by the value alone."""
    v = col(value).cast("double")
    size = F.floor(F.log1p(F.abs(v) * F.lit(1e9)) * F.lit(float(per_efold)))
    return (F.signum(v) * size).cast("int")


def value_ladder(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    sums: Mapping[str, Column] | None = None,
    *,
    descending: bool = False,
    per_efold: int = BUCKETS_PER_EFOLD,
) -> DataFrame:
    """One row per distinct value of each group with its place in the order.

    Columns: ``by``, ``value``, ``cnt`` (rows with the value), ``before`` (rows
    ahead of it), ``total`` (rows in the group) and for each name ``s`` in
    ``sums``: ``s`` (sum over the tied rows), ``s_before`` and ``s_total``.
    """
    by = list(by)
    sums = dict(sums or {})
    measures = ["cnt", *sums]
    d = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("cnt"), *[F.sum(c).alias(n) for n, c in sums.items()])
        .withColumn("_bucket", order_bucket(value, per_efold))
        .withColumn("_group", F.lit(0))
    )
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    inner = (
        Window.partitionBy(*by, "_bucket")
        .orderBy(direction(value))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = d.select(
        "*",
        *[F.coalesce(F.sum(m).over(inner), F.lit(0)).alias(f"_in_{m}") for m in measures],
    )
    totals = d.groupBy(*by, "_group", "_bucket").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    group = Window.partitionBy(*by, "_group")
    ahead = group.orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        F.col("_bucket"),
        *[F.coalesce(F.sum(f"_t_{m}").over(ahead), F.lit(0)).alias(f"_off_{m}") for m in measures],
        *[F.sum(f"_t_{m}").over(group).alias(f"_all_{m}") for m in measures],
    )
    joined = inside.join(offsets, [*by, "_bucket"])
    out = [
        *[F.col(c) for c in by],
        F.col(value),
        F.col("cnt"),
        (F.col("_in_cnt") + F.col("_off_cnt")).alias("before"),
        F.col("_all_cnt").alias("total"),
    ]
    for s in sums:
        out += [
            F.col(s),
            (F.col(f"_in_{s}") + F.col(f"_off_{s}")).alias(f"{s}_before"),
            F.col(f"_all_{s}").alias(f"{s}_total"),
        ]
    return joined.select(*out)


def with_ranks(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    out: Mapping[str, str],
    *,
    descending: bool = False,
) -> DataFrame:
    """Add rank columns; rows with a NULL value keep NULL ranks.

    ``out`` maps a new column name to a kind: ``average``, ``min``, ``max``,
    ``pct`` (average rank over count of values) or ``count``.
    """
    ladder = value_ladder(df, by, value, descending=descending)
    average = F.col("before") + (F.col("cnt") + 1) / 2.0
    kinds = {
        "average": average,
        "min": F.col("before") + 1,
        "max": F.col("before") + F.col("cnt"),
        "pct": average / F.col("total"),
        "count": F.col("total"),
    }
    ranks = ladder.select(*by, F.col(value), *[kinds[k].alias(n) for n, k in out.items()])
    return df.join(ranks, [*by, value], "left")


def with_percentiles(df: DataFrame, by: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """Average-tie percentile columns (``out -> value``); every ladder reads ``df`` once, so
    several percentiles do not multiply the plan."""
    out = df
    for name, value in values.items():
        ladder = value_ladder(df, by, value)
        pct = (F.col("before") + (F.col("cnt") + 1) / 2.0) / F.col("total")
        out = out.join(ladder.select(*by, F.col(value), pct.alias(name)), [*by, value], "left")
    return out


def with_row_number(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    ties: Sequence[str],
    *,
    out: str = "position",
    total: str = "group_rows",
    descending: bool = False,
) -> DataFrame:
    """Dense 1..n position by (value, ties) inside each group, NULL values left out.

    The window runs per (group, order bucket); the offset of a bucket comes from
    its histogram. ``ties`` ascend and must make the order total.
    """
    by = list(by)
    d = df.where(F.col(value).isNotNull()).withColumn("_bucket", order_bucket(value))
    direction = F.col(value).desc() if descending else F.col(value).asc()
    bucket_dir = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    hist = d.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    hist = hist.withColumn("_group", F.lit(0))
    group = Window.partitionBy(*by, "_group")
    offsets = hist.select(
        *by,
        "_bucket",
        F.coalesce(
            F.sum("_n").over(group.orderBy(bucket_dir).rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_off"),
        F.sum("_n").over(group).alias(total),
    )
    inner = Window.partitionBy(*by, "_bucket").orderBy(direction, *ties)
    numbered = d.withColumn("_rn", F.row_number().over(inner))
    return (
        numbered.join(offsets, [*by, "_bucket"])
        .withColumn(out, F.col("_rn") + F.col("_off"))
        .drop("_rn", "_off", "_bucket")
    )


def quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float], *, per_efold: int = BUCKETS_PER_EFOLD
) -> DataFrame:
    """Exact linear-interpolation quantiles per group (columns named by ``probs``)."""
    ladder = value_ladder(df, by, value, per_efold=per_efold)
    aggs = []
    for name, p in probs.items():
        pos = (F.col("total") - 1) * F.lit(float(p))
        after = F.col("before") + F.col("cnt")
        lo, hi = F.floor(pos), F.ceil(pos)
        at = lambda k: F.max(
            F.when((F.col("before") <= k) & (k < after), F.col(value))
        )
        aggs += [at(lo).alias(f"_lo_{name}"), at(hi).alias(f"_hi_{name}")]
    agg = ladder.groupBy(*by).agg(F.max("total").alias("_n"), *aggs) if by else ladder.agg(
        F.max("total").alias("_n"), *aggs
    )
    outs = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outs.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return agg.select(*by, *outs)


def quantile_bucket(position: Column, total: Column, q: int) -> Column:
    """Right-closed equal-frequency bucket of first-ranks (linear quantile edges)."""
    b = F.ceil((position - 1) * F.lit(float(q)) / F.nullif(total - 1, F.lit(0)))
    return F.greatest(F.lit(1), F.coalesce(b, F.lit(1))).cast("int")
