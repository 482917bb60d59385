"""As-of joins by union and carry-forward: one exchange, one sort, linear in rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

C = F.col


def as_of(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str,
    *, ties: Sequence[str] = (), strict: bool = False,
) -> DataFrame:
    """Latest ``right`` row with ``right_on <= left_on`` (``<`` when ``strict``) per key.

    ``ties`` order right rows that share a time; the last one wins. Right columns keep
    their names, so they must not clash with left columns other than ``by``.
    """
    by = list(by)
    payload = [c for c in right.columns if c not in by]
    facts = right.where(C(right_on).isNotNull()).select(
        *by, C(right_on).alias("_t"), F.lit(1 if strict else 0).alias("_kind"),
        *[C(t).alias(f"_o{i}") for i, t in enumerate(ties)],
        F.struct(*payload).alias("_fact"),
    )
    rest = [c for c in left.columns if c not in by]
    probes = left.select(
        *by, C(left_on).alias("_t"), F.lit(0 if strict else 1).alias("_kind"),
        F.struct(*rest).alias("_row"),
    )
    both = probes.unionByName(facts, allowMissingColumns=True)
    w = (
        Window.partitionBy(*by)
        .orderBy("_t", "_kind", *[f"_o{i}" for i in range(len(ties))])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    carried = both.withColumn("_hit", F.last("_fact", ignorenulls=True).over(w))
    return carried.where(C("_row").isNotNull()).select(*by, "_row.*", *[
        C(f"_hit.{c}").alias(c) for c in payload
    ])


def next_session(rows: DataFrame, sessions: DataFrame, on: str, out: str) -> DataFrame:
    """First session strictly after ``on``; joins through one row per distinct date."""
    cal = sessions.select(C("date").alias("_d")).distinct()
    days = rows.select(C(on).alias("_d")).where(C("_d").isNotNull()).distinct()
    marks = cal.select("_d", F.lit(1).alias("_s")).unionByName(days.select("_d", F.lit(0).alias("_s")))
    # one row per calendar date, so the single window holds a calendar, not the rows
    numbered = marks.groupBy("_d").agg(F.max("_s").alias("_s"))
    ahead = Window.partitionBy(F.lit(0)).orderBy(C("_d").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    table = numbered.withColumn(
        out, F.last(F.when(C("_s") == 1, C("_d")), ignorenulls=True).over(ahead)
    ).select(C("_d").alias(on), out)
    return rows.join(table, on, "left")
