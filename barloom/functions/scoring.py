"""Scoring and array helpers shared by the rule operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def band(v: Column, excellent: float, good: float, fair: float, poor: float, higher: bool = True) -> Column:
    """Piecewise-linear 0..100 score over four thresholds; NULL stays NULL."""
    if not higher:
        return band(-v, -excellent, -good, -fair, -poor)
    step = lambda lo, hi: 25.0 * (v - lo) / (hi - lo)
    return (
        F.when(v >= excellent, 100.0).when(v >= good, 75.0 + step(good, excellent)).when(v >= fair, 50.0 + step(fair, good))
        .when(v >= poor, 25.0 + step(poor, fair)).when(v.isNotNull(), F.greatest(F.lit(0.0), 25.0 * (v - poor) / (fair - poor + 1e-9)))
    )


def ladder(v: Column, steps: list[tuple[float, float]], rest: float) -> Column:
    """Score of the first upper bound that holds the value."""
    out = F.when(v.isNull(), None)
    for bound, score in steps:
        out = out.when(v <= bound, score)
    return out.otherwise(rest)


def ladder_first(*cases: tuple[Column, float]) -> Column:
    """Value of the first case that holds; NULL where none does."""
    out = F
    for cond, value in cases:
        out = out.when(cond, value)
    return out


def mean_present(scores: list[Column]) -> Column:
    known = F.array_compact(F.array(*scores))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)).otherwise(0.0)


def coverage(values: list[Column]) -> Column:
    return sum((v.isNotNull().cast("double") for v in values), F.lit(0.0)) / len(values)


def known(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


def latest(values: Column) -> Column:
    return F.try_element_at(known(values), F.lit(-1))


def _back(values: Column, k: int) -> Column:
    return F.try_element_at(known(values), F.lit(-k))


def qoq_up(values: Column) -> Column:
    return F.coalesce(_back(values, 1) > _back(values, 2), F.lit(False))


def qoq_down(values: Column) -> Column:
    return F.coalesce(_back(values, 1) < _back(values, 2), F.lit(False))


def qoq_non_down(values: Column) -> Column:
    return F.coalesce(_back(values, 1) >= _back(values, 2), F.lit(False))


def two_up(values: Column) -> Column:
    return qoq_up(values) & F.coalesce(_back(values, 2) > _back(values, 3), F.lit(False))


def two_down(values: Column) -> Column:
    return qoq_down(values) & F.coalesce(_back(values, 2) < _back(values, 3), F.lit(False))


def yoy_drop(values: Column) -> Column:
    return _back(values, 5) - _back(values, 1)


def add_series(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def growth(current: Column, base: Column) -> Column:
    """Growth with explicit labels for zero and negative bases: (value, note)."""
    def out(value, note):
        return F.struct(value.cast("double").alias("value"), F.lit(note).alias("note"))

    none = F.lit(None)
    return (
        F.when(current.isNull() | base.isNull(), out(none, "unavailable"))
        .when(base == 0, out(none, "zero_base")).when((base < 0) & (current >= 0), out(none, "turnaround"))
        .when(base < 0, out((F.abs(base) - F.abs(current)) / F.abs(base), "loss_change"))
        .otherwise(out(current / F.nullif(base, F.lit(0.0)) - 1, ""))
    )


def freshness(as_of: Column, seen: Column, fresh: int, aging: int) -> Column:
    age = F.greatest(F.datediff(as_of, seen), F.lit(0))
    return F.when(seen.isNull(), "MISSING").when(age <= fresh, "FRESH").when(age <= aging, "AGING").otherwise("STALE")


def inr_return(commodity: Column, fx: Column) -> Column:
    return (1 + commodity) * (1 + fx) - 1


def oi_state(price_change: Column, oi_change: Column) -> Column:
    up, more = price_change > 0, oi_change > 0
    down, less = price_change < 0, oi_change < 0
    return (
        F.when(up & more, "LONG_BUILDUP").when(up & less, "SHORT_COVERING").when(down & more, "SHORT_BUILDUP")
        .when(down & less, "LONG_UNWINDING").otherwise("UNKNOWN")
    )


def degrees(v: Column) -> Column:
    return F.pmod(v, F.lit(360.0))


def signed_delta(a: Column, b: Column) -> Column:
    """Shortest signed arc from ``a`` to ``b`` in -180..180."""
    return F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0


SYNODIC_DAYS = 29.530588853  # fixed value: mean lunar month


def phase(moon: Column, sun: Column) -> dict[str, Column]:
    angle = degrees(moon - sun)
    days = angle / 360.0 * SYNODIC_DAYS
    return {
        "phase_angle": angle, "illumination": (1 - F.cos(F.radians(angle))) / 2,
        "days_from_new": F.least(days, SYNODIC_DAYS - days),
    }
