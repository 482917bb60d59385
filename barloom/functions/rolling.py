"""Row-frame helpers with the warm-up rule: NULL until the frame holds enough values."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` with NULL where the denominator is zero (ANSI mode raises otherwise)."""
    return col(num) / F.nullif(col(den), F.lit(0.0))


def flag(cond: Column) -> Column:
    """1.0 / 0.0 flag in which an unknown comparison counts as false."""
    return F.coalesce(cond, F.lit(False)).cast("double")


def known_flag(cond: Column) -> Column:
    """1.0 / 0.0 flag that stays NULL when the comparison is unknown."""
    return cond.cast("double")


class Series:
    """Windows over one ordered series per key.

    All frames share the same partitioning and ordering, so Spark plans one
    exchange and one sort for every column built from the same ``Series``.
    """

    def __init__(self, keys: str | list[str] = "symbol", order: str | list[str] = "date"):
        self.keys = [keys] if isinstance(keys, str) else list(keys)
        self.order = [order] if isinstance(order, str) else list(order)

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def frame(self, n: int, end: int = 0) -> WindowSpec:
        """The ``n`` rows ending ``-end`` rows before the current one."""
        return self.w.rowsBetween(end - n + 1, end)

    def lag(self, c: Column | str, n: int = 1) -> Column:
        return F.lag(col(c), n).over(self.w)

    def lead(self, c: Column | str, n: int = 1) -> Column:
        return F.lead(col(c), n).over(self.w)

    def change(self, c: Column | str, n: int = 1) -> Column:
        """Relative change over ``n`` rows, no filling."""
        return ratio(c, self.lag(c, n)) - 1.0

    def diff(self, c: Column | str, n: int = 1) -> Column:
        return col(c) - self.lag(c, n)

    def roll(
        self,
        fn: Callable[..., Column],
        *cols: Column | str,
        n: int,
        end: int = 0,
        min_rows: int | None = None,
    ) -> Column:
        """``fn`` over the last ``n`` rows, NULL below ``min_rows`` complete observations."""
        need = n if min_rows is None else min_rows
        args = [col(c) for c in cols]
        f = self.frame(n, end)
        seen = args[0] if len(args) == 1 else F.when(
            reduce(lambda a, b: a & b, [a.isNotNull() for a in args]), F.lit(1)
        )
        return F.when(F.count(seen).over(f) >= need, fn(*args).over(f))

    def mean(self, c, n, **kw) -> Column:
        return self.roll(F.avg, c, n=n, **kw)

    def std(self, c, n, **kw) -> Column:
        return self.roll(F.stddev_samp, c, n=n, **kw)

    def sum(self, c, n, **kw) -> Column:
        return self.roll(F.sum, c, n=n, **kw)

    def max(self, c, n, **kw) -> Column:
        return self.roll(F.max, c, n=n, **kw)

    def min(self, c, n, **kw) -> Column:
        return self.roll(F.min, c, n=n, **kw)

    def position(self) -> Column:
        return F.row_number().over(self.w)


class Tail:
    """Aggregates over the rows before one row of a series, with the warm-up rule of :class:`Series`.

    ``back`` counts the rows from the row that is asked for (0: that row). Where only one row of a series is wanted, one
    grouped pass over its past takes the place of frames that slide over every row.
    """

    def __init__(self, back: Column | str = "_back_rows"):
        self.back = col(back)

    def at(self, c: Column | str, n: int = 0) -> Column:
        """The value ``n`` rows back."""
        return F.first(F.when(self.back == n, col(c)), ignorenulls=True)

    def inside(self, c: Column | str, n: int, end: int = 0) -> Column:
        """The value in the ``n`` rows ending ``-end`` rows back, NULL outside."""
        return F.when(self.back.between(-end, n - end - 1), col(c))

    def roll(self, fn: Callable[[Column], Column], c: Column | str, *, n: int, end: int = 0) -> Column:
        x = self.inside(c, n, end)
        return F.when(F.count(x) >= n, fn(x))

    def mean(self, c, n, **kw) -> Column:
        return self.roll(F.avg, c, n=n, **kw)

    def max(self, c, n, **kw) -> Column:
        return self.roll(F.max, c, n=n, **kw)

    def min(self, c, n, **kw) -> Column:
        return self.roll(F.min, c, n=n, **kw)
