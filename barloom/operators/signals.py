"""Signal registry: named functions ``DataFrame -> DataFrame`` that add a double ``score``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.rolling import Series, ratio
from barloom.operators.features import add_atr, recursive_features

Signal = Callable[[DataFrame], DataFrame]
_SIGNALS: dict[str, Signal] = {}
C = F.col
S = Series("symbol", "date")


def register_signal(name: str) -> Callable[[Signal], Signal]:
    def add(fn: Signal) -> Signal:
        if name in _SIGNALS:
            raise ValueError(f"signal {name!r} is already registered")
        _SIGNALS[name] = fn
        return fn

    return add


def get_signal(name: str) -> Signal:
    if name not in _SIGNALS:
        raise ValueError(f"unknown signal {name!r}; known: {sorted(_SIGNALS)}")
    return _SIGNALS[name]


def apply_signal(panel: DataFrame, name: str) -> DataFrame:
    """Run a signal and check its contract: all input columns kept, ``score`` is double."""
    out = get_signal(name)(panel)
    missing = set(panel.columns) - set(out.columns)
    kind = dict(out.dtypes).get("score")
    if missing or kind != "double":
        raise ValueError(f"signal {name!r} broke its contract: missing={missing} score={kind}")
    return out


def lagged_momentum(skip: int, span: int) -> Signal:
    return lambda p: p.withColumn("score", ratio(S.lag("close", skip), S.lag("close", span)) - 1.0)


@register_signal("momentum_6_1")
def momentum_6_1(panel: DataFrame) -> DataFrame:
    return lagged_momentum(21, 126)(panel)


@register_signal("momentum_weekly")
def momentum_weekly(panel: DataFrame) -> DataFrame:
    return lagged_momentum(4, 26)(panel)


@register_signal("atr_volatility")
def atr_volatility(panel: DataFrame) -> DataFrame:
    df = add_atr(panel, S, (14,))
    return df.withColumn("score", -ratio("atr_14", "close")).drop("prev_close", "tr", "atr_14")


@register_signal("rsi_14")
def rsi_14(panel: DataFrame) -> DataFrame:
    r = recursive_features(panel).select("symbol", "date", C("rsi_wilder_14").alias("score"))
    return panel.join(r, ["symbol", "date"], "left")


@register_signal("vcp_score")
def vcp_score(panel: DataFrame) -> DataFrame:
    if "vcp_score" not in panel.columns:
        raise ValueError("vcp_score needs a point-in-time vcp_score column")
    return panel.withColumn("score", C("vcp_score").cast("double"))


@register_signal("vcp_breakout")
def vcp_breakout(panel: DataFrame) -> DataFrame:
    ok = F.lower("breakout_status").isin("confirmed", "breakout") & (C("volume_to_avg20") >= 1.5)
    return panel.withColumn("score", F.when(ok, C("vcp_score").cast("double")))
