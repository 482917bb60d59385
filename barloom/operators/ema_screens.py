"""EMA distance, crossings and screens; warm-up restarts at every missing session."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.rolling import ratio

C = F.col
WINDOWS = (20, 50, 200)
_SCHEMA = (
    "symbol string, date date, session int, run int, close double, "
    "ema20 double, ema50 double, ema200 double"
)


def _averages(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("session")
    by_run = pdf.groupby("run", sort=False)["close"]
    for n in WINDOWS:
        pdf[f"ema{n}"] = by_run.transform(
            lambda v, n=n: v.ewm(span=n, adjust=False, min_periods=n).mean()
        )
    return pdf


def ema_observations(panel: DataFrame) -> DataFrame:
    """``panel``: symbol, date, session, segment, tradable, close (see ``breadth_panel``).

    A run is a stretch of consecutive tradable sessions inside one segment: session
    number minus position is constant on it.
    """
    good = panel.where(C("tradable"))
    w = Window.partitionBy("symbol", "segment").orderBy("session")
    stretches = good.withColumn("_stretch", C("session") - F.row_number().over(w))
    runs = stretches.withColumn(
        "run", F.dense_rank().over(Window.partitionBy("symbol").orderBy("segment", "_stretch"))
    )
    df = (
        runs.select("symbol", "date", "session", "run", "close", *[
            F.lit(None).cast("double").alias(f"ema{n}") for n in WINDOWS
        ])
        .groupBy("symbol")
        .applyInPandas(_averages, _SCHEMA)
    )
    df = df.withColumns({f"ema{n}": F.nanvl(C(f"ema{n}"), F.lit(None)) for n in WINDOWS})
    r = Window.partitionBy("symbol", "run").orderBy("session")
    df = df.withColumns(
        {"_pc": F.lag("close").over(r)} | {f"_p{n}": F.lag(f"ema{n}").over(r) for n in WINDOWS}
    )
    cols = {}
    for n in WINDOWS:
        up = (C("_pc") <= C(f"_p{n}")) & (C("close") > C(f"ema{n}"))
        down = (C("_pc") >= C(f"_p{n}")) & (C("close") < C(f"ema{n}"))
        cols[f"ema{n}_distance_pct"] = (ratio("close", f"ema{n}") - 1.0) * 100
        for name, hit in (("up", up), ("down", down)):
            last = F.last(F.when(hit, F.struct("date", "session")), ignorenulls=True).over(r)
            cols[f"_{name}{n}"] = last
    df = df.withColumns(cols)
    out = {}
    for n in WINDOWS:
        for name in ("up", "down"):
            out[f"ema{n}_{name}_date"] = C(f"_{name}{n}")["date"]
            out[f"ema{n}_{name}_age"] = C("session") - C(f"_{name}{n}")["session"]
    return df.withColumns(out).drop(
        "_pc", *[f"_p{n}" for n in WINDOWS], *[f"_{k}{n}" for n in WINDOWS for k in ("up", "down")]
    )


def near_ema200(latest: DataFrame, distance_pct: float = 3.0, side: str = "Both") -> DataFrame:
    if not 0 <= distance_pct <= 25:
        raise ValueError("distance must lie between 0 and 25 percent")
    d = C("ema200_distance_pct")
    keep = F.abs(d) <= distance_pct + 1e-10
    if side == "Above":
        keep = keep & (d >= 0)
    elif side == "Below":
        keep = keep & (d <= 0)
    elif side != "Both":
        raise ValueError(f"unknown side {side!r}")
    return latest.where(keep).withColumn(
        "position",
        F.when(d > 1e-10, "Above EMA200").when(d < -1e-10, "Below EMA200").otherwise("At EMA200"),
    )


def ema_crossings(
    latest: DataFrame, windows: Sequence[int] = WINDOWS, direction: str = "Up",
    within: int = 1, match: str = "Any",
) -> DataFrame:
    """Recent crossings that still hold at the close; one row per symbol and direction."""
    if match not in ("Any", "All") or not 1 <= within <= 20:
        raise ValueError("unsupported crossing screen")
    names = {"Up": ["up"], "Down": ["down"], "Both": ["up", "down"]}[direction]
    parts = []
    for name in names:
        hit = {}
        for n in windows:
            holds = C("close") > C(f"ema{n}") if name == "up" else C("close") < C(f"ema{n}")
            age = C(f"ema{n}_{name}_age")
            hit[n] = F.coalesce((age >= 0) & (age < within) & holds, F.lit(False))
        count = sum((h.cast("int") for h in hit.values()), F.lit(0))
        need = len(hit) if match == "All" else 1
        ages = F.array_min(F.array(*[F.when(h, C(f"ema{n}_{name}_age")) for n, h in hit.items()]))
        dates = F.array_max(F.array(*[F.when(h, C(f"ema{n}_{name}_date")) for n, h in hit.items()]))
        labels = F.array_join(F.array_compact(F.array(*[
            F.when(h, F.lit(f"EMA{n}")) for n, h in hit.items()
        ])), ", ")
        parts.append(
            latest.where(count >= need).select(
                "symbol", "close",
                F.lit("Crossed above" if name == "up" else "Crossed below").alias("direction"),
                labels.alias("crossed"), ages.alias("sessions_since"), dates.alias("cross_date"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
