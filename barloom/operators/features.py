"""Backward-looking features of a bar panel (symbol, date, open, high, low, close, volume).

Each stage adds columns over the same (symbol, date) windows, so a whole chain of
stages costs one exchange and one sort. A symbol holds at most one bar per
session, which bounds every window partition by the length of the calendar.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.rolling import Series, flag, ratio

S = Series("symbol", "date")
C = F.col

RETURN_ROWS = (1, 5, 10, 20, 60, 120, 252)
SMA_ROWS = (20, 50, 100, 200)
BETA_ROWS, CORR_ROWS = (60, 120, 252), (20, 60, 120)


def gain_loss_rsi(gain: Column, loss: Column) -> Column:
    """RSI from average gain and loss: 100 without losses, 50 on a flat series."""
    plain = 100.0 - 100.0 / (1.0 + ratio(gain, loss))
    return (
        F.when((loss == 0) & (gain > 0), 100.0).when((loss == 0) & (gain == 0), 50.0).otherwise(plain)
    )


def true_range(high: str = "high", low: str = "low", prev: str = "prev_close") -> Column:
    h, lo, p = C(high), C(low), C(prev)
    return F.greatest(h - lo, F.abs(h - p), F.abs(lo - p))


def add_returns(df: DataFrame, s: Series = S) -> DataFrame:
    cols = {f"ret_{n}d": s.change("close", n) for n in RETURN_ROWS}
    return df.withColumns(cols)


def add_trend(df: DataFrame, s: Series = S, rows=SMA_ROWS) -> DataFrame:
    df = df.withColumns({f"sma_{n}": s.mean("close", n) for n in rows})
    return df.withColumns({f"price_to_sma_{n}": ratio("close", f"sma_{n}") - 1.0 for n in rows})


def add_rsi(df: DataFrame, s: Series = S, n: int = 14, out: str = "rsi_14") -> DataFrame:
    """RSI with simple means of gains and losses."""
    df = df.withColumn("_delta", s.diff("close"))
    df = df.withColumns(
        {"_gain": F.when(C("_delta").isNotNull(), F.greatest(C("_delta"), F.lit(0.0))),
         "_loss": F.when(C("_delta").isNotNull(), F.greatest(-C("_delta"), F.lit(0.0)))}
    )
    df = df.withColumns({"_ag": s.mean("_gain", n), "_al": s.mean("_loss", n)})
    return df.withColumn(out, gain_loss_rsi(C("_ag"), C("_al"))).drop(
        "_delta", "_gain", "_loss", "_ag", "_al"
    )


def add_atr(df: DataFrame, s: Series = S, rows=(14, 50)) -> DataFrame:
    """True range and its simple mean."""
    df = df.withColumn("prev_close", s.lag("close"))
    df = df.withColumn("tr", true_range())
    return df.withColumns({f"atr_{n}": s.mean("tr", n) for n in rows})


def add_adx(df: DataFrame, s: Series = S, n: int = 14) -> DataFrame:
    """ADX in the rolling-sum form: summed directional movement over the mean true range."""
    df = df.withColumns({"_up": s.diff("high"), "_dn": -s.diff("low")})
    df = df.withColumns(
        {
            "_pdm": F.when((C("_up") > C("_dn")) & (C("_up") > 0), C("_up")).otherwise(0.0),
            "_mdm": F.when((C("_dn") > C("_up")) & (C("_dn") > 0), C("_dn")).otherwise(0.0),
        }
    )
    df = df.withColumns(
        {
            "plus_di_14": 100.0 * ratio(s.sum("_pdm", n), C("atr_14")),
            "minus_di_14": 100.0 * ratio(s.sum("_mdm", n), C("atr_14")),
        }
    )
    df = df.withColumn(
        "_dx",
        100.0 * ratio(F.abs(C("plus_di_14") - C("minus_di_14")), C("plus_di_14") + C("minus_di_14")),
    )
    return df.withColumn("adx_14", s.mean("_dx", n)).drop("_up", "_dn", "_pdm", "_mdm", "_dx")


def add_volatility(df: DataFrame, s: Series = S) -> DataFrame:
    """Return volatility and Bollinger width / %B."""
    df = df.withColumns(
        {f"volatility_{n}d": s.std("ret_1d", n) for n in (20, 60, 120)}
        | {"_mid": s.mean("close", 20), "_sd": s.std("close", 20)}
    )
    return df.withColumns(
        {
            "bb_width_20": ratio(4.0 * C("_sd"), "_mid"),
            "bb_percent_b_20": ratio(C("close") - (C("_mid") - 2.0 * C("_sd")), 4.0 * C("_sd")),
        }
    ).drop("_mid", "_sd")


def add_volume(df: DataFrame, s: Series = S) -> DataFrame:
    """Volume ratio, trend, up/down ratio and price-volume confirmation."""
    df = df.withColumns(
        {
            "_upv": F.when(C("ret_1d") > 0, C("volume")).otherwise(0.0),
            "_dnv": F.when(C("ret_1d") < 0, C("volume")).otherwise(0.0),
        }
    )
    df = df.withColumns(
        {
            "volume_to_avg20": ratio("volume", s.mean("volume", 20)),
            "volume_trend_20d": ratio(s.mean("volume", 5), s.mean("volume", 20)) - 1.0,
            "up_down_volume_ratio_20d": ratio(s.sum("_upv", 20), s.sum("_dnv", 20)),
        }
    )
    return df.withColumns(
        {
            "price_return_x_volume_ratio": C("ret_20d") * C("volume_to_avg20"),
            "positive_price_volume_confirmation": flag(
                (C("ret_20d") > 0) & (C("volume_to_avg20") > 1)
            ),
        }
    ).drop("_upv", "_dnv")


def add_momentum(df: DataFrame, s: Series = S) -> DataFrame:
    """Momentum differences, their changes, and ratios of short to long dispersion."""
    return df.withColumns(
        {
            "momentum_20d_vs_60d": C("ret_20d") - C("ret_60d"),
            "momentum_60d_vs_120d": C("ret_60d") - C("ret_120d"),
            "momentum_20d_change": s.diff("ret_20d", 20),
            "volatility_20d_to_60d": ratio("volatility_20d", "volatility_60d"),
            "atr_14_to_atr_50": ratio("atr_14", "atr_50"),
            "bb_width_to_avg_120d": ratio("bb_width_20", s.mean("bb_width_20", 120)),
            "volatility_20d_change": s.diff("volatility_20d", 20),
        }
    )


def add_extremes(df: DataFrame, s: Series = S, year: int = 252) -> DataFrame:
    """Distance to prior highs (current row excluded), breakout flags, yearly high and low."""
    prior = {f"_ph{n}": s.max("high", n, end=-1) for n in (20, 50, 100)}
    df = df.withColumns(prior | {"_hi": s.max("high", year), "_lo": s.min("low", year)})
    out = {}
    for n in (20, 50, 100):
        out[f"distance_prev_{n}d_high"] = ratio("close", f"_ph{n}") - 1.0
        out[f"breakout_prev_{n}d_high"] = flag(C("close") > C(f"_ph{n}"))
    out["distance_52w_high"] = ratio("close", "_hi") - 1.0
    out["distance_52w_low"] = ratio("close", "_lo") - 1.0
    return df.withColumns(out).drop("_ph20", "_ph50", "_ph100", "_hi", "_lo")


def _pair_columns(
    x: np.ndarray, y: np.ndarray, row: np.ndarray, betas: Sequence[int], corrs: Sequence[int], wanted: np.ndarray | None = None
) -> dict[str, np.ndarray]:
    """Slopes and correlations of ``x`` on ``y`` over full frames of known rows; ``row``: number of the row in its series.

    Rows that are not ``wanted`` get none.
    """
    known = np.concatenate([[0], np.cumsum(np.isfinite(x) & np.isfinite(y))])
    out = {f"beta_{n}": np.full(len(x), np.nan) for n in betas} | {f"corr_{n}": np.full(len(x), np.nan) for n in corrs}
    for n in sorted({*betas, *corrs}):
        if len(x) < n:
            continue
        at = np.arange(n - 1, len(x))
        at = at[(row[at] >= n) & (known[at + 1] - known[at + 1 - n] == n)]
        at = at if wanted is None else at[wanted[at]]
        # less the frame's first value, so that a flat frame has no spread at all
        a, b = (np.lib.stride_tricks.sliding_window_view(v, n)[at + 1 - n] for v in (x, y))
        a, b = a - a[:, :1], b - b[:, :1]
        a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
        ab, bb = np.einsum("ij,ij->i", a, b), np.einsum("ij,ij->i", b, b)
        with np.errstate(all="ignore"):
            if n in betas:
                out[f"beta_{n}"][at] = np.where(bb > 0, ab / bb, np.nan)
            if n in corrs:
                spread = np.sqrt(np.einsum("ij,ij->i", a, a) * bb)
                out[f"corr_{n}"][at] = np.where(spread > 0, ab / spread, np.nan)
    return out


def pair_windows(x: Column, y: Column, row: Column, betas: Sequence[int], corrs: Sequence[int]) -> Column:
    """Struct of beta_n and corr_n of ``x`` on ``y`` over the last n rows of a series, null unless all are known.

    ``row`` is the row number of a window over the series, which also puts its rows into one task, in order. A task keeps the
    last rows of a batch for the next one. Rows out of order raise an error; as the function counts as nondeterministic,
    no filter is moved below it.
    """
    longest = max(*betas, *corrs)
    fields = [*[f"beta_{n}" for n in betas], *[f"corr_{n}" for n in corrs]]

    @F.pandas_udf(", ".join(f"{f} double" for f in fields))
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        xs, ys, rows = np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
        for a, b, r in batches:
            old = len(rows)
            xs, ys = np.concatenate([xs, a.to_numpy(float)]), np.concatenate([ys, b.to_numpy(float)])
            rows = np.concatenate([rows, r.to_numpy(np.int64)])
            if not ((rows[1:] == 1) | (rows[1:] == rows[:-1] + 1)).all():
                raise ValueError("rows of a series are not in order")
            out = _pair_columns(xs, ys, rows, betas, corrs)
            yield pd.DataFrame({f: out[f][old:] for f in fields})
            xs, ys, rows = xs[-longest:], ys[-longest:], rows[-longest:]

    return run.asNondeterministic()(x, y, row)


def add_benchmark(df: DataFrame, bench: DataFrame, s: Series = S) -> DataFrame:
    """Relative strength, beta and correlation against a one-row-per-date benchmark."""
    b = bench.select("date", C("close").alias("bench_close"))
    df = df.join(F.broadcast(b), "date", "left")
    df = df.withColumns({"_br": s.change("bench_close"), "_row": s.position()})
    df = df.withColumns(
        {f"rs_vs_bench_{n}d": C(f"ret_{n}d") - s.change("bench_close", n) for n in (20, 60, 120, 252)}
    )
    df = df.withColumns(
        {
            "relative_momentum_20d_change": s.diff("rs_vs_bench_20d", 20),
            "relative_momentum_20d_vs_60d": C("rs_vs_bench_20d") - C("rs_vs_bench_60d"),
        }
    )
    df = df.withColumn("_pair", pair_windows(C("ret_1d"), C("_br"), C("_row"), BETA_ROWS, CORR_ROWS))
    out = {f"beta_{n}d": C(f"_pair.beta_{n}") for n in BETA_ROWS} | {f"corr_bench_{n}d": C(f"_pair.corr_{n}") for n in CORR_ROWS}
    return df.withColumns(out).drop("_br", "_row", "_pair")


def equal_weight_sectors(panel: DataFrame, s: Series = S) -> DataFrame:
    """Mean of closes rebased to each symbol's first close, per (date, sector)."""
    base = F.first("close").over(s.w)
    return (
        panel.withColumn("_norm", ratio("close", base))
        .groupBy("date", "sector")
        .agg(F.avg("_norm").alias("sector_close"))
    )


def sector_series_features(sectors: DataFrame) -> DataFrame:
    """Returns, volatility, RSI, distance to high and regime flags of each sector series."""
    z = Series("sector", "date")
    df = sectors.withColumn("close", C("sector_close"))
    df = df.withColumn("_r", z.change("close"))
    df = df.withColumns(
        {f"sector_ret_{n}d": z.change("close", n) for n in (20, 60, 120, 252)}
        | {f"sector_volatility_{n}d": z.std("_r", n) for n in (20, 60, 120)}
        | {
            "sector_distance_52w_high": ratio("close", z.max("close", 252)) - 1.0,
            "_s50": z.mean("close", 50),
            "_s200": z.mean("close", 200),
        }
    )
    df = add_rsi(df, z, 14, "sector_rsi_14")
    bull = (C("close") > C("_s50")) & (C("_s50") > C("_s200")) & (C("sector_ret_60d") > 0)
    bear = (C("close") < C("_s50")) & (C("_s50") < C("_s200")) & (C("sector_ret_60d") < 0)
    df = df.withColumns(
        {
            "sector_above_sma50": flag(C("close") > C("_s50")),
            "sector_above_sma200": flag(C("close") > C("_s200")),
            "sector_regime_bull": flag(bull),
            "sector_regime_bear": flag(bear),
        }
    )
    return df.withColumn(
        "sector_regime_sideways",
        flag((C("sector_regime_bull") == 0) & (C("sector_regime_bear") == 0)),
    ).drop("close", "_r", "_s50", "_s200", "sector_close")


def add_sector_relative(df: DataFrame, sector_features: DataFrame) -> DataFrame:
    """Thirteen differences between a symbol and its sector series."""
    df = df.join(F.broadcast(sector_features), ["date", "sector"], "left")  # sectors x sessions
    out = {f"stock_vs_sector_ret_{n}d": C(f"ret_{n}d") - C(f"sector_ret_{n}d") for n in (20, 60, 120, 252)}
    for n in (20, 60):
        out[f"stock_volatility_relative_sector_{n}d"] = (
            ratio(f"volatility_{n}d", f"sector_volatility_{n}d") - 1.0
        )
    out["stock_distance_52w_high_relative_sector"] = (
        C("distance_52w_high") - C("sector_distance_52w_high")
    )
    for n in (20, 60, 120):
        out[f"sector_momentum_{n}d"] = C(f"sector_ret_{n}d")
        bench_ret = C(f"ret_{n}d") - C(f"rs_vs_bench_{n}d")
        out[f"sector_strength_vs_bench_{n}d"] = C(f"sector_ret_{n}d") - bench_ret
    return df.withColumns(out)


def breadth_by_date(panel: DataFrame, s: Series = S) -> DataFrame:
    """Share of symbols above long averages and the advance/decline ratio per date.

    An unknown comparison counts as false, so the denominator is every bar.
    """
    x = panel.withColumns(
        {
            "_s50": s.mean("close", 50),
            "_s200": s.mean("close", 200),
            "_r20": s.change("close", 20),
            "_r1": s.change("close", 1),
        }
    )
    return (
        x.groupBy("date")
        .agg(
            F.avg(flag(C("close") > C("_s50"))).alias("market_breadth_above_sma50"),
            F.avg(flag(C("close") > C("_s200"))).alias("market_breadth_above_sma200"),
            F.avg(flag(C("_r20") > 0)).alias("market_breadth_positive_20d_return"),
            F.sum(flag(C("_r1") > 0)).alias("_adv"),
            F.sum(flag(C("_r1") < 0)).alias("_dec"),
        )
        .withColumn("market_breadth_advance_decline_ratio", ratio("_adv", "_dec"))
        .drop("_adv", "_dec")
    )


def market_regime_features(bench: DataFrame, breadth: DataFrame) -> DataFrame:
    """Regime features of the benchmark; its table has one row per session."""
    z = Series("_series", "date")
    df = bench.withColumn("_series", F.lit(0))
    df = df.withColumns(
        {f"_s{n}": z.mean("close", n) for n in (20, 50, 200)}
        | {f"bench_ret_{n}d": z.change("close", n) for n in (20, 60, 120)}
        | {"_r": z.change("close")}
    )
    df = add_rsi(df, z, 14, "bench_rsi_14")
    df = add_adx(add_atr(df, z, (14,)), z)
    df = df.withColumns(
        {
            "bench_volatility_20d": z.std("_r", 20),
            "bench_volatility_60d": z.std("_r", 60),
            "bench_distance_52w_high": ratio("close", z.max("high", 252)) - 1.0,
            "bench_atr_14": C("atr_14"),
            "bench_atr_pct_14": ratio("atr_14", "close"),
            "bench_adx_14": C("adx_14"),
            "bench_sma50_sma200_trend": ratio("_s50", "_s200") - 1.0,
            **{f"bench_above_sma{n}": flag(C("close") > C(f"_s{n}")) for n in (20, 50, 200)},
        }
    )
    cut = z.roll(lambda v: F.percentile(v, 0.75), "bench_volatility_60d", n=252)
    bull = (C("close") > C("_s50")) & (C("_s50") > C("_s200")) & (C("bench_ret_60d") > 0)
    bear = (C("close") < C("_s50")) & (C("_s50") < C("_s200")) & (C("bench_ret_60d") < 0)
    df = df.withColumns(
        {
            "market_regime_bull_trend": flag(bull),
            "market_regime_bear_trend": flag(bear),
            "market_regime_high_volatility": flag(C("bench_volatility_60d") > cut),
        }
    )
    calm = reduce(
        lambda a, b: a & b,
        [C(f"market_regime_{k}") == 0 for k in ("bull_trend", "bear_trend", "high_volatility")],
    )
    df = df.withColumn("market_regime_sideways", flag(calm))
    return df.join(breadth, "date", "left").drop(
        "open", "high", "low", "close", "volume", "_series", "_s20", "_s50", "_s200", "_r",
        "prev_close", "tr", "atr_14", "adx_14", "plus_di_14", "minus_di_14",
    )


#: Rows of whole symbols that a task treats at once (a bound on its memory).
RECURSIVE_ROWS = 50_000
RECURSIVE_SCHEMA = (
    "symbol string, date date, ema_10 double, ema_20 double, ema_50 double, ema_200 double, "
    "macd double, macd_signal double, rsi_wilder_14 double, atr_wilder_14 double, adx_wilder_14 double"
)

RECURSIVE_COLUMNS = [f.split(" ")[0] for f in RECURSIVE_SCHEMA.split(", ")][2:]


def _smooth(x: np.ndarray, alpha: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Recursive means of the columns of ``x``, as ``ewm(alpha, adjust=False, min_periods=need).mean()`` gives them."""
    out = np.empty_like(x)
    mean, old, seen = np.full(x.shape[1], np.nan), np.ones(x.shape[1]), np.zeros(x.shape[1], np.int64)
    for i, now in enumerate(x):
        known, started = now == now, mean == mean
        seen += known
        old = np.where(started, old * (1 - alpha), old)  # a gap keeps the mean and loses weight
        mixed = np.where(mean == now, mean, (old * mean + alpha * now) / (old + alpha))
        mean = np.where(known, np.where(started, mixed, now), mean)
        old = np.where(known, 1.0, old)
        out[i] = np.where(seen >= need, mean, np.nan)
    return out


def _recursive_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Recursive averages of several symbols, whose rows stand together by date: one column per symbol and average."""
    codes, names = pd.factorize(pdf["symbol"], use_na_sentinel=False)
    place = pdf.groupby(codes).cumcount().to_numpy()
    shape = (int(place.max(initial=-1)) + 1, len(names))
    grid = {}
    for c in ("close", "high", "low"):
        grid[c] = np.full(shape, np.nan)
        grid[c][place, codes] = pdf[c].to_numpy(float)
    close, high, low = grid.values()

    def before(x: np.ndarray) -> np.ndarray:
        return np.vstack([np.full((1, shape[1]), np.nan), x[:-1]])[: shape[0]]

    def smooth(series: dict[str, tuple[np.ndarray, float, int]]) -> dict[str, np.ndarray]:
        x, alpha, need = zip(*series.values(), strict=True)
        wide = _smooth(np.hstack(x), np.repeat(alpha, shape[1]), np.repeat(np.maximum(need, 1), shape[1]))
        return dict(zip(series, np.hsplit(wide, len(series)), strict=True))

    known = lambda x: np.where(x != 0, x, np.nan)
    span = lambda n: 2 / (n + 1)
    with np.errstate(all="ignore"):
        prev = before(close)
        move, up, down = close - prev, high - before(high), before(low) - low
        tr = np.fmax(np.fmax(high - low, np.abs(high - prev)), np.abs(low - prev))
        wilder = {"gain": np.clip(move, 0, None), "loss": -np.clip(move, None, 0), "tr": tr,
                  "up": np.where((up > down) & (up > 0), up, 0.0), "down": np.where((down > up) & (down > 0), down, 0.0)}
        m = smooth({f"ema_{n}": (close, span(n), 0) for n in (10, 12, 20, 26, 50, 200)} | {k: (v, 1 / 14, 14) for k, v in wilder.items()})
        rsi = np.where((m["loss"] == 0) & (m["gain"] > 0), 100.0, 100 - 100 / (1 + m["gain"] / known(m["loss"])))
        pdi, mdi = 100 * m["up"] / known(m["tr"]), 100 * m["down"] / known(m["tr"])
        macd = m["ema_12"] - m["ema_26"]
        late = smooth({"macd_signal": (macd, span(9), 0), "adx_wilder_14": (100 * np.abs(pdi - mdi) / known(pdi + mdi), 1 / 14, 14)})
    made = {k: m[k] for k in ("ema_10", "ema_20", "ema_50", "ema_200")} | {
        "macd": macd, "macd_signal": late["macd_signal"], "rsi_wilder_14": rsi, "atr_wilder_14": m["tr"], "adx_wilder_14": late["adx_wilder_14"]}
    out = {k: v[place, codes] for k, v in made.items()}
    return pd.DataFrame({"symbol": pdf["symbol"], "date": pdf["date"]} | out, index=pdf.index)


def _recursive_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Recursive averages of one symbol (rows bounded by the calendar)."""
    return _recursive_block(pdf.sort_values("date"))


def _recursive_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Recursive averages of rows sorted by symbol and date, some ``RECURSIVE_ROWS`` at a time; no symbol is cut."""
    held: list[pd.DataFrame] = []
    for pdf in frames:
        held.append(pdf)
        if sum(map(len, held)) < RECURSIVE_ROWS:
            continue
        rows = pd.concat(held, ignore_index=True)
        codes, names = pd.factorize(rows["symbol"], use_na_sentinel=False)
        cut = int((codes < len(names) - 1).sum())  # the last symbol may go on
        if cut:
            yield _recursive_block(rows.iloc[:cut])
        held = [rows.iloc[cut:]]
    if held:
        yield _recursive_block(pd.concat(held, ignore_index=True))


def recursive_features(panel: DataFrame) -> DataFrame:
    """EMA, MACD and the Wilder RSI / ATR / ADX, all from one sorted pass over the symbols.

    Rows are sorted by symbol and date (no date: last) and go on many symbols at a time, so a symbol costs no call of its own.
    """
    out = (
        panel.select("symbol", "date", "high", "low", "close")
        .repartition("symbol")
        .sortWithinPartitions("symbol", C("date").asc_nulls_last())
        .mapInPandas(_recursive_rows, RECURSIVE_SCHEMA)
    )
    doubles = [f.name for f in T._parse_datatype_string(RECURSIVE_SCHEMA) if f.name not in ("symbol", "date")]
    return out.withColumns({c: F.nanvl(C(c), F.lit(None).cast("double")) for c in doubles})


def add_stock_specific(df: DataFrame, s: Series = S) -> DataFrame:
    """Traded-value medians, range, close location, gap, abnormal volume, residual returns."""
    rng = C("high") - C("low")
    df = df.withColumns(
        {"traded_value": C("close") * C("volume"), "_vchg": s.change("volume"), "_pc": s.lag("close")}
    )
    out = {
        "median_traded_value_20d": s.roll(lambda v: F.percentile(v, 0.5), "traded_value", n=20, min_rows=10),
        "median_traded_value_60d": s.roll(lambda v: F.percentile(v, 0.5), "traded_value", n=60, min_rows=30),
        "traded_value_to_avg20": ratio("traded_value", s.mean("traded_value", 20, min_rows=10)),
        "intraday_range_pct": ratio(rng, "close"),
        "close_location_value": F.when(
            rng != 0,
            F.least(F.greatest(ratio(C("close") - C("low"), rng), F.lit(0.0)), F.lit(1.0)),
        ),
        "gap_pct": ratio("open", "_pc") - 1.0,
        "abnormal_volume": ratio("volume", s.mean("volume", 20, min_rows=10)),
        "volume_volatility_20d": s.std("_vchg", 20, min_rows=10),
    }
    for n in (20, 60):
        bench_ret = C(f"ret_{n}d") - C(f"rs_vs_bench_{n}d")
        out[f"residual_return_{n}d"] = (
            C(f"ret_{n}d") - 0.5 * bench_ret - 0.5 * C(f"sector_momentum_{n}d")
        )
    return df.withColumns(out).drop("_vchg", "_pc")


def _total(x: np.ndarray, n: int) -> np.ndarray:
    """Sum of the ``n`` values ending at each place, added from the first on as a window adds them; NaN where one is missing."""
    out = np.full(len(x), np.nan)
    if (m := len(x) - n + 1) > 0:
        out[n - 1 :] = x[:m]
        for k in range(1, n):
            out[n - 1 :] += x[k : k + m]
    return out


def _extreme(x: np.ndarray, n: int, join: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """``join`` (maximum or minimum) over the ``n`` values ending at each place, from frames of doubled length."""
    out, covered, size, rest = None, 0, 1, n
    while rest:
        if rest & 1:
            part = _back(x, covered)
            out = part if out is None else join(out, part)
            covered += size
        rest >>= 1
        if rest:
            x = join(x, _back(x, size))
            size *= 2
    return out


def _back(x: np.ndarray, n: int) -> np.ndarray:
    """The value ``n`` places before, NaN before the first."""
    out = np.full_like(x, np.nan)
    out[n:] = x[: max(len(x) - n, 0)]
    return out


def _deviation(x: np.ndarray, n: int) -> np.ndarray:
    """Sample deviation of the ``n`` values ending at each place, updated value by value as a window does: none on a flat frame."""
    out = np.full(len(x), np.nan)
    if (m := len(x) - n + 1) > 0 and n > 1:
        mean, squares = x[:m].copy(), np.zeros(m)
        for k in range(1, n):
            apart = x[k : k + m] - mean
            step = apart / (k + 1)
            mean += step
            squares += apart * (apart - step)
        out[n - 1 :] = np.sqrt(squares / (n - 1))
    return out


class _Rows:
    """Windows of :class:`Series` over arrays that hold whole series one after the other; ``row``: number in the series."""

    def __init__(self, row: np.ndarray):
        self.row = row

    def lag(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        return np.where(self.row > n, _back(x, n), np.nan)

    def change(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        return _ratio(x, self.lag(x, n)) - 1.0

    def diff(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        return x - self.lag(x, n)

    def full(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.where(self.row >= n, x, np.nan)

    def sum(self, x: np.ndarray, n: int) -> np.ndarray:
        return self.full(_total(x, n), n)

    def mean(self, x: np.ndarray, n: int) -> np.ndarray:
        return self.sum(x, n) / n

    def std(self, x: np.ndarray, n: int) -> np.ndarray:
        return self.full(_deviation(x, n), n)

    def max(self, x: np.ndarray, n: int) -> np.ndarray:
        return self.full(_extreme(x, n, np.maximum), n)

    def min(self, x: np.ndarray, n: int) -> np.ndarray:
        return self.full(_extreme(x, n, np.minimum), n)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.where(b != 0, b, np.nan)


def _rsi(s: _Rows, close: np.ndarray, n: int = 14) -> np.ndarray:
    move = s.diff(close)
    gain, loss = s.mean(np.maximum(move, 0.0), n), s.mean(np.maximum(-move, 0.0), n)
    return np.where((loss == 0) & (gain > 0), 100.0, np.where((loss == 0) & (gain == 0), 50.0, 100.0 - 100.0 / (1.0 + _ratio(gain, loss))))


def _directions(s: _Rows, high: np.ndarray, low: np.ndarray, atr: np.ndarray, n: int = 14) -> dict[str, np.ndarray]:
    up, down = s.diff(high), -s.diff(low)
    plus = 100.0 * _ratio(s.sum(np.where((up > down) & (up > 0), up, 0.0), n), atr)
    minus = 100.0 * _ratio(s.sum(np.where((down > up) & (down > 0), down, 0.0), n), atr)
    return {"plus_di_14": plus, "minus_di_14": minus, "adx_14": s.mean(100.0 * _ratio(np.abs(plus - minus), plus + minus), n)}


def _technical_block(x: dict[str, np.ndarray], row: np.ndarray) -> dict[str, np.ndarray]:
    """What :func:`technical_features` makes of whole series of a panel, whose benchmark closes stand beside."""
    s, close, high, low, volume, bench = _Rows(row), x["close"], x["high"], x["low"], x["volume"], x["bench_close"]
    with np.errstate(all="ignore"):
        o = {f"ret_{n}d": s.change(close, n) for n in RETURN_ROWS}
        o |= {f"sma_{n}": s.mean(close, n) for n in SMA_ROWS}
        o |= {f"price_to_sma_{n}": _ratio(close, o[f"sma_{n}"]) - 1.0 for n in SMA_ROWS}
        o["rsi_14"] = _rsi(s, close)
        prev = s.lag(close)
        tr = np.fmax(np.fmax(high - low, np.abs(high - prev)), np.abs(low - prev))
        o |= {f"atr_{n}": s.mean(tr, n) for n in (14, 50)}
        o |= _directions(s, high, low, o["atr_14"])
        o |= {f"volatility_{n}d": s.std(o["ret_1d"], n) for n in (20, 60, 120)}
        mid, sd = o["sma_20"], s.std(close, 20)
        o["bb_width_20"], o["bb_percent_b_20"] = _ratio(4.0 * sd, mid), _ratio(close - (mid - 2.0 * sd), 4.0 * sd)
        average, rose, fell = s.mean(volume, 20), o["ret_1d"] > 0, o["ret_1d"] < 0
        o["volume_to_avg20"], o["volume_trend_20d"] = _ratio(volume, average), _ratio(s.mean(volume, 5), average) - 1.0
        o["up_down_volume_ratio_20d"] = _ratio(s.sum(np.where(rose, volume, 0.0), 20), s.sum(np.where(fell, volume, 0.0), 20))
        o["price_return_x_volume_ratio"] = o["ret_20d"] * o["volume_to_avg20"]
        o["positive_price_volume_confirmation"] = ((o["ret_20d"] > 0) & (o["volume_to_avg20"] > 1)).astype(float)
        o["momentum_20d_vs_60d"], o["momentum_60d_vs_120d"] = o["ret_20d"] - o["ret_60d"], o["ret_60d"] - o["ret_120d"]
        o["momentum_20d_change"], o["volatility_20d_change"] = s.diff(o["ret_20d"], 20), s.diff(o["volatility_20d"], 20)
        o["volatility_20d_to_60d"], o["atr_14_to_atr_50"] = _ratio(o["volatility_20d"], o["volatility_60d"]), _ratio(o["atr_14"], o["atr_50"])
        o["bb_width_to_avg_120d"] = _ratio(o["bb_width_20"], s.mean(o["bb_width_20"], 120))
        for n in (20, 50, 100):
            prior = s.lag(s.max(high, n))
            o[f"distance_prev_{n}d_high"], o[f"breakout_prev_{n}d_high"] = _ratio(close, prior) - 1.0, (close > prior).astype(float)
        o["distance_52w_high"] = _ratio(close, s.max(high, 252)) - 1.0
        o["distance_52w_low"] = _ratio(close, s.min(low, 252)) - 1.0
        o |= {f"rs_vs_bench_{n}d": o[f"ret_{n}d"] - s.change(bench, n) for n in (20, 60, 120, 252)}
        o["relative_momentum_20d_change"] = s.diff(o["rs_vs_bench_20d"], 20)
        o["relative_momentum_20d_vs_60d"] = o["rs_vs_bench_20d"] - o["rs_vs_bench_60d"]
    return o


def _complete_block(rows: pa.Table, made: Sequence[str], keep: Sequence[str]) -> pa.Table:
    """Complete rows of whole symbols, sorted by symbol and date (no date: first), with the columns ``made``."""
    codes = rows["symbol"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    row = np.arange(len(codes)) - np.repeat(starts, np.diff(np.r_[starts, len(codes)])) + 1
    x = {c: rows[c].to_numpy().astype(float) for c in ("close", "high", "low", "volume", "bench_close")}
    o = _technical_block(x, row)
    dated = rows["date"].is_valid().to_numpy()
    days = rows["date"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    recursive = _recursive_block(pd.DataFrame({"symbol": codes[dated], "date": days[dated]} | {c: x[c][dated] for c in ("close", "high", "low")}))
    for c in RECURSIVE_COLUMNS:
        o[c] = np.full(len(codes), np.nan)
        o[c][dated] = recursive[c].to_numpy()
    missing = lambda own: np.isnan(np.column_stack([o[c] for c in BASE_FEATURES if (c in RECURSIVE_COLUMNS) == own])).any(axis=1)
    complete = dated & ~missing(False)
    with np.errstate(all="ignore"):
        s = _Rows(row)
        pairs = _pair_columns(o["ret_1d"], s.change(x["bench_close"]), row, BETA_ROWS, CORR_ROWS, complete)
    o |= {f"beta_{n}d": pairs[f"beta_{n}"] for n in BETA_ROWS} | {f"corr_bench_{n}d": pairs[f"corr_{n}"] for n in CORR_ROWS}
    of = at = np.flatnonzero(complete)
    first = np.r_[True, (codes[1:] != codes[:-1]) | (days[1:] != days[:-1]) | ~dated[:-1]][: len(codes)]
    if not first.all():  # a date that a symbol has twice meets all of its recursive rows, as in a join on both keys
        begin = np.flatnonzero(first)
        size = np.diff(np.r_[begin, len(codes)])
        place = np.cumsum(first)[at] - 1
        of = np.repeat(at, size[place])
        at = np.concatenate([np.empty(0, np.int64), *(np.arange(begin[p], begin[p] + size[p]) for p in place)])
    left = ~missing(True)[at]
    of, at = of[left], at[left]
    columns = [rows[c].take(pa.array(of)) for c in keep]
    columns += [pa.array(o[c][at if c in RECURSIVE_COLUMNS else of], pa.float64(), from_pandas=True) for c in made]
    return pa.table(columns, names=[*keep, *made])


def complete_features(panel: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``technical_features`` and ``recursive_features`` of the rows of a panel that have all of ``BASE_FEATURES``.

    ``panel`` has benchmark closes (``bench_close``); its columns ``carry`` stay. Rows are sorted by symbol and date and go on
    many symbols at a time, some ``RECURSIVE_ROWS`` rows; no symbol is cut, and a symbol's rows are bounded by the calendar.
    Sums and deviations go through a frame in the order of the windows, for all rows of a block at once, so they are equal to the bit.
    """
    keep = ["symbol", "date", "close", *carry]
    made = [*BASE_FEATURES, *(f for f in ADVANCED_FEATURES if not f.startswith("sector_"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < RECURSIVE_ROWS:
                continue
            rows = pa.Table.from_batches(held)
            codes = rows["symbol"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            cut = int(np.flatnonzero(codes != codes[-1]).max(initial=-1)) + 1  # the last symbol may go on
            if cut:
                yield from _complete_block(rows.slice(0, cut), made, keep).to_batches()
            held = rows.slice(cut).to_batches()
        if held and sum(x.num_rows for x in held):
            yield from _complete_block(pa.Table.from_batches(held), made, keep).to_batches()

    inputs = list(dict.fromkeys([*keep, "high", "low", "volume", "bench_close"]))
    doubles = {c: "double" for c in ("close", "high", "low", "volume", "bench_close")}
    types = dict(panel.dtypes) | {"close": "double"}
    sorted_rows = panel.select(*[C(c).cast(doubles[c]).alias(c) if c in doubles else C(c) for c in inputs]).repartition("symbol").sortWithinPartitions("symbol", "date")
    return sorted_rows.mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in keep], *[f"{c} double" for c in made]]))


BASE_FEATURES = [
    *[f"ret_{n}d" for n in RETURN_ROWS],
    *[f"sma_{n}" for n in SMA_ROWS],
    *[f"price_to_sma_{n}" for n in SMA_ROWS],
    "ema_20", "ema_50", "rsi_14", "macd", "macd_signal", "adx_14", "plus_di_14", "minus_di_14",
    "atr_14", "volatility_20d", "volatility_60d", "bb_width_20", "bb_percent_b_20",
    "volume_to_avg20", "distance_52w_high", "distance_52w_low",
    *[f"rs_vs_bench_{n}d" for n in (20, 60, 120, 252)],
]
SECTOR_FEATURES = [
    *[f"stock_vs_sector_ret_{n}d" for n in (20, 60, 120, 252)],
    "stock_volatility_relative_sector_20d", "stock_volatility_relative_sector_60d",
    "stock_distance_52w_high_relative_sector",
    *[f"sector_momentum_{n}d" for n in (20, 60, 120)],
    *[f"sector_strength_vs_bench_{n}d" for n in (20, 60, 120)],
]
REGIME_FEATURES = [
    *[f"bench_above_sma{n}" for n in (20, 50, 200)], "bench_sma50_sma200_trend",
    *[f"bench_ret_{n}d" for n in (20, 60, 120)], "bench_rsi_14", "bench_adx_14", "bench_atr_14",
    "bench_atr_pct_14", "bench_volatility_20d", "bench_volatility_60d", "bench_distance_52w_high",
    "market_regime_bull_trend", "market_regime_bear_trend", "market_regime_sideways",
    "market_regime_high_volatility", "market_breadth_above_sma50", "market_breadth_above_sma200",
    "market_breadth_positive_20d_return", "market_breadth_advance_decline_ratio",
]
ADVANCED_FEATURES = [
    "momentum_20d_vs_60d", "momentum_60d_vs_120d", "momentum_20d_change",
    "relative_momentum_20d_change", "relative_momentum_20d_vs_60d", "up_down_volume_ratio_20d",
    "price_return_x_volume_ratio", "volume_trend_20d", "positive_price_volume_confirmation",
    "volatility_20d_to_60d", "atr_14_to_atr_50", "bb_width_to_avg_120d", "volatility_20d_change",
    *[f"distance_prev_{n}d_high" for n in (20, 50, 100)],
    *[f"breakout_prev_{n}d_high" for n in (20, 50, 100)],
    "sector_above_sma50", "sector_above_sma200", "sector_rsi_14", "sector_volatility_120d",
    "sector_regime_bull", "sector_regime_bear", "sector_regime_sideways",
    *[f"beta_{n}d" for n in (60, 120, 252)], *[f"corr_bench_{n}d" for n in (20, 60, 120)],
]
VARIANTS = {
    "baseline": BASE_FEATURES,
    "sector": BASE_FEATURES + SECTOR_FEATURES,
    "sector_regime": BASE_FEATURES + SECTOR_FEATURES + REGIME_FEATURES,
    "advanced": BASE_FEATURES + SECTOR_FEATURES + REGIME_FEATURES + ADVANCED_FEATURES,
}


def technical_features(panel: DataFrame, bench: DataFrame | None = None, s: Series = S) -> DataFrame:
    """All window features of a panel, without the recursive ones."""
    df = add_trend(add_returns(panel, s), s)
    df = add_adx(add_atr(add_rsi(df, s), s), s)
    df = add_extremes(add_momentum(add_volume(add_volatility(df, s), s), s), s)
    return df if bench is None else add_benchmark(df, bench, s)


def feature_matrix(panel: DataFrame, bench: DataFrame, variant: str = "advanced", carry: Sequence[str] = ()) -> DataFrame:
    """Feature matrix keyed by (date, symbol); rows lacking a base feature are dropped.

    ``panel`` carries a ``sector`` column; its columns ``carry`` stay. Sector and regime tables hold one row
    per (date, sector) and per date; they are broadcast, so the wide rows are never shuffled.
    """
    if variant not in VARIANTS:
        raise ValueError(f"unknown feature variant {variant!r}")
    keep = VARIANTS[variant]
    closes = bench.select("date", C("close").alias("bench_close"))
    df = complete_features(panel.join(F.broadcast(closes), "date", "left"), [*(["sector"] if variant != "baseline" else []), *carry])
    if variant != "baseline":
        df = add_sector_relative(df, sector_series_features(equal_weight_sectors(panel)))
    if variant in ("sector_regime", "advanced"):
        df = df.join(F.broadcast(market_regime_features(bench, breadth_by_date(panel))), "date", "left")
    return df.select("date", "symbol", "close", *keep, *carry)
