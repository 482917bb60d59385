"""Chart patterns of the latest bar of every symbol.

Window patterns use row frames. Swing patterns look at positions inside the last few
dozen bars, held as one array per symbol (at most ``TAIL`` structs), and stay in the JVM.
The ZigZag, a true recursion, folds one array of closes per symbol; its length is that of the calendar.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.rolling import Series, Tail, flag, ratio
from barloom.sources.staging import stage

C = F.col
S = Series("symbol", "date")
TAIL = 120


def darvas_box(df: DataFrame, lookback: int = 20, volume_multiple: float = 1.2) -> DataFrame:
    """Box of the prior rows and the state of each bar against it."""
    df = df.withColumns(
        {
            "box_top": S.max("high", lookback, end=-1),
            "box_bottom": S.min("low", lookback, end=-1),
            "_av": F.avg("volume").over(S.frame(lookback, -1)),
        }
    )
    confirmed = F.coalesce((C("_av") > 0) & (C("volume") >= C("_av") * volume_multiple), F.lit(False))
    c, top, bottom = C("close"), C("box_top"), C("box_bottom")
    return df.withColumns(
        {
            "volume_confirmed": confirmed,
            "box_status": F.when(top.isNull(), None).when((c > top) & confirmed, "Breakout")
            .when(c < bottom, "Breakdown").when(c >= top * 0.98, "Near breakout")
            .when((c >= bottom) & (c <= top), "In box").otherwise("Outside box"),
            "box_height_pct": ratio(top - bottom, c),
        }
    ).drop("_av")


def last_bars(panel: DataFrame, n: int = TAIL) -> DataFrame:
    """Per symbol: the last ``n`` bars as an array, the bar count and the prior all-time high."""
    w = Window.partitionBy("symbol")
    df = panel.withColumns(
        {"_pos": S.position(), "_n": F.count(F.lit(1)).over(w), "_ph": F.max("high").over(
            S.w.rowsBetween(Window.unboundedPreceding, -1))}
    )
    tail = df.where(C("_pos") > C("_n") - n)
    bar = F.struct("date", "open", "high", "low", "close", "volume")
    return tail.groupBy("symbol").agg(
        F.max("_n").alias("bars_seen"), F.sort_array(F.collect_list(bar)).alias("b"),
        F.max(F.struct("date", "_ph"))["_ph"].alias("life_high"),
        F.max("date").alias("date"),
    )


def _take(b: Column, n: Column | int) -> Column:
    """Last ``n`` elements (all of them when fewer)."""
    k = F.least(F.size(b), F.lit(n) if isinstance(n, int) else n)
    return F.slice(b, F.size(b) - k + 1, k)


def _vals(b: Column, f: str) -> Column:
    return F.transform(b, lambda x: x[f])


def _hi(b: Column, f: str) -> Column:
    return F.array_max(_vals(b, f))


def _lo(b: Column, f: str) -> Column:
    return F.array_min(_vals(b, f))


def _part(b: Column, start: Column | int, stop: Column | int) -> Column:
    """Elements start..stop-1, zero based."""
    s = F.lit(start) if isinstance(start, int) else start
    e = F.lit(stop) if isinstance(stop, int) else stop
    return F.slice(b, s + 1, F.greatest(e - s, F.lit(0)))


def _last(b: Column, f: str) -> Column:
    return F.element_at(b, -1)[f]


def _first_at(values: Column, v: Column) -> Column:
    """Zero-based position of the first element equal to ``v``."""
    return (F.array_position(values, v) - 1).cast("int")


def swing_patterns(tails: DataFrame) -> DataFrame:
    """Life high, breakout-retest, Fibonacci pullback, high-dry-fry base and 1-2-3 bottom."""
    n = C("bars_seen")
    df = tails.withColumns(
        {"c": _last(C("b"), "close"), "w90": _take(C("b"), 90), "w70": _take(C("b"), 70),
         "w80": _take(C("b"), 80), "w35": _take(C("b"), 35)}
    )
    df = df.withColumns(
        {
            "rt_level": _hi(_part(C("w35"), 0, 27), "high"),
            "f_low_at": _first_at(_vals(C("w90"), "low"), _lo(C("w90"), "low")),
            "h_peak_at": _first_at(_vals(C("w70"), "high"), _hi(_part(C("w70"), 0, F.size("w70") - 5), "high")),
            "d_first_at": _first_at(_vals(C("w80"), "low"), _lo(_part(C("w80"), 0, F.size("w80") - 10), "low")),
        }
    )
    after_low = _part(C("w90"), C("f_low_at"), F.size("w90"))
    after_first = _part(C("w80"), C("d_first_at") + 5, F.size("w80"))
    df = df.withColumns(
        {
            "f_after": F.size(after_low), "f_high": _hi(after_low, "high"), "f_low": _lo(C("w90"), "low"),
            "f_high_at": C("f_low_at") + _first_at(_vals(after_low, "high"), _hi(after_low, "high")),
            "h_pre": _part(C("w70"), 0, C("h_peak_at") + 1), "h_base": _take(C("w70"), 6),
            "h_post_low": _lo(_part(C("w70"), C("h_peak_at"), F.size("w70")), "low"),
            "d_after": F.size(after_first),
            # position counted from the start of the 80-bar window
            "d_second_at": C("d_first_at") + 5 + _first_at(_vals(after_first, "low"), _lo(after_first, "low")),
        }
    )

    df = df.withColumns(
        {
            "h_peak": F.element_at("w70", C("h_peak_at") + 1)["high"],
            "h_low": _lo(C("h_pre"), "low"),
            "h_base_high": _hi(_part(C("h_base"), 0, 5), "high"),
            "h_vol": F.aggregate(_vals(C("w70"), "volume"), F.lit(0.0), lambda a, x: a + x) / F.size("w70"),
            "h_peak_vol": _hi(_part(C("w70"), F.greatest(F.lit(0), C("h_peak_at") - 2), C("h_peak_at") + 1), "volume"),
            "d_first": F.element_at("w80", C("d_first_at") + 1)["low"],
            "d_second": F.when(C("d_after") >= 1, F.try_element_at("w80", C("d_second_at") + 1)["low"]),
            "d_neck": _hi(_part(C("w80"), C("d_first_at"), C("d_second_at")), "high"),
        }
    )
    recent = _take(C("w35"), 8)
    broke = F.exists(_part(recent, 0, 6), lambda x: x["close"] > C("rt_level") * 1.01)
    retested = F.exists(_take(recent, 5), lambda x: x["low"] <= C("rt_level") * 1.03)
    c = C("c")
    fib = ratio(C("f_high") - c, C("f_high") - C("f_low"))
    rise = ratio(C("h_peak") - C("h_low"), "h_low")
    correction = ratio(C("h_peak") - C("h_post_low"), "h_peak")
    base_range = ratio(_hi(C("h_base"), "high") - _lo(C("h_base"), "low"), _last(C("h_base"), "close"))
    pop = (C("h_vol") > 0) & (C("h_peak_vol") >= C("h_vol") * 1.4)

    def pattern(ok, name, status, confidence, start, levels):
        return F.when(F.coalesce(ok, F.lit(False)), F.struct(
            F.lit(name).alias("name"), status.alias("status"), confidence.alias("confidence"),
            start.cast("int").alias("start_index"), (n - 1).cast("int").alias("end_index"),
            F.create_map(*[x for k, v in levels.items() for x in (F.lit(k), v.cast("double"))]).alias("levels")))

    found = F.array_compact(F.array(
        pattern(
            (n >= 30) & (C("life_high") > 0) & (c >= C("life_high") * 0.98), "Life High / Uncharted Territory",
            F.when(c > C("life_high"), "Breakout").otherwise("Near life high"),
            F.when(c > C("life_high"), 0.7).otherwise(0.55), F.lit(0), {"life_high": C("life_high")}),
        pattern(
            (n >= 35) & (C("rt_level") > 0) & broke & retested & (c >= C("rt_level")), "Darvas Breakout-Retest",
            F.lit("Retest holding"), F.lit(0.72), n - 35, {"retest_level": C("rt_level")}),
        pattern(
            (n >= 35) & (C("f_after") >= 8) & (C("f_high") > C("f_low")) & (C("f_high_at") < F.size("w90") - 2)
            & (fib >= 0.47) & (fib <= 0.65), "Fibonacci 50-61.8 Pullback", F.lit("In golden pullback zone"),
            F.lit(0.66), F.greatest(F.lit(0), n - F.size("w90") + C("f_low_at")),
            {"fib_50": C("f_high") - (C("f_high") - C("f_low")) * 0.5,
             "fib_618": C("f_high") - (C("f_high") - C("f_low")) * 0.618, "swing_high": C("f_high")}),
        pattern(
            (n >= 45) & (F.size("h_pre") >= 8) & rise.between(0.18, 0.65) & correction.between(0.08, 0.28)
            & (base_range <= 0.09), "DarvaX High-Dry-Fry Base",
            F.when(c > C("h_base_high"), "Base breakout").otherwise("Tight base after dry fry"),
            F.when(pop, 0.74).otherwise(0.6), F.greatest(F.lit(0), n - F.size("w70") + C("h_peak_at")),
            {"peak": C("h_peak"), "base_high": C("h_base_high"), "base_low": _lo(C("h_base"), "low")}),
        pattern(
            (n >= 40) & (C("d_after") >= 12) & (C("d_first") > 0)
            & (F.abs(ratio(C("d_second") - C("d_first"), "d_first")) <= 0.04) & (c >= C("d_neck") * 0.99),
            "1-2-3 / Double Bottom", F.when(c > C("d_neck"), "Neckline breakout").otherwise("At neckline"),
            F.lit(0.64), F.greatest(F.lit(0), n - F.size("w80") + C("d_first_at")),
            {"neckline": C("d_neck"), "first_low": C("d_first"), "second_low": C("d_second")}),
    ))
    return df.select("symbol", "date", "bars_seen", "c", found.alias("patterns"))


def detected_patterns(panel: DataFrame) -> DataFrame:
    """(symbol, pattern) rows of the latest bar, the Darvas box included."""
    box = darvas_box(panel)
    last = box.groupBy("symbol").agg(
        F.max(F.struct("date", "box_status", "box_top", "box_bottom")).alias("x"), F.count(F.lit(1)).alias("n")
    )
    darvas = last.where(C("x.box_status").isNotNull() & (C("n") >= 21)).select(
        "symbol", C("x.date").alias("date"), F.lit("Darvas Box").alias("name"), C("x.box_status").alias("status"),
        F.when(C("x.box_status") == "Breakout", 0.78).otherwise(0.62).alias("confidence"),
        F.greatest(F.lit(0), C("n") - 21).cast("int").alias("start_index"), (C("n") - 1).cast("int").alias("end_index"),
        F.create_map(F.lit("top"), C("x.box_top"), F.lit("bottom"), C("x.box_bottom")).alias("levels"),
    )
    # one small row per symbol: written once, so later filters do not copy the long expressions
    rows = stage(swing_patterns(last_bars(panel)).select("symbol", "date", "patterns"), "patterns")
    other = rows.select("symbol", "date", F.explode("patterns").alias("p")).select("symbol", "date", "p.*")
    return darvas.unionByName(other)


def visible(patterns: DataFrame, last_index: str, window: int = 3) -> DataFrame:
    return patterns.where(C(last_index) - C("end_index") <= window)


# ZigZag and VCP ---------------------------------------------------------------

_POINT = "struct<at:int,kind:string,price:double>"


def _side_name(side: Column) -> Column:
    return F.when(side > 0, "high").otherwise("low")


def _point(at: Column, side: Column, price: Column) -> Column:
    return F.array(F.struct(at.alias("at"), _side_name(side).alias("kind"), price.alias("price"))).cast(f"array<{_POINT}>")


def zigzag_points(bars: Column, share: float = 0.03) -> Column:
    """Swing points of an ordered array of ``(close, band)``: the last extreme before each reversal, then the open one.

    A reversal is a move against the extreme of at least ``band`` and ``share`` of the extreme. Before the first one no
    extreme is followed. A close that is null changes nothing, a band that is null counts as zero.
    """
    state = "struct<i:int,side:int,at:int,top:double,points:array<" + _POINT + ">>"
    start = F.struct(
        F.lit(0).alias("i"), F.lit(0).alias("side"), F.lit(0).alias("at"), F.lit(None).cast("double").alias("top"),
        F.array().cast(f"array<{_POINT}>").alias("points")).cast(state)

    def step(a, b):
        x, side, top = b["close"], a["side"], a["top"]
        need = F.greatest(F.coalesce(b["band"], F.lit(0.0)), top * share)
        opens = (side == 0) & (F.abs(x - top) >= need)
        on = (side != 0) & ((x - top) * side >= 0)
        turns = (side != 0) & ~on & ((top - x) * side >= need)
        first = top.isNull() & x.isNotNull()
        moved = opens | on | turns | first
        return F.struct(
            (a["i"] + 1).alias("i"),
            F.when(opens, F.when(x > top, 1).otherwise(-1)).when(turns, -side).otherwise(side).alias("side"),
            F.when(moved, a["i"]).otherwise(a["at"]).alias("at"),
            F.when(moved, x).otherwise(top).alias("top"),
            F.when(turns, F.concat(a["points"], _point(a["at"], side, top))).otherwise(a["points"]).alias("points"),
        )  # of the type of the start: a cast would copy all points at every bar

    def end(a):
        return F.when(a["side"] != 0, F.concat(a["points"], _point(a["at"], a["side"], a["top"]))).otherwise(a["points"])

    return F.aggregate(bars, start, step, end)


def dedupe_swings(swings: Column) -> Column:
    """Adjacent swings of one kind become the most extreme of them, the first one among equals."""

    def step(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        better = F.when(s["kind"] == "high", s["price"] > last["price"]).otherwise(s["price"] < last["price"])
        head = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when((F.size(acc) == 0) | (last["kind"] != s["kind"]), F.concat(acc, F.array(s))).when(
            better, F.concat(head, F.array(s))).otherwise(acc)

    return F.aggregate(swings, F.array().cast(f"array<{_POINT}>"), step)


def local_extrema(closes: Column, radius: int = 2) -> Column:
    """Closes that are the highest (else the lowest) of the ``radius`` closes on both sides, one per run of a kind.

    A plateau counts as a high; the closes within ``radius`` of an end have no full neighbourhood. Fewer than 20 closes
    have no extremes.
    """

    def points(known: Column) -> Column:
        n = F.size(known)
        places = F.when(n >= 20, F.sequence(F.lit(radius), n - 1 - radius)).otherwise(F.array().cast("array<int>"))

        def point(i):
            near, x = F.slice(known, i - radius + 1, F.lit(2 * radius + 1)), F.element_at(known, i + 1)
            kind = F.when(x == F.array_max(near), "high").when(x == F.array_min(near), "low")
            return F.struct(i.alias("at"), kind.alias("kind"), x.alias("price")).cast(_POINT)

        return F.filter(F.transform(places, point), lambda p: p["kind"].isNotNull())

    # as the variable of a lambda the closes are made once, not again at every place
    return dedupe_swings(F.flatten(F.transform(F.array(closes), points)))


def zigzag_swings(panel: DataFrame, lookback: int = 120) -> DataFrame:
    """Alternating swings of every symbol with a reversal of max(2 ATR, 3 %), and the local extremes of its last closes.

    One row per symbol: ``swings`` from the whole series, ``extrema`` from the last ``lookback`` closes. The closes of a
    symbol meet in one array, so its length is bounded by the calendar, however many rows fed the bars.
    """
    from barloom.operators.features import add_atr

    df = add_atr(panel, S, (14,)).select("symbol", "date", "close", "atr_14")
    bars = F.array_sort(F.collect_list(F.struct("date", "close", (C("atr_14") * 2).alias("band"))))
    df = df.groupBy("symbol").agg(F.max("date").alias("date"), bars.alias("_b"))
    closes = F.transform(_take(C("_b"), lookback), lambda b: b["close"])
    return df.select(
        "symbol", "date", F.size("_b").alias("bars"), dedupe_swings(zigzag_points(C("_b"))).alias("swings"),
        local_extrema(closes).alias("extrema"))


def _pullbacks(swings: Column, least: float) -> Column:
    """High-to-low moves between neighbours of ``least``..45 %, the last five."""
    pairs = F.filter(
        F.arrays_zip(_part(swings, 0, F.size(swings) - 1).alias("a"), _part(swings, 1, F.size(swings)).alias("z")),
        lambda p: (p["a"]["kind"] == "high") & (p["z"]["kind"] == "low") & (p["a"]["price"] > 0))
    pull = F.transform(pairs, lambda p: (p["a"]["price"] - p["z"]["price"]) / p["a"]["price"] * 100)
    return _take(F.filter(pull, lambda v: (v >= least) & (v <= 45)), 5)


def contractions(swings: Column) -> Column:
    """High-to-low pullbacks of 2..45 % among the last twelve swings, at most five."""
    return _pullbacks(_take(swings, 12), 2)


def local_contractions(extrema: Column) -> Column:
    """Pullbacks of 1..45 % between local extremes, at most five: the fallback of a series with too few swings."""
    return _pullbacks(extrema, 1)


def contraction_sequence(swings: Column, extrema: Column) -> Column:
    """Tightening pullbacks of the swings, or of the local extremes where the swings give fewer than two."""
    zig = contractions(swings)
    return tightening(F.when(F.size(zig) >= 2, zig).otherwise(local_contractions(extrema)))


def with_contractions(swings: DataFrame) -> DataFrame:
    """``sequence`` and its ``source``: swings, or local where these give fewer than two pullbacks."""
    src = F.when(F.size(contractions(C("swings"))) >= 2, "swings").otherwise("local")
    return swings.withColumns({"source": src, "sequence": contraction_sequence(C("swings"), C("extrema"))})


def swing_pivot(swings: Column) -> Column:
    """Highest of the last three highs among the last eight swings; NULL without one."""
    return F.array_max(_take(F.transform(F.filter(_take(swings, 8), lambda x: x["kind"] == "high"), lambda x: x["price"]), 3))


def recent_high(panel: DataFrame, rows: int = 20) -> DataFrame:
    """Highest high of the last ``rows`` bars of every symbol that has so many."""
    df = panel.withColumn("_h", S.max("high", rows))
    return df.groupBy("symbol").agg(F.max_by("_h", "date").alias("recent_high"))


def shrinks(values: Column) -> Column:
    """Whether each pullback is at most 85 % of the one before."""
    n = F.size(values)
    return F.aggregate(
        F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.coalesce(
            F.try_element_at(values, i) <= F.try_element_at(values, i - 1) * 0.85, F.lit(True))),
        F.lit(True), lambda a, x: a & x)


def tightening(values: Column) -> Column:
    """Greedy decreasing subsequence: a value between the last two replaces the last."""
    empty = F.array().cast("array<double>")

    def step(acc, v):
        k = F.size(acc)
        last, before = F.try_element_at(acc, F.lit(-1)), F.try_element_at(acc, F.lit(-2))
        return F.when((k == 0) | (v < last), F.concat(acc, F.array(v))).when(
            (k >= 2) & (v < before), F.concat(F.slice(acc, F.lit(1), F.greatest(k - 1, F.lit(0))), F.array(v))
        ).otherwise(acc)

    return _take(F.aggregate(values, empty, step), 5)


def vcp_scan(panel: DataFrame, bench: DataFrame) -> DataFrame:
    """Volatility-contraction scan: gates, weighted components, trigger and action score.

    Fundamental and institutional components enter as zero here; see ``vcp_adjusted``.
    """
    from barloom.operators.features import add_atr

    df = panel.join(bench.select("date", C("close").alias("_b")), "date", "left")
    df = add_atr(df, S, (14,)).withColumns(
        {"_mid": S.mean("close", 20), "_sd": S.std("close", 20), "_r": S.change("close"), "_v20": S.mean("volume", 20),
         "history": S.position(), "_diff": S.diff("close"), "_rows": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    df = df.withColumns(
        {
            "_atrp": ratio("atr_14", "close") * 100, "_bbw": ratio(4 * C("_sd"), "_mid") * 100, "_ratio": ratio("close", "_b"),
            "_dist": flag((C("_r") < -0.02) & (C("volume") > C("_v20") * 1.5)), "_back_rows": C("_rows") - C("history"),
        }
    )
    # only the last row of a symbol counts: one pass over the rows before it instead of long frames over every row
    t = Tail()
    keep = [*[c for c in panel.columns if c not in ("symbol", "open")], "prev_close", "tr", "atr_14", "history", "_b", "_v20", "_ratio"]
    latest = df.where((C("_rows") >= 220) & (C("_back_rows") < 252)).groupBy("symbol").agg(
        *[t.at(c).alias(c) for c in keep],
        *[t.mean("close", n).alias(f"_s{n}") for n in (50, 150, 200)], t.mean("close", 200, end=-20).alias("_s200p"),
        t.mean("volume", 5).alias("_v5"), F.max(t.inside("high", 252)).alias("_high52"),
        t.mean("_atrp", 15).alias("_a1"), t.mean("_atrp", 15, end=-45).alias("_a0"),
        t.mean("_bbw", 15).alias("_w1"), t.mean("_bbw", 15, end=-45).alias("_w0"),
        t.max("high", 10).alias("_h10"), t.min("low", 10).alias("_l10"), t.max("high", 20).alias("_h20"),
        F.sum(t.inside(F.when(C("_diff") > 0, C("volume")).otherwise(0.0), 50)).alias("_up"),
        F.sum(t.inside(F.when(C("_diff") < 0, C("volume")).otherwise(0.0), 50)).alias("_down"),
        t.at("close", 62).alias("_c62"), t.at("_b", 62).alias("_b62"),
        F.max(t.inside("_ratio", 126)).alias("_rsmax"), F.sum(t.inside("_dist", 10)).alias("_ndist"),
    )
    latest = latest.withColumns({
        "_rng": ratio(C("_h10") - C("_l10"), "close") * 100, "_rs": ratio("close", "_c62") - ratio("_b", "_b62")})
    # the folds run once: written before later filters copy them
    sw = stage(zigzag_swings(panel).select("symbol", "swings", "extrema"), "swings")
    j = latest.join(sw, "symbol")
    j = stage(j.withColumn("contractions", contraction_sequence(C("swings"), C("extrema"))).drop("extrema"), "vcp")
    yes = lambda c: F.coalesce(c, F.lit(False))
    n, shrink = F.size("contractions"), shrinks(C("contractions"))
    c = C("close")
    j = j.withColumns(
        {
            "pivot": F.coalesce(swing_pivot(C("swings")), C("_h20")),
            "trend_ok": yes((c > C("_s50")) & (C("_s50") > C("_s150")) & (C("_s150") > C("_s200")) & (C("_s200") > C("_s200p"))),
            "near_high": yes(c >= C("_high52") * 0.90),
            "contractions_ok": (n >= 2) & (n <= 5) & shrink,
            "final_ok": yes(F.try_element_at("contractions", F.lit(-1)) <= 8),
            "volatility_ok": yes((C("_a1") < C("_a0")) & (C("_w1") < C("_w0"))),
            "tight_ok": yes(C("_rng") <= 8), "dry_up": yes((C("_v20") > 0) & (C("_v5") < C("_v20") * 0.75)),
            "up_volume_ok": yes(C("_up") > C("_down")), "rs_ok": yes(C("_rs") >= 0.02),
            "rs_new_high": yes(C("_ratio") >= C("_rsmax") * 0.995), "distribution": yes(C("_ndist") >= 2),
        }
    )
    j = j.withColumn("distance_to_pivot", F.round(ratio(C("pivot") - c, "pivot") * 100 * 1.000000000001, 2))
    d = C("distance_to_pivot")
    j = j.withColumns(
        {"near_pivot": yes((d >= -3) & (d <= 5)), "breakout": yes((c > C("pivot")) & (C("volume") >= C("_v20") * 1.5))})
    pts = lambda cond, a, b=0.0: F.when(cond, a).otherwise(b)
    trend = pts(C("trend_ok"), 70.0, 20.0) + pts(C("near_high"), 30.0)
    quality = F.when(n == 0, 0.0).otherwise(F.least(F.lit(100.0), pts(C("contractions_ok"), 45.0, 25.0)
                                            + pts(C("final_ok"), 30.0) + pts(C("near_pivot"), 25.0)))
    vol = pts(C("volatility_ok"), 60.0, 20.0) + pts(C("tight_ok"), 40.0)
    volume = pts(C("dry_up"), 65.0, 20.0) + pts(C("up_volume_ok"), 35.0)
    rs = F.least(F.lit(100.0), pts(C("rs_ok"), 60.0, 20.0) + 10.0 + pts(C("rs_new_high"), 15.0))
    raw = F.round(trend * 0.15 + quality * 0.25 + vol * 0.15 + volume * 0.15 + rs * 0.15, 2)
    # without the confirmed dry-fry base the score is capped at 74, with distribution at 45
    capped = F.least(raw, F.when(C("distribution"), 45.0).otherwise(74.0))
    trigger = F.when(C("breakout"), 100.0).when(C("pivot").isNull(), 0.0).when(
        C("near_pivot"), F.round(F.greatest(F.lit(65.0), 95.0 - F.greatest(d, F.lit(0.0)) * 6), 1)
    ).when(d > 5, F.round(F.greatest(F.lit(0.0), 60.0 - (d - 5) * 5), 1)).otherwise(35.0)
    j = j.withColumns({"rs_score": rs, "vcp_score": F.round(capped, 1), "trigger_score": trigger})
    j = j.withColumn("action_score", F.round(C("vcp_score") * 0.8 + C("trigger_score") * 0.2, 1))
    return j.drop(*[x for x in j.columns if x.startswith("_")])


def vcp_adjusted(scan: DataFrame, holding_scores: DataFrame) -> DataFrame:
    """Institutional component (10 %) from shareholding changes; missing holdings are listed."""
    j = scan.join(holding_scores.select("symbol", "institutional_component"), "symbol", "left")
    part = F.coalesce("institutional_component", F.lit(0.0)) * 0.10
    return j.withColumns(
        {
            "vcp_score": F.round(F.least(F.lit(100.0), C("vcp_score") + part), 1),
            "missing": F.array_compact(F.array(F.when(C("institutional_component").isNull(), F.lit("shareholding")))),
        }
    )


# Dual-listed Darvas -----------------------------------------------------------


@dataclass(frozen=True)
class DarvasConfig:
    lookback: int = 20
    min_height_pct: float = 3.0
    max_height_pct: float = 35.0
    touch_pct: float = 1.0
    volume_ratio_min: float = 1.5
    close_location_min: float = 0.70
    late_pct: float = 3.0
    late_atr: float = 1.0
    retest_pct: float = 1.0
    costs_pct: float = 0.40
    slippage_pct: float = 0.15


def darvas_setups(panel: DataFrame, cfg: DarvasConfig | None = None) -> DataFrame:
    """Latest valid box among ends 1..11 bars back, entry state, reward/risk and decision."""
    cfg = cfg or DarvasConfig()
    from barloom.operators.features import add_atr

    ok = (C("high") >= C("low")) & (C("high") >= C("close")) & (C("close") >= C("low"))
    clean = panel.where(ok & C("volume").isNotNull())
    df = add_atr(clean, S, (14,))
    w = Window.partitionBy("symbol")
    df = df.withColumns({"_pos": S.position(), "_n": F.count(F.lit(1)).over(w)})
    highs = F.max("high").over(S.w.rowsBetween(Window.unboundedPreceding, -1))
    tail = df.withColumn("_h", highs).where(C("_pos") > C("_n") - 75)
    bar = F.struct("date", "open", "high", "low", "close", "volume")
    g = tail.groupBy("symbol").agg(
        F.max("_n").alias("n"), F.sort_array(F.collect_list(bar)).alias("b"),
        F.max(F.struct("date", "atr_14"))["atr_14"].alias("atr"), F.max("date").alias("date"),
    ).where(C("n") >= cfg.lookback + 20)
    size = F.size("b")
    half = cfg.lookback // 2
    med = lambda a: (F.element_at(a, half // 2) + F.element_at(a, half // 2 + 1)) / 2 if half % 2 == 0 else F.element_at(a, half // 2 + 1)

    def box(k):
        """Box whose last bar lies ``k`` bars before the latest one."""
        end = size - 1 - k
        bars = _part(C("b"), end - cfg.lookback + 1, end + 1)
        start_abs = C("n") - 1 - k - cfg.lookback + 1
        prior = _part(C("b"), F.greatest(F.lit(0), end - cfg.lookback + 1 - F.least(start_abs, F.lit(40))), end - cfg.lookback + 1)
        vols = _vals(bars, "volume")
        return F.struct(
            k.alias("k"), bars.alias("bars"), _hi(bars, "high").alias("top"), _lo(bars, "low").alias("bottom"),
            start_abs.alias("start"), prior.alias("prior"),
            (med(F.sort_array(F.slice(vols, cfg.lookback - half + 1, half))) < med(F.sort_array(F.slice(vols, 1, half)))).alias("contraction"))

    def measured(x):
        t, bt = x["top"], x["bottom"]
        height = (t - bt) / bt * 100
        up = F.size(F.filter(x["bars"], lambda r: r["high"] >= t * (1 - cfg.touch_pct / 100)))
        lo = F.size(F.filter(x["bars"], lambda r: r["low"] <= bt * (1 + cfg.touch_pct / 100)))
        trend = F.when(x["start"] < 20, True).when(F.size(x["prior"]) < 10, True).otherwise(
            F.element_at(x["prior"], -1)["close"] > F.element_at(x["prior"], 1)["close"] * 1.05)
        score = F.least(F.lit(100.0), 35.0 + up * 8.0 + lo * 6.0 + F.when(x["contraction"], 15.0).otherwise(0.0)
                        + F.when(height <= 20, 10.0).otherwise(0.0))
        good = (
            (bt > 0) & (t > bt) & (height >= cfg.min_height_pct) & (height <= cfg.max_height_pct) & (up >= 2) & (lo >= 1)
            & ~F.exists(x["bars"], lambda r: r["close"] < bt) & trend)
        return F.struct(
            good.alias("good"), F.round(t, 4).alias("top"), F.round(bt, 4).alias("bottom"), up.alias("up"), lo.alias("lo"),
            F.round(score, 2).alias("score"), x["k"].alias("k"))

    ks = F.sequence(F.lit(1), F.least(F.lit(11), (C("n") - cfg.lookback - 2).cast("int")))
    boxes = F.transform(F.transform(ks, box), measured)
    g = g.withColumn("x", F.try_element_at(F.filter(boxes, lambda q: q["good"]), F.lit(1)))
    g = stage(g, "darvas-boxes")
    g = g.where(C("x").isNotNull() & (C("atr") > 0)).withColumns(
        {"top": C("x.top"), "bottom": C("x.bottom"), "atr14": F.round("atr", 4), "quality": C("x.score"),
         "upper_touches": C("x.up"), "lower_touches": C("x.lo"), "l": F.element_at("b", -1),
         "avg20": F.aggregate(_vals(_take(C("b"), 20), "volume"), F.lit(0.0), lambda a, v: a + v) / 20})
    top = C("top")
    buffer = F.greatest(top * 0.0025, C("atr14") * 0.10)
    loc = lambda r: (r["close"] - r["low"]) / F.greatest(r["high"] - r["low"], F.lit(0.0001))
    strong = lambda r: (r["volume"] >= C("avg20") * cfg.volume_ratio_min) & (loc(r) >= cfg.close_location_min)
    recent = _take(C("b"), 10)
    g = g.withColumns(
        {
            "volume_ratio": ratio(C("l.volume"), "avg20"), "_buffer": buffer,
            "extension_pct": F.greatest(F.lit(0.0), ratio(C("l.close") - top, top)) * 100,
            "extension_atr": F.greatest(F.lit(0.0), ratio(C("l.close") - top, "atr14")),
            "_strong": strong(C("l")),
            "_hit": F.try_element_at(F.filter(
                F.transform(recent, lambda r, i: F.struct(i.alias("i"), r.alias("r"))),
                lambda q: (q["r"]["close"] > top + buffer) & strong(q["r"])), F.lit(1)),
        }
    )
    lc, late = C("l.close"), (C("extension_pct") > cfg.late_pct) | (C("extension_atr") > cfg.late_atr)
    had = C("_hit").isNotNull()
    earlier = had & (C("_hit.i") < F.size(recent) - 1)
    retest = (
        (C("l.low") <= top * (1 + cfg.retest_pct / 100)) & (lc > top) & (lc > C("l.open"))
        & (C("l.volume") < C("_hit.r.volume")))
    state = (
        F.when(lc < C("bottom"), "INVALID_BOX").when(had & (lc < top), "FAILED_BREAKOUT")
        .when(earlier & retest & late, "LATE_ENTRY").when(earlier & retest, "RETEST_CONFIRMED")
        .when(earlier, "RETEST_PENDING").when((lc > top + C("_buffer")) & late, "LATE_ENTRY")
        .when((lc > top + C("_buffer")) & C("_strong"), "BREAKOUT_CONFIRMED").when(lc > top + C("_buffer"), "RETEST_PENDING")
        .when((C("l.high") >= top) & (lc <= top), "RETEST_PENDING")
        .when((lc >= top * 0.98) & (lc <= top), "PRE_BREAKOUT_WATCH").otherwise("BOX_FORMING"))
    g = g.withColumns({"state": state, "entry": lc * (1 + cfg.slippage_pct / 100)})
    # next resistance: smallest earlier high at least 2 % above the entry, over the whole history
    res = df.join(g.select("symbol", C("entry").alias("_entry"), C("date").alias("_last")), "symbol").where(
        (C("date") < C("_last")) & (C("high") > C("_entry") * 1.02)).groupBy("symbol").agg(F.min("high").alias("_res"))
    g = g.join(res, "symbol", "left")
    stop = F.greatest(F.lit(0.01), F.when(C("state") == "RETEST_CONFIRMED", F.least(C("l.low"), top - 0.10 * C("atr14")))
                      .otherwise(F.greatest(C("bottom"), top - 0.25 * C("atr14"))))
    box_target = C("entry") + F.round(top - C("bottom"), 4)
    g = g.withColumns({"stop": stop, "target": F.least(box_target, C("_res"))})
    risk = C("entry") - C("stop")
    net = F.greatest(C("target") * (1 - cfg.costs_pct / 100) - C("entry") * (1 + cfg.costs_pct / 100), F.lit(0.0))
    g = g.withColumns(
        {
            "gross_reward_risk": F.when(risk > 0, F.greatest(C("target") - C("entry"), F.lit(0.0)) / risk).otherwise(0.0),
            "net_reward_risk": F.when(risk > 0, net / risk).otherwise(0.0),
        }
    )
    nr = F.round("net_reward_risk", 4)
    return g.withColumn(
        "decision",
        F.when(C("state") == "PRE_BREAKOUT_WATCH", "WAIT_FOR_BREAKOUT")
        .when((C("state") == "BREAKOUT_CONFIRMED") & (nr >= 2), "BUY_BREAKOUT")
        .when((C("state") == "RETEST_CONFIRMED") & (nr >= 2), "BUY_RETEST")
        .when(C("state") == "LATE_ENTRY", "DO_NOT_CHASE")
        .when(C("state").isin("INVALID_BOX", "FAILED_BREAKOUT"), "REJECT").otherwise("WATCH_OR_REJECT"),
    ).drop("b", "x", "l", "n", "atr", "_buffer", "_strong", "_hit", "_res", "avg20")


# Events ----------------------------------------------------------------------


def event_reactions(panel: DataFrame, bench: DataFrame, is_event: Column, priority: int = 3, days: int = 5) -> DataFrame:
    """Pre / post returns, excess, volume and range ratios and reaction score of event bars.

    Offsets are session numbers of the symbol; bars without ``days`` later sessions are open.
    """
    b = bench.select("date", C("close").alias("_b"))
    df = panel.withColumn("_ev", is_event).join(b, "date", "left")
    df = df.withColumns({"_rg": ratio(C("high") - C("low"), "close"), "_pos": S.position()})
    at = lambda c, k: S.lag(c, k) if k > 0 else S.lead(c, -k)
    first, last = F.first("close").over(S.w), F.last("close").over(
        S.w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    before, after = S.frame(20, -1), S.w.rowsBetween(0, days)
    df = df.withColumns(
        {
            "_prior": F.coalesce(at("close", 1), C("close")), "_pb": F.coalesce(at("_b", 1), C("_b")),
            "_pre": F.coalesce(at("close", days), first), "_post": at("close", -days), "_bpost": at("_b", -days),
            "_post10": F.coalesce(at("close", -10), last),
            "volume_ratio": ratio(F.avg("volume").over(after), F.avg("volume").over(before)),
            "range_ratio": ratio(F.avg("_rg").over(after), F.avg("_rg").over(before)),
        }
    )
    df = df.where(C("_ev") & C("_post").isNotNull()).withColumns(
        {
            "pre_return": ratio("close", "_pre") - 1, "post_return": ratio("_post", "_prior") - 1,
            "post10_return": ratio("_post10", "_prior") - 1, "bench_return": ratio("_bpost", "_pb") - 1,
        }
    )
    df = df.withColumn("excess", C("post_return") - C("bench_return"))
    flip = (C("pre_return") * C("post_return") < 0) & (F.abs("post_return") >= 0.02)
    cap = lambda v, hi: F.when(v.isNotNull(), F.least(v, F.lit(float(hi))))
    zero = F.lit(0.0)
    score = (
        cap(F.abs("post_return") * 260, 24) + cap(F.abs("post10_return") * 160, 16)
        + F.coalesce(cap(F.abs("excess") * 300, 24), zero)
        + F.coalesce(F.greatest(zero, cap((C("volume_ratio") - 1) * 18, 12)), zero)
        + F.coalesce(F.greatest(zero, cap((C("range_ratio") - 1) * 16, 10)), zero)
        + F.when(flip, 10.0).otherwise(0.0) + max(0, 10 - priority) * 1.5)
    return df.withColumns({"trend_flip": flip, "reaction_score": F.least(F.greatest(score, zero), F.lit(100.0))}).drop(
        *[c for c in df.columns if c.startswith("_")])


def result_day_features(panel: DataFrame, bench: DataFrame, is_event: Column, horizon: int = 20) -> DataFrame:
    """Rows within ``horizon`` sessions of the latest event with its day-of reaction.

    The event's values are carried forward; the 2- and 5-session excess stay NULL until known.
    """
    b = bench.withColumn("_k", F.lit(0))
    one = Series("_k", "date")
    b = b.select("date", (ratio("close", one.lag("close")) - 1).alias("_br"))
    df = panel.join(b, "date", "left").withColumns(
        {"_r": S.change("close"), "_pc": S.lag("close"), "_pos": S.position(), "_v": F.avg("volume").over(S.frame(20, -1)),
         "_ev": is_event})
    path = lambda k: F.exp(F.sum(F.log1p("_br")).over(S.w.rowsBetween(1, k)))
    known = lambda k: F.count("_br").over(S.w.rowsBetween(1, k)) == k
    df = df.withColumns({f"_x{k}": F.when(known(k), ratio(S.lead("close", k), "close") - path(k)) for k in (2, 5)})
    ev = F.struct(
        C("_pos").alias("at"), C("_r").alias("day_return"), (C("_r") - C("_br")).alias("day_excess"),
        ratio("volume", "_v").alias("volume_to_avg20"), (ratio("open", "_pc") - 1).alias("gap"),
        C("_x2").alias("x2"), C("_x5").alias("x5"))
    df = df.withColumn("_e", F.last(F.when(C("_ev"), ev), ignorenulls=True).over(S.w))
    since = C("_pos") - C("_e.at")
    df = df.where(since.between(0, horizon)).withColumn("sessions_since", since)
    w = Window.partitionBy("symbol", C("_e.at")).orderBy("date")
    vol = F.when(F.count("_r").over(w) >= 2, F.stddev_pop("_r").over(w))
    return df.select(
        "symbol", "date", "sessions_since", C("_e.day_return"), C("_e.day_excess"), C("_e.volume_to_avg20"), C("_e.gap"),
        F.when(since >= 2, C("_e.x2")).alias("excess_2d"), F.when(since >= 5, C("_e.x5")).alias("excess_5d"),
        vol.alias("post_volatility"),
        F.when(since <= 5, "D0_5").when(since <= 10, "D6_10").otherwise("D11_20").alias("window_label"))


def support_levels(df: DataFrame, rows: int = 20, atr_rows: int = 14, multiple: float = 2.0) -> DataFrame:
    """Recent support, resistance and the ATR stop."""
    from barloom.operators.features import add_atr

    df = add_atr(df, S, (atr_rows,))
    return df.withColumns(
        {
            "support": F.min("low").over(S.frame(rows)), "resistance": F.max("high").over(S.frame(rows)),
            "atr_stop": C("close") - C(f"atr_{atr_rows}") * multiple,
        }
    )


def upcoming_event_watch(latest: DataFrame, events: DataFrame) -> DataFrame:
    """Next event after the latest bar and a watch score from trend, tightness and time to it."""
    ev = latest.join(events, "symbol").where(C("event_date") > C("date")).groupBy("symbol", "date").agg(
        F.min(F.struct("event_date", "priority")).alias("_e"))
    j = latest.join(ev, ["symbol", "date"]).withColumn("days_to_event", F.datediff(C("_e.event_date"), "date"))
    score = (
        F.greatest(F.lit(0.0), 30.0 - C("days_to_event")) + F.when(C("close") > C("sma_20"), 20.0).otherwise(0.0)
        + F.when(C("close") > C("sma_50"), 20.0).otherwise(0.0) + F.when(C("volume_to_avg20") < 0.8, 15.0).otherwise(0.0)
        + F.greatest(F.lit(0), 10 - C("_e.priority")) * 1.5)
    return j.withColumn("watch_score", F.least(score, F.lit(100.0))).withColumn("event_date", C("_e.event_date")).drop("_e")
