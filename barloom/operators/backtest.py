"""Portfolio backtest as one plan: schedule -> selection -> weights -> trades -> periods.

Parameter variants and folds are columns, never loops over re-runs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.frames import with_row
from barloom.functions.rolling import Series, ratio
from barloom.operators.cross_section import rebalance_dates, top_n
from barloom.operators.quality import tradability

C = F.col
S = Series("symbol", "date")


@dataclass(frozen=True)
class Costs:
    """Fixed order-cost rates in basis points."""

    brokerage_bps: float = 0.0
    brokerage_cap: float = 20.0
    stt_buy_bps: float = 10.0
    stt_sell_bps: float = 10.0
    exchange_bps: float = 0.297
    sebi_bps: float = 0.01
    gst_rate: float = 0.18
    stamp_buy_bps: float = 1.5
    slippage_bps: float = 5.0
    impact: float = 0.0


@dataclass(frozen=True)
class Strategy:
    top_n: int = 10
    bottom_n: int = 10
    long_short: bool = False
    weighting: str = "equal"
    max_position: float = 0.15
    max_sector: float = 0.35
    stop_loss: float | None = 0.12
    trailing_stop: float | None = None
    capital: float = 1_000_000.0
    frequency: str = "monthly"
    min_traded_value: float = 0.0
    circuit: float = 0.20
    costs: Costs = field(default_factory=Costs)


def order_cost(notional: Column, side: str, c: Costs, fraction: Column, volatility: Column) -> Column:
    """Total cost of one order: brokerage, taxes, fees, GST, stamp duty and slippage."""
    brokerage = F.least(notional * (c.brokerage_bps / 1e4), F.lit(c.brokerage_cap))
    tax = notional * ((c.stt_buy_bps if side == "buy" else c.stt_sell_bps) / 1e4)
    exchange, sebi = notional * (c.exchange_bps / 1e4), notional * (c.sebi_bps / 1e4)
    gst = (brokerage + exchange + sebi) * c.gst_rate
    stamp = notional * (c.stamp_buy_bps / 1e4) if side == "buy" else F.lit(0.0)
    zero = F.lit(0.0)
    impact = c.impact * F.greatest(zero, fraction) * F.greatest(zero, volatility) * 1e4
    slippage = notional * (c.slippage_bps + impact) / 1e4
    return brokerage + tax + exchange + sebi + gst + stamp + slippage


def schedule(bench: DataFrame, frequency: str = "monthly") -> DataFrame:
    """Signal, entry and exit date per period; a calendar-sized table."""
    one = Window.partitionBy(F.lit(0)).orderBy("date")
    cal = bench.select("date").distinct().withColumn("_next", F.lead("date").over(one))
    reb = rebalance_dates(bench, frequency).join(cal, "date")
    return (
        reb.withColumns(
            {"exit_date": F.lead("_next").over(one), "period_no": F.row_number().over(one)}
        )
        .where(C("_next").isNotNull() & C("exit_date").isNotNull())
        .select(C("date").alias("signal_date"), C("_next").alias("entry_date"), "exit_date", "period_no")
    )


def period_sessions(sched: DataFrame, bench: DataFrame) -> DataFrame:
    """(signal_date, date) for every session from entry to exit, so trades join bars by equality."""
    one = Window.partitionBy(F.lit(0)).orderBy("date")
    cal = bench.select("date").distinct().withColumn("_n", F.row_number().over(one))
    e = cal.select(C("date").alias("entry_date"), C("_n").alias("_a"))
    x = cal.select(C("date").alias("exit_date"), C("_n").alias("_b"))
    span = sched.join(e, "entry_date").join(x, "exit_date").withColumn(
        "_n", F.explode(F.sequence("_a", "_b"))
    )
    return span.join(cal, "_n").select("signal_date", "entry_date", "exit_date", "period_no", "date")


def prepare(panel: DataFrame, score: Callable[[DataFrame], DataFrame], vol_rows: int = 20) -> DataFrame:
    """Tradability, score, volatility and previous close per bar; ``panel`` carries a sector."""
    df = score(tradability(panel))
    df = df.withColumns({"_r": S.change("close"), "prev_close": S.lag("close")})
    return df.withColumn("volatility", S.std("_r", vol_rows)).drop("_r")


def select(data: DataFrame, sched: DataFrame, cfg: Strategy) -> DataFrame:
    """Eligible top (and bottom) names per signal date with side +1 / -1 and rank."""
    rows = data.join(sched.select(C("signal_date").alias("date")), "date", "left_semi").where(
        C("score").isNotNull() & C("is_tradable") & (C("avg_traded_value_20d") >= cfg.min_traded_value)
    ).select(C("date").alias("signal_date"), "symbol", "sector", "score", "volatility")
    longs = top_n(rows, ["signal_date"], "score", cfg.top_n).withColumn("side", F.lit(1))
    if not cfg.long_short:
        return longs
    shorts = top_n(rows, ["signal_date"], "score", cfg.bottom_n, lowest=True)
    return longs.unionByName(shorts.withColumn("side", F.lit(-1)))


def weights(sel: DataFrame, cfg: Strategy, by: Sequence[str] = ("signal_date",)) -> DataFrame:
    """Capped allocation in rank order. A group holds at most ``top_n`` rows, folded in the JVM.

    Each name receives the least of its raw weight, the position cap, the room left in
    its sector and the budget left; names without room are left out.
    """
    by = list(by)
    budget = 0.5 if cfg.long_short else 1.0
    name = F.struct("rank", "symbol", "sector", C("volatility").cast("double").alias("volatility"))
    g = sel.groupBy(*by, "side").agg(F.sort_array(F.collect_list(name)).alias("_rows"))
    if cfg.weighting == "inverse_volatility":
        inv = F.transform("_rows", lambda r: 1.0 / F.nullif(r["volatility"], F.lit(0.0)))
        known = F.sort_array(F.array_compact(inv))
        n = F.size(known)
        mid = lambda i: F.element_at(known, i.cast("int"))
        median = F.when(n > 0, (mid(F.floor((n + 1) / 2)) + mid(F.ceil((n + 1) / 2))) / 2)
        raw = F.transform(inv, lambda v: F.coalesce(v, median, F.lit(1.0)))
    else:
        raw = F.transform("_rows", lambda r: F.lit(1.0))
    g = g.withColumn("_raw", raw)
    g = g.withColumn("_total", F.aggregate("_raw", F.lit(0.0), lambda a, v: a + v))
    items = F.arrays_zip("_rows", "_raw")
    empty = F.from_json(F.lit("[]"), "array<struct<symbol:string,sector:string,weight:double>>")

    def step(acc, it):
        row, r = it["_rows"], it["_raw"]
        used = F.aggregate(acc, F.lit(0.0), lambda a, x: a + x["weight"])
        room = cfg.max_sector - F.aggregate(
            F.filter(acc, lambda x: x["sector"] == row["sector"]), F.lit(0.0), lambda a, x: a + x["weight"])
        value = F.least(r / C("_total") * budget, F.lit(cfg.max_position),
                        F.greatest(F.lit(0.0), room), F.lit(budget) - used)
        entry = F.struct(row["symbol"].alias("symbol"), row["sector"].alias("sector"), value.alias("weight"))
        return F.when((value > 0) & (F.lit(budget) - used > 1e-12), F.concat(acc, F.array(entry))).otherwise(acc)

    out = g.withColumn("_alloc", F.explode(F.aggregate(items, empty, step)))
    return out.select(*by, "side", C("_alloc.symbol").alias("symbol"), C("_alloc.sector").alias("sector"),
                      C("_alloc.weight").alias("weight"))


def simulate(
    picks: DataFrame, data: DataFrame, spans: DataFrame, cfg: Strategy, by: Sequence[str] = ()
) -> DataFrame:
    """One row per order: filled trade with exit, returns and costs, or a skip reason.

    Entry at the next session's open; fixed and trailing stops with gap fills; otherwise the
    open of the planned exit. ``picks`` may carry ``stop_loss`` / ``trailing_stop`` columns
    (parameter variants); the peak before a bar is a running maximum ending one bar earlier.
    """
    by = list(by)
    key = [*by, "symbol", "signal_date"]
    for c, v in (("stop_loss", cfg.stop_loss), ("trailing_stop", cfg.trailing_stop)):
        if c not in picks.columns:
            picks = picks.withColumn(c, F.lit(v).cast("double"))
    bars = data.select("symbol", "date", "open", "high", "low", "close", "prev_close", "is_tradable",
                       "traded_value", C("volatility").alias("bar_volatility"))
    path = picks.join(spans, "signal_date").join(bars, ["symbol", "date"], "left")
    w = Window.partitionBy(*key).orderBy("date")
    p = path.withColumns(
        {
            "_entry": F.max(F.when(C("date") == C("entry_date"), C("open"))).over(Window.partitionBy(*key)),
            "_later": (C("date") > C("entry_date")) & C("open").isNotNull(),
        }
    )
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumns(
        {
            "_peak": F.greatest(C("_entry"), F.max(F.when(C("_later"), C("high"))).over(before)),
            "_trough": F.least(C("_entry"), F.min(F.when(C("_later"), C("low"))).over(before)),
        }
    )
    long = C("side") > 0
    inf = F.lit(float("inf"))
    fixed = F.when(long, F.coalesce(C("_entry") * (1 - C("stop_loss")), -inf)).otherwise(
        F.coalesce(C("_entry") * (1 + C("stop_loss")), inf))
    trail = F.when(long, F.coalesce(C("_peak") * (1 - C("trailing_stop")), -inf)).otherwise(
        F.coalesce(C("_trough") * (1 + C("trailing_stop")), inf))
    p = p.withColumns({"_fixed": fixed, "_stop": F.when(long, F.greatest(fixed, trail)).otherwise(F.least(fixed, trail))})
    hit = C("_later") & F.when(long, C("low") <= C("_stop")).otherwise(C("high") >= C("_stop"))
    fill = F.when(long, F.least("open", "_stop")).otherwise(F.greatest("open", "_stop"))
    why = F.when(C("_stop") == C("_fixed"), "stop_loss").otherwise("trailing_stop")
    seen = C("open").isNotNull()
    first = [c for c in picks.columns if c not in key]
    t = p.groupBy(*key, "entry_date", "period_no").agg(
        *[F.first(c).alias(c) for c in first],
        F.min(F.when(hit, F.struct("date", fill.alias("price"), why.alias("why")))).alias("_hit"),
        F.max(F.when(seen, F.struct("date", "open"))).alias("_last"),
        F.max(F.when(C("date") == C("entry_date"), F.struct(
            "open", "high", "low", "prev_close", "is_tradable", "traded_value", "bar_volatility"))).alias("_e"),
    )
    gap = F.coalesce(ratio(C("_e.open"), C("_e.prev_close")) - 1.0, F.lit(0.0))
    locked = (C("_e.high") == C("_e.low")) & (F.abs(gap) >= cfg.circuit * 0.95)
    t = t.withColumn(
        "skip_reason",
        F.when(C("_e.open").isNull(), "missing_entry_bar").when(~C("_e.is_tradable") | locked, "untradable_entry"),
    )
    ok = C("skip_reason").isNull()
    t = t.withColumns(
        {
            "entry_price": F.when(ok, C("_e.open")),
            "exit_price": F.when(ok, F.coalesce(C("_hit.price"), C("_last.open"))),
            "exit_date": F.when(ok, F.coalesce(C("_hit.date"), C("_last.date"))),
            "exit_reason": F.when(ok, F.coalesce(C("_hit.why"), F.lit("rebalance"))),
        }
    )
    t = t.withColumn("gross_return", C("side") * (ratio("exit_price", "entry_price") - 1.0))
    notional = C("weight") * cfg.capital
    fraction = F.coalesce(ratio(notional, C("_e.traded_value")), F.lit(0.0))
    vol = F.coalesce(C("_e.bar_volatility"), F.lit(0.0))
    back = notional * F.greatest(F.lit(0.0), 1 + C("gross_return"))
    cost = lambda n, side: order_cost(n, side, cfg.costs, fraction, vol)
    total = F.when(long, cost(notional, "buy") + cost(back, "sell")).otherwise(
        cost(notional, "sell") + cost(back, "buy"))
    t = t.withColumn("cost_fraction", F.when(C("skip_reason").isNull(), total / cfg.capital))
    return t.withColumns(
        {
            "net_return": C("gross_return") - C("cost_fraction") / C("weight"),
            "gross_contribution": C("weight") * C("gross_return"),
            "net_contribution": C("weight") * C("gross_return") - C("cost_fraction"),
            "holding_days": F.datediff("exit_date", "entry_date"),
        }
    ).drop("_hit", "_last", "_e")


def benchmark_returns(sched: DataFrame, bench: DataFrame) -> DataFrame:
    """Open-to-open benchmark return of each period, 0 when a side is missing."""
    a = bench.select(C("date").alias("entry_date"), C("open").alias("_a"))
    b = bench.select(C("date").alias("exit_date"), C("open").alias("_b"))
    return sched.join(a, "entry_date", "left").join(b, "exit_date", "left").withColumn(
        "benchmark_return", F.coalesce(ratio("_b", "_a") - 1.0, F.lit(0.0))
    ).drop("_a", "_b")


def periods(trades: DataFrame, sched: DataFrame, bench: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Period returns, exposure and turnover from the executed trades.

    Turnover is the symmetric difference of consecutive executed sets over twice their union,
    from one full outer join of each set with the one before.
    """
    by = list(by)
    done = trades.where(C("skip_reason").isNull())
    agg = done.groupBy(*by, "signal_date").agg(
        F.sum("gross_contribution").alias("gross_return"), F.sum("net_contribution").alias("net_return"),
        F.count(F.lit(1)).alias("positions"), F.sum("weight").alias("gross_exposure"),
        F.sum(C("side") * C("weight")).alias("net_exposure"),
    )
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("signal_date")
    agg = agg.withColumn("_i", F.row_number().over(w))
    held = done.join(agg.select(*by, "signal_date", "_i"), [*by, "signal_date"]).select(*by, "symbol", "_i")
    now = held.withColumn("_now", F.lit(1))
    prev = held.select(*by, "symbol", (C("_i") + 1).alias("_i"), F.lit(1).alias("_prev"))
    both = now.join(prev, [*by, "symbol", "_i"], "full").groupBy(*by, "_i").agg(
        F.count(F.lit(1)).alias("_union"), F.count(F.when(C("_now").isNotNull() & C("_prev").isNotNull(), 1)).alias("_both")
    ).withColumn("turnover", (C("_union") - C("_both")) / F.greatest(F.lit(1), 2 * C("_union")))
    out = agg.join(both.select(*by, "_i", "turnover"), [*by, "_i"])
    return out.join(benchmark_returns(sched, bench), "signal_date").drop("_i")


def walk_forward_folds(
    bench: DataFrame, train_years: int, test_months: int, embargo: int
) -> DataFrame:
    """Expanding folds with an embargo. Built from the list of session dates (one per
    trading day), which is the only thing that comes to the driver."""
    import pandas as pd

    days = [r[0] for r in bench.select("date").distinct().orderBy("date").toLocalIterator()]
    sessions = pd.DatetimeIndex(days)
    rows, fold = [], 1
    start_at = sessions.searchsorted(sessions[0] + pd.DateOffset(years=train_years))
    while start_at < len(sessions) - 1:
        start = sessions[start_at]
        stop_at = sessions.searchsorted(start + pd.DateOffset(months=test_months))
        train_at = start_at - embargo - 1
        if train_at < 0:
            break
        rows.append((fold, *[sessions[i].date() for i in (0, train_at, train_at + 1, start_at - 1, start_at, stop_at - 1)]))
        fold, start_at = fold + 1, stop_at
    return bench.sparkSession.createDataFrame(
        rows, "fold int, train_start date, train_end date, embargo_start date, embargo_end date, "
        "test_start date, test_end date"
    )


def assign_folds(periods_: DataFrame, folds: DataFrame) -> DataFrame:
    """Fold of each period: signal inside the test window and exit not after its end.

    The fold list is turned into one row per period date before the join.
    """
    f = folds.agg(F.collect_list(F.struct("fold", "test_start", "test_end")).alias("_f"))
    hit = F.filter("_f", lambda x: (C("signal_date") >= x["test_start"]) & (C("exit_date") <= x["test_end"]))
    return with_row(periods_, f).withColumn(
        "fold", F.try_element_at(hit, F.lit(1))["fold"]
    ).drop("_f").where(C("fold").isNotNull())


def fold_audit(folds: DataFrame, panel: DataFrame) -> DataFrame:
    """Train and test rows per fold from per-date counts, with the no-overlap check."""
    per = panel.groupBy("date").agg(F.count(F.lit(1)).alias("_n"))
    arr = per.agg(F.collect_list(F.struct("date", "_n")).alias("_d"))
    rows = lambda a, b: F.aggregate(
        F.filter("_d", lambda x: (x["date"] >= C(a)) & (x["date"] <= C(b))), F.lit(0).cast("bigint"), lambda s, x: s + x["_n"])
    return with_row(folds, arr).withColumns(
        {
            "train_rows": rows("train_start", "train_end"), "test_rows": rows("test_start", "test_end"),
            "no_overlap": (C("train_end") < C("embargo_start")) & (C("embargo_start") <= C("embargo_end"))
            & (C("embargo_end") < C("test_start")),
        }
    ).drop("_d")


def variants(sel: DataFrame, grid: Sequence[tuple[str, int, float | None]]) -> DataFrame:
    """Selections repeated per (variant, top_n, stop) of a fixed grid; rows beyond a variant's
    top_n are not copied."""
    items = F.filter(
        F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(k).alias("top_n"), F.lit(s).cast("double").alias("stop_loss")) for n, k, s in grid]),
        lambda v: v["top_n"] >= C("rank"),
    )
    return sel.withColumn("_v", F.explode(items)).select("*", "_v.variant", "_v.stop_loss").drop("_v")


def top_n_predictions(pred: DataFrame, n: int = 5, cost_bps: float = 10.0, every: int = 20) -> DataFrame:
    """Equal-weight top-n of every ``every``-th date with turnover cost (predictions table)."""
    one = Window.partitionBy(F.lit(0)).orderBy("date")
    reb = pred.select("date").distinct().withColumn("_i", F.row_number().over(one) - 1)
    reb = reb.where(C("_i") % every == 0).withColumn("_i", (C("_i") / every).cast("int"))
    best = pred.groupBy("date", "symbol").agg(F.max(F.struct("score", "future_stock_return", "future_bench_return")).alias("_p"))
    best = best.select("date", "symbol", "_p.*").join(reb, "date")
    sel = top_n(best, ["date", "_i"], "score", n)
    size = sel.groupBy("date", "_i").agg(F.count(F.lit(1)).alias("positions"))
    held = sel.join(size, ["date", "_i"]).withColumn("weight", 1.0 / C("positions"))
    prev = held.select("symbol", (C("_i") + 1).alias("_i"), C("weight").alias("_pw"))
    turn = held.select("symbol", "_i", "weight").join(prev, ["symbol", "_i"], "full").groupBy("_i").agg(
        (F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("_pw", F.lit(0.0)))) / 2).alias("turnover")
    )
    per = held.groupBy("date", "_i", "positions").agg(
        F.sum(C("future_stock_return") * C("weight")).alias("_g"), F.avg("future_bench_return").alias("benchmark_return")
    )
    return per.join(turn, "_i").withColumn(
        "portfolio_return", C("_g") - C("turnover") * (cost_bps / 1e4)
    ).drop("_g", "_i")
