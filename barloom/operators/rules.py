"""Rule scoring: fundamentals, holdings, materials, setups, options, consensus, signals, text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import scoring as sc
from barloom.functions.rolling import Series, ratio
from barloom.functions.text import clamp

C = F.col
S = Series("symbol", "date")

WEIGHTS = {"profitability": 0.25, "growth": 0.20, "health": 0.25, "valuation": 0.20, "ownership": 0.10}


def category_scores() -> dict[str, tuple[list[Column], list[Column]]]:
    """Per category: the scores of its metrics and the input columns they rest on."""
    b = sc.band
    pe, pledge = C("pe"), C("promoter_pledge")
    inst = F.when(C("fii_holding").isNotNull() | C("dii_holding").isNotNull(),
                  F.coalesce("fii_holding", F.lit(0.0)) + F.coalesce("dii_holding", F.lit(0.0)))
    pe_score = F.when(pe <= 0, 0.0).otherwise(sc.ladder(pe, [(15, 90.0), (25, 75.0), (40, 50.0), (60, 25.0)], 0.0))
    cols = lambda *n: [C(x) for x in n]
    return {
        "profitability": (
            [b(C("roe"), 20, 15, 10, 0), b(C("roce"), 20, 15, 10, 0), b(C("net_margin"), 20, 12, 5, 0), b(C("operating_margin"), 25, 15, 7, 0)],
            cols("roe", "roce", "net_margin", "operating_margin")),
        "growth": ([b(C(g), 20, 12, 5, 0) for g in ("revenue_growth", "eps_growth", "profit_growth")],
                   cols("revenue_growth", "eps_growth", "profit_growth")),
        "health": (
            [b(C("debt_to_equity"), 0.25, 0.5, 1.0, 2.0, higher=False), b(C("current_ratio"), 2.0, 1.5, 1.0, 0.5),
             b(C("interest_coverage"), 8, 4, 2, 1), F.when(C("free_cash_flow") >= 0, 75.0).when(C("free_cash_flow") < 0, 25.0)],
            cols("debt_to_equity", "current_ratio", "interest_coverage", "free_cash_flow")),
        "valuation": ([pe_score, b(C("pb"), 1, 3, 6, 12, higher=False), b(C("ev_to_ebitda"), 8, 15, 25, 50, higher=False)],
                      cols("pe", "pb", "ev_to_ebitda")),
        "ownership": (
            [b(C("promoter_holding"), 50, 35, 20, 0), sc.ladder(pledge, [(5, 100.0), (20, 60.0), (50, 25.0)], 0.0), b(inst, 30, 15, 5, 0)],
            cols("promoter_holding", "promoter_pledge", "fii_holding", "dii_holding")),
    }


def scorecard(companies: DataFrame) -> DataFrame:
    """Weighted fundamental scorecard with coverage confidence and observation lists."""
    df = companies
    for name, (scores, inputs) in category_scores().items():
        df = df.withColumns({f"{name}_score": F.round(sc.mean_present(scores), 2), f"{name}_coverage": sc.coverage(inputs)})
    total = sum((C(f"{n}_score") * w for n, w in WEIGHTS.items()), F.lit(0.0))
    conf = sum((C(f"{n}_coverage") * w for n, w in WEIGHTS.items()), F.lit(0.0))
    note = lambda *rules: F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))
    return df.withColumns(
        {
            "overall_score": F.round(F.round(clamp(total, 0.0, 100.0), 6), 2), "confidence": F.round(conf, 4),
            "strengths": note((C("roe") >= 20, "High ROE"), (C("revenue_growth") >= 20, "Strong revenue growth"),
                              (C("debt_to_equity") <= 0.25, "Low debt"), (C("interest_coverage") >= 8, "Comfortable interest coverage")),
            "weaknesses": note((C("revenue_growth") < 0, "Revenue falling"), (C("profit_growth") < 0, "Profit falling"), (C("free_cash_flow") < 0, "Negative free cash flow")),
            "warnings": note((C("debt_to_equity") > 2, "High debt"), (C("interest_coverage") < 1, "Interest not covered"), (C("promoter_pledge") > 50, "High pledge")),
        }
    )


def shareholding_score(h: DataFrame) -> DataFrame:
    """0-100 institutional score from percent series (oldest first): fii, dii, promoter, public, pledge."""
    both = sc.add_series(C("fii"), C("dii"))
    p = lambda cond, v: F.when(F.coalesce(cond, F.lit(False)), float(v)).otherwise(0.0)
    pledge = sc.latest(C("pledge"))
    score = (
        p(sc.qoq_up(C("fii")), 12) + p(sc.two_up(C("fii")), 8) + p(sc.qoq_up(C("dii")), 12) + p(sc.two_up(C("dii")), 8)
        + p(sc.qoq_up(both), 15) - p(sc.two_down(both), 20) + p(sc.qoq_non_down(C("promoter")), 10)
        - p(sc.yoy_drop(C("promoter")) > 2, 15)
        + F.when(pledge.isNull(), 0.0).when(pledge == 0, 8.0).when((pledge > 10) | sc.qoq_up(C("pledge")), -20.0).otherwise(0.0)
        + p(sc.qoq_up(both) & sc.qoq_down(C("public")), 12))
    return h.withColumn("institutional_score", F.round(clamp(score, 0.0, 100.0), 1))


# Raw materials ---------------------------------------------------------------


def active_mappings(mappings: DataFrame, as_of: Column) -> DataFrame:
    return mappings.where((C("effective_from") <= as_of) & (C("effective_to").isNull() | (C("effective_to") > as_of)))


def material_changes(prices: DataFrame) -> DataFrame:
    """Changes over 1/7/30/90 rows and annualised volatility at the latest price of each material."""
    s = Series("material", "date")
    p = prices.withColumns({f"change_{n}": s.change("price", n) for n in (1, 7, 30, 90)} | {"_r": s.change("price")})
    p = p.withColumn("volatility_20", s.std("_r", 20, min_rows=2) * F.sqrt(F.lit(252.0)))
    keep = ["date", "price", "change_1", "change_7", "change_30", "change_90", "volatility_20"]
    return p.groupBy("material").agg(F.max(F.struct(*keep)).alias("_x")).select("material", "_x.*")


def calendar_month_changes(monthly: DataFrame) -> DataFrame:
    """1/3/12-month change at the latest month, against the exact calendar month only."""
    last = monthly.groupBy("material").agg(F.max(F.struct("date", "price")).alias("_l")).select("material", "_l.*")
    out = last
    for k in (1, 3, 12):
        prior = monthly.select("material", F.last_day(F.add_months("date", k)).alias("date"), C("price").alias(f"_p{k}"))
        out = out.join(prior, ["material", "date"], "left").withColumn(
            f"change_{k}m_pct", F.when(C(f"_p{k}") > 0, (C("price") / C(f"_p{k}") - 1) * 100)).drop(f"_p{k}")
    return out


def margin_impact(m: DataFrame, as_of: Column) -> DataFrame:
    """Margin impact in basis points, direction, severity, confidence and alert level."""
    c01 = lambda x: clamp(C(x), 0.0, 1.0)
    impact = c01("spend_pct") * C("price_change") * (1 - c01("hedge_ratio")) * (1 - c01("pass_through")) * 10000
    bps = F.when(C("relationship") == "CONSUMER", -impact).when(C("relationship") == "PRODUCER", impact).otherwise(
        -impact * 0.5 + impact * 0.5)
    cap = lambda v, top, pts: F.least(v / top, F.lit(1.0)) * pts
    z = lambda c: F.coalesce(C(c), F.lit(0.0))
    age = F.datediff(as_of, "date")
    fresh = F.when(age <= 2, 1.0).when(age <= 7, 0.75).when(age <= 30, 0.35).otherwise(0.0)
    needed = ("spend_pct", "import_dependency", "hedge_ratio", "pass_through", "price", "price_change")
    df = m.withColumn("margin_bps", bps).withColumns(
        {
            "direction": F.when(C("margin_bps").isNull(), "INSUFFICIENT_DATA").when(F.abs("margin_bps") < 5, "MIXED")
            .when(C("margin_bps") > 0, "POSITIVE").otherwise("NEGATIVE"),
            "severity": F.round(
                cap(F.abs(z("price_change")), 0.15, 25) + cap(z("spend_pct"), 0.25, 20) + cap(z("import_dependency"), 0.75, 15)
                + cap(F.abs(z("margin_bps")), 100, 25) + cap(z("supplier_concentration"), 0.75, 10) + cap(z("volatility_20"), 0.45, 5), 2),
            "evidence": F.round(C("verification") * 35 + fresh * 25 + sc.coverage([C(n) for n in needed]) * 25 + 0.8 * 15, 2),
            "missing": F.array_compact(F.array(*[F.when(C(n).isNull(), F.lit(n)) for n in needed])),
        }
    )
    df = df.withColumn("priority", F.round(C("severity") * C("evidence") / 100, 2))
    a = F.abs(z("margin_bps"))
    return df.withColumn(
        "alert_level",
        F.when((F.size("missing") > 0) | (C("evidence") < 70), "NONE").when((a >= 100) & (C("priority") >= 70), "CRITICAL")
        .when((a >= 25) & (C("priority") >= 45), "MATERIAL").when(C("priority") >= 25, "WATCH").otherwise("INFORMATIONAL"))


# Setups and options ----------------------------------------------------------


def technical_setups(panel: DataFrame) -> DataFrame:
    """Breakout / pullback / near-pivot / failed state of each bar with stop and targets."""
    from barloom.operators.features import add_atr

    df = add_atr(panel, S, (14,)).withColumns(
        {
            "pivot": S.max("high", 20, end=-1), "support": F.min("low").over(S.frame(20)),
            "_av": F.avg("volume").over(S.frame(20, -1)), "sma20": S.mean("close", 20), "sma50": S.mean("close", 50),
            "_n": S.position()}
    )
    df = df.withColumns({"volume_ratio": ratio("volume", "_av"), "_over": C("close") > C("pivot")})
    failed = F.lit(False)
    for k in range(1, 6):  # a close above its own prior high within five bars, then a close back below it
        low_since = F.min("close").over(S.frame(k))
        failed = failed | F.coalesce(S.lag("_over", k) & (low_since < S.lag("pivot", k)) & (S.position() > 20 + k), F.lit(False))
    df = df.withColumn("_failed", failed)
    c, atr = C("close"), C("atr_14")
    breakout = F.coalesce((c > C("pivot")) & (C("volume_ratio") >= 1.5), F.lit(False))
    pull = F.coalesce(
        (c >= F.coalesce("sma50", "sma20")) & (F.abs(ratio("close", "sma20") - 1) <= 0.025)
        & F.coalesce(C("volume_ratio") <= 1.0, F.lit(True)), F.lit(False))
    near = F.coalesce(((C("pivot") - c) / C("pivot")).between(0, 0.05), F.lit(False))
    late = breakout & F.coalesce(atr.isNotNull() & (c - C("pivot") > F.greatest(C("pivot") * 0.03, atr)), F.lit(False))
    stop = F.least(F.when(C("support") < c, C("support") * 0.995), F.when(atr > 0, c - atr * 1.5))
    state = (
        F.when(C("_failed"), "FAILED_BREAKOUT").when(late, "LATE_ENTRY").when(breakout, "BREAKOUT_CONFIRMED")
        .when(pull, "PULLBACK_SUPPORT").when(near, "NEAR_PIVOT").otherwise("UNCONFIRMED"))
    df = df.where(C("_n") >= 21).withColumns({"technical_state": state, "stop_loss": stop})
    risk = C("close") - C("stop_loss")
    return df.withColumns(
        {"target_1": F.when(risk > 0, c + 2 * risk), "target_2": F.when(risk > 0, c + 3 * risk)}
    ).drop("_av", "_n", "_over", "_failed", "prev_close", "tr")


def position_size(setups: DataFrame, capital: float, risk_pct: float = 1.0, max_pct: float = 10.0) -> DataFrame:
    """Shares allowed by the risk budget and the position cap."""
    risk = C("close") - C("stop_loss")
    q = F.floor(F.least(capital * risk_pct / 100 / F.nullif(risk, F.lit(0.0)), capital * max_pct / 100 / C("close")))
    ok = risk > 0
    return setups.withColumn("quantity", F.when(ok, F.greatest(q, F.lit(0)))).withColumn(
        "sizing_status", F.when(risk.isNull(), "NOT_AVAILABLE").when(~ok | (C("quantity") == 0), "REJECTED").otherwise("CALCULATED"))


# fixed rule weights of the direction score
OPTION_WEIGHTS = {"alignment": 10, "ema_direction": 10, "rsi": 10, "pivot": 15, "adx": 10, "volume": 10, "market": 5, "relative": 5}


def indicator_snapshot(panel: DataFrame, bench: DataFrame, days: int = 3) -> DataFrame:
    """Latest indicators of every bar: EMA10/20 and direction, RSI, ADX, ATR, pivots, volume, strength."""
    from barloom.operators.features import recursive_features

    df = panel.join(recursive_features(panel), ["symbol", "date"]).join(bench.select("date", C("close").alias("_b")), "date", "left")
    steps = [C("ema_20") if k == 0 else S.lag("ema_20", k) for k in range(days + 1)]
    rising = reduce(lambda a, b: a & b, [steps[k] > steps[k + 1] for k in range(days)])
    falling = reduce(lambda a, b: a & b, [steps[k] < steps[k + 1] for k in range(days)])
    enough = S.position() >= 20 + days
    return df.withColumns(
        {
            "ema20_direction": F.when(enough & rising, "RISING").when(enough & falling, "FALLING").otherwise("FLAT_OR_MIXED"),
            "resistance": S.max("high", 20, end=-1), "support": S.min("low", 20, end=-1),
            "volume_multiple": ratio("volume", S.mean("volume", 20, end=-1)),
            "close_location": ratio(C("close") - C("low"), C("high") - C("low")),
            "relative_strength": S.change("close", 20) - S.change("_b", 20), "bench_above_20": C("_b") > S.mean("_b", 20),
        }
    ).drop("_b")


def option_direction(snap: DataFrame) -> DataFrame:
    """CALL / PUT direction with a weighted score, levels and watch reason per bar."""
    c, e10, e20 = C("close"), C("ema_10"), C("ema_20")
    ok = lambda x: F.coalesce(x, F.lit(False))
    shared = {"adx": ok(C("adx_wilder_14") >= 25), "volume": ok(C("volume_multiple") >= 1.5)}
    call = {"alignment": ok((c > e10) & (e10 > e20)), "ema_direction": C("ema20_direction") == "RISING", "rsi": ok(C("rsi_wilder_14") > 70),
            "pivot": ok(c > C("resistance")), "market": ok(C("bench_above_20")), "relative": ok(C("relative_strength") > 0), **shared}
    put = {"alignment": ok((c < e10) & (e10 < e20)), "ema_direction": C("ema20_direction") == "FALLING", "rsi": ok(C("rsi_wilder_14") < 30),
           "pivot": ok(c < C("support")), "market": ok(~C("bench_above_20")), "relative": ok(C("relative_strength") < 0), **shared}
    pts = lambda r: sum((r[k].cast("int") * w for k, w in OPTION_WEIGHTS.items()), F.lit(0))
    df = snap.withColumns({"call_score": pts(call), "put_score": pts(put)})
    is_call = C("call_score") >= C("put_score")
    atr = C("atr_wilder_14")
    piv = F.when(is_call, C("resistance")).otherwise(C("support"))
    stop = F.when(is_call, F.least(piv, c) - atr).otherwise(F.greatest(piv, c) + atr)
    ext = F.when(is_call, c - e10).otherwise(e10 - c) / F.nullif(atr, F.lit(0.0))
    dist = F.when(is_call, c - piv).otherwise(piv - c) / F.nullif(atr, F.lit(0.0))
    df = df.withColumns({"right": F.when(is_call, "CALL").otherwise("PUT"), "score": F.greatest("call_score", "put_score"),
                         "underlying_stop": F.when(piv.isNotNull(), stop), "_d": dist, "_x": ext})
    risk = F.greatest(F.abs(c - C("underlying_stop")), atr)
    return df.withColumns(
        {
            "underlying_target": F.when(C("underlying_stop").isNotNull(), F.when(is_call, c + 2 * risk).otherwise(c - 2 * risk)),
            "watch_reason": F.when(atr.isNull() | (atr <= 0), "Indicator values unavailable.")
            .when(C("_x") > 1.25, "Setup is directionally valid but extended from EMA10.")
            .when(C("_d") > 0.5, "Setup needs retest; price is too far from pivot."),
        }
    ).drop("_d", "_x")


def option_contracts(chain: DataFrame, underlyings: DataFrame, as_of: Column, capital: float = 1e6) -> DataFrame:
    """Gates, premium scenarios, reward/risk and lots of every contract; the best one per underlying.

    ``chain``: symbol, right, expiry, strike, bid, ask, delta, theta, iv_percentile, volume, open_interest, lot_size.
    """
    j = chain.join(underlyings.select("symbol", "close", "underlying_stop", "underlying_target", C("right").alias("want")), "symbol")
    j = j.where(C("underlying_stop").isNotNull())
    mid = (C("bid") + C("ask")) / 2
    spread = F.when((C("bid") > 0) & (C("ask") >= C("bid")), (C("ask") - C("bid")) / F.nullif(mid, F.lit(0.0)) * 100)
    drag = F.abs("theta") * 3
    stop = F.greatest(F.lit(0.05), C("ask") - F.abs("delta") * F.abs(C("close") - C("underlying_stop")) - drag, C("ask") * 0.70)
    target = F.greatest(F.lit(0.05), C("bid") + F.abs("delta") * F.abs(C("underlying_target") - C("close")) - drag)
    j = j.withColumns({"dte": F.datediff("expiry", as_of), "spread_pct": spread, "stop_premium": stop, "target_premium": target})
    risk = (C("ask") - C("stop_premium")) * C("lot_size") + 40.0
    j = j.withColumns({"risk_per_lot": risk, "reward_risk": F.greatest(F.lit(0.0), (C("target_premium") - C("ask")) * C("lot_size")) / F.nullif(risk, F.lit(0.0))})
    j = j.withColumn("lots", F.floor(capital * 0.005 / F.nullif(C("risk_per_lot"), F.lit(0.0))))
    d = F.abs("delta")
    gates = {
        "right": C("right") == C("want"), "dte": C("dte").between(14, 35), "delta": d.between(0.50, 0.65), "floor": d >= 0.30,
        "spread": C("spread_pct") <= 2.0, "iv": C("iv_percentile") <= 70, "volume": C("volume") > 0, "oi": C("open_interest") > 0,
        "reward_risk": C("reward_risk") >= 2.0, "size": C("lots") >= 1,
    }
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(g, F.lit(False)), F.lit(n)) for n, g in gates.items()]))
    rank = (
        1 - F.abs(C("dte") - 21) / 21 + 1 - F.abs(d - 0.575) / 0.575 + 1 / F.greatest(F.coalesce("spread_pct", F.lit(100.0)), F.lit(0.01))
        + F.sqrt(C("volume") + C("open_interest")) / 1000)
    return j.withColumns({"failed_gates": failed, "contract_rank": rank})


def best_contract(contracts: DataFrame) -> DataFrame:
    keep = ["contract_rank", "expiry", "strike", "right", "reward_risk", "lots"]
    return contracts.where(F.size("failed_gates") == 0).groupBy("symbol").agg(F.max(F.struct(*keep)).alias("_b")).select("symbol", "_b.*")


# Signals and consensus -------------------------------------------------------


def signal_rules(scored: DataFrame, rules: Mapping[str, float]) -> DataFrame:
    """BUY / SELL / ACCUMULATE / WATCH with the confidence upgrade, from percentile thresholds."""
    buy = (C("pa") >= rules["primary_min"]) & (C("pb") >= rules["binary_min"])
    sell = (C("pa") <= 1 - rules["sell_min"]) & (C("pb") <= 1 - rules["sell_min"])
    acc = (C("pa") >= rules["accumulate_primary"]) & (C("pb") >= rules["accumulate_binary"])
    tuned = C("pc") >= rules["tuned_min"]
    return scored.withColumns(
        {
            "recommendation": F.when(buy, "BUY").when(sell, "SELL").when(acc, "ACCUMULATE").otherwise("WATCH"),
            "confidence": F.when(buy & tuned, "HIGH").when(buy, "MEDIUM").otherwise("LOW"),
            "tuned_status": F.when(buy & tuned, "CONFIRMED").when(buy, "NOT_CONFIRMED")
            .when((C("pa") >= rules["primary_min"]) & tuned, "RESEARCH_ONLY_TUNED_SIGNAL").otherwise("NO_TUNED_CONFIRMATION"),
        }
    )


def consensus(signals: DataFrame, positive: float = 0.25, negative: float = -0.25) -> DataFrame:
    """Decision per symbol from (symbol, category, score, confidence, veto) rows."""
    at = lambda k: F.max(F.when(C("category") == k, C("score")))
    n = lambda c: F.count(F.when(c, 1))
    a = signals.groupBy("symbol").agg(
        n(C("veto")).alias("vetoes"), F.avg("confidence").alias("_c"), F.count(F.lit(1)).alias("_n"),
        F.sum(F.when(C("score") > positive, 1).when(C("score") < negative, -1).otherwise(0)).alias("_dir"),
        n(C("category").isin("fundamentals", "valuation", "technical", "sector") & (C("score") > positive)).alias("positive_stack"),
        at("risk").alias("_risk"), at("macro").alias("_macro"), at("sector").alias("_sector"), at("technical").alias("_tech"),
        n(C("score") < -0.25).alias("_bear"),
        ratio(F.sum(C("score") * C("confidence")), F.sum("confidence")).alias("weighted_score"))
    low = lambda c: F.coalesce(C(c) < negative, F.lit(False))
    conf = clamp(C("_c") * (0.65 + 0.35 * F.abs("_dir") / C("_n")), 0.0, 1.0)
    stack = C("positive_stack")
    weak = low("_risk") | low("_macro") | low("_sector")
    buy = (stack >= 3) & (C("_risk").isNull() | (C("_risk") > negative))
    cases = [
        (C("vetoes") > 0, "REJECT", F.least(F.lit(0.9), 0.55 + 0.08 * C("vetoes"))),
        (low("_tech") & (stack >= 2), "WATCH", F.lit(0.55)), (weak & (stack >= 2), "WATCH", F.lit(0.5)),
        (buy, "BUY", F.least(F.lit(0.85), conf)), (C("_bear") >= 3, "EXIT", F.least(F.lit(0.8), conf)),
    ]
    decision, value = F.lit("WATCH"), F.least(F.lit(0.65), conf)
    for cond, name, v in reversed(cases):
        decision, value = F.when(cond, name).otherwise(decision), F.when(cond, v).otherwise(value)
    return a.withColumns({"decision": decision, "confidence": value}).drop(*[c for c in a.columns if c.startswith("_")])


def dual_listing(nse: DataFrame, bse: DataFrame, fo: DataFrame, as_of: Column, max_age: int = 1) -> DataFrame:
    """Eligibility reason codes of every security of two exchanges matched by ISIN."""
    a = nse.select("isin", *[C(c).alias(f"n_{c}") for c in ("symbol", "active", "series", "surveillance", "as_of")])
    b = bse.select("isin", *[C(c).alias(f"b_{c}") for c in ("symbol", "active", "as_of")])
    j = a.join(b, "isin", "full").join(fo.select("isin", F.lit(True).alias("_fo")).distinct(), "isin", "left")
    no = lambda c: ~F.coalesce(C(c), F.lit(False))
    both = C("n_symbol").isNotNull() & C("b_symbol").isNotNull()
    stale = (F.datediff(as_of, "n_as_of") > max_age) | (F.datediff(as_of, "b_as_of") > max_age)
    codes = F.array_distinct(F.array_compact(F.array(
        F.when(~both, F.lit("NOT_DUAL_LISTED")), F.when(both & stale, F.lit("STALE_REFERENCE_DATA")),
        F.when(both & (no("n_active") | (C("n_series") != "EQ") | no("b_active")), F.lit("NOT_DUAL_LISTED")),
        F.when(both & C("n_surveillance"), F.lit("SURVEILLANCE_RESTRICTED")), F.when(both & C("_fo"), F.lit("FO_STOCK_EXCLUDED")))))
    return j.withColumn("reason_codes", codes).withColumn("eligible", F.size("reason_codes") == 0).drop("_fo")


def shared_holders(holdings: DataFrame, holder: str, company: str) -> DataFrame:
    """Holders of more than one company with their company count; no pair is ever built."""
    distinct = holdings.select(holder, company).distinct()
    return distinct.groupBy(holder).agg(F.count(F.lit(1)).alias("companies")).where(C("companies") > 1)


def holding_changes(history: DataFrame, threshold: float) -> DataFrame:
    """Changes between consecutive periods of a holder above ``threshold`` points."""
    s = Series(["symbol", "holder"], "period")
    return history.withColumn("change", s.diff("pct")).where(F.abs("change") >= threshold)


def keyword_labels(docs: DataFrame, text: str, groups: Mapping[str, Sequence[str]], up: Sequence[str], down: Sequence[str]) -> DataFrame:
    """Terms found per group, stance and numbers of whole texts; the text is lowered once."""
    df = docs.withColumn("_t", F.lower(F.coalesce(C(text), F.lit(""))))
    has = lambda w: F.contains(C("_t"), F.lit(w))
    found = {g: F.array_sort(F.array_compact(F.array(*[F.when(has(w), F.lit(w)) for w in sorted(set(ws))]))) for g, ws in groups.items()}
    n = lambda ws: sum((has(w).cast("int") for w in ws), F.lit(0))
    df = df.withColumns({f"{g}_terms": a for g, a in found.items()} | {"_up": n(up), "_down": n(down)})
    return df.withColumn(
        "stance", F.when(C("_up") > C("_down"), "Bullish").when(C("_down") > C("_up"), "Bearish").otherwise("Neutral / unclear")
    ).drop("_t", "_up", "_down")


def aspect_distances(positions: DataFrame, bodies: Sequence[str], aspects: Sequence[float]) -> DataFrame:
    """Arc between every two bodies of a fixed list per date and its distance to each aspect."""
    wide = positions.groupBy("date").agg(*[F.max(F.when(C("body") == b, C("longitude"))).alias(b) for b in bodies])
    pairs = [(a, b) for i, a in enumerate(sorted(bodies)) for b in sorted(bodies)[i + 1:]]
    items = F.array(*[
        F.struct(F.lit(a).alias("body_a"), F.lit(b).alias("body_b"), F.abs(sc.signed_delta(C(a), C(b))).alias("separation")) for a, b in pairs])
    arcs = wide.select("date", F.explode(items).alias("o")).select("date", "o.*").where(C("separation").isNotNull())
    gaps = F.array(*[F.struct(F.lit(float(x)).alias("aspect"), F.abs(C("separation") - float(x)).alias("distance")) for x in aspects])
    return arcs.withColumn("o", F.explode(gaps)).select("date", "body_a", "body_b", "separation", "o.*")


def motion_features(positions: DataFrame) -> DataFrame:
    """Retrograde and sign change of every body against its previous position."""
    s = Series("body", "date")
    prev = s.lag("longitude")
    sign = lambda c: F.floor(sc.degrees(c) / 30.0)
    return positions.withColumns(
        {"retrograde": sc.signed_delta(prev, C("longitude")) < 0, "ingress": sign(prev) != sign(C("longitude"))})
