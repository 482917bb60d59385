"""Quarterly results: growth, margin, valuation and evidence of every quarter, scored into a research action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import scoring as sc
from barloom.functions.rolling import Series, ratio
from barloom.functions.text import parse_number

C = F.col
S = Series("symbol", "period_end")

# Sector and company words of financial companies, whose margins are not compared.
FINANCIAL_TERMS = ("bank", "nbfc", "finance", "financial", "insurance", "investment")
METRICS = ("revenue", "operating_profit", "net_profit", "eps")


def loose_value(labelled: Column, label: str) -> Column:
    """Value of the first entry of ``array<struct<label,value>>`` whose label contains ``label``, whatever the case."""
    hit = F.filter(labelled, lambda e: F.lower(e["label"]).contains(label.lower()))
    return F.try_element_at(hit, F.lit(1))["value"]


def growth_text(growth: Column, current: Column) -> Column:
    """Printed form of a growth with its note."""
    v, note = growth["value"], growth["note"]
    return (
        F.when(note == "unavailable", "Unavailable")
        .when(note == "zero_base", F.when(current > 0, "Turnaround from zero base").when(current < 0, "Loss from zero base").otherwise("No change from zero base"))
        .when(note == "turnaround", "Turnaround to profit")
        .when(note == "loss_change", F.when(v > 0, F.format_string("Loss reduced %+.1f%%", v * 100)).otherwise(F.format_string("Loss increased %+.1f%%", F.abs(v) * 100)))
        .otherwise(F.format_string("%+.1f%%", v * 100))
    )


def _list(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for cond, name in pairs]))


def with_comparisons(quarters: DataFrame) -> DataFrame:
    """Metrics of the quarter before (``prev_``) and of the year before (``year_``).

    A series of three or four quarters compares its year with the first quarter that it has; a shorter one has none.
    """
    seen = S.position()
    year = lambda m: F.when(seen >= 5, S.lag(m, 4)).when(seen >= 3, F.first(m).over(S.w))
    return quarters.withColumns({f"prev_{m}": S.lag(m) for m in METRICS} | {f"year_{m}": year(m) for m in METRICS})


def quality_notes(text: Column) -> Column:
    """Disclosures in a quarter's texts that make its earnings less repeatable."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return _list(
        (t.contains("exceptional") | t.contains("one-time"), "exceptional item"), (t.contains("other income"), "other income"),
        (t.contains("limited review") & (t.contains("qualification") | t.contains("emphasis")), "review observation"))


def valuation(pe: Column) -> Column:
    return F.when(pe.isNull(), "Insufficient data").when(pe <= 18, "Attractive").when(pe <= 35, "Reasonable").otherwise("Expensive")


def analysed_results(quarters: DataFrame) -> DataFrame:
    """One row per symbol and quarter with growth, margin change, valuation, evidence, score, strength and action.

    Input: ``symbol, period_end``, the four metrics, ``sector``, ``company``, ``ratios array<struct<label,value>>`` as
    printed, ``text`` (all texts of the quarter), ``document`` and ``document_hash`` (NULL where there is none),
    ``facts array<string>`` found in the document, ``warnings`` and ``errors`` (counts). NULL counts are zero and a NULL
    array is empty; a metric that is missing leaves its growth unavailable. One window per symbol orders its quarters,
    all else is a column of the row.
    """
    df = with_comparisons(quarters)
    margin = ratio("operating_profit", "revenue")
    empty = F.array().cast("array<string>")
    n_of = lambda c: F.coalesce(C(c), F.lit(0))
    name = F.lower(F.concat_ws(" ", "sector", "company"))
    df = df.withColumns({
        **{f"_{m}_{k}": sc.growth(C(m), C(f"{b}_{m}")) for m, k, b in (
            ("revenue", "yoy", "year"), ("revenue", "qoq", "prev"), ("net_profit", "yoy", "year"), ("net_profit", "qoq", "prev"), ("eps", "yoy", "year"))},
        "operating_margin": margin,
        "margin_change_bps": (margin - ratio("year_operating_profit", "year_revenue")) * 10000,
        "notes": quality_notes(C("text")), "pe": parse_number(F.regexp_replace(loose_value(C("ratios"), "Stock P/E"), r"[^0-9.()\-]", "")),
        "financial": F.coalesce(name.rlike("|".join(FINANCIAL_TERMS)), F.lit(False)),
        "_facts": F.coalesce(C("facts"), empty), "_warn": n_of("warnings"), "_err": n_of("errors"),
    })
    found = C("document").isNotNull() & (F.size("_facts") > 0)
    ry, py, bps = C("_revenue_yoy")["value"], C("_net_profit_yoy")["value"], C("margin_change_bps")
    df = df.withColumns({"valuation": valuation(C("pe"))})
    fair = C("valuation").isin("Attractive", "Reasonable")
    pts = lambda *cases: F.coalesce(sc.ladder_first(*cases), F.lit(0))
    score = (
        pts((ry >= 0.12, 18), (ry < 0, -10)) + pts((py >= 0.15, 22), (py < 0, -16))
        + pts((C("financial"), 0), (bps >= 100, 14), (bps <= -100, -12)) - F.least(F.lit(15), F.size("notes") * 5)
        + pts((found, 8)) + pts((fair, 10), (C("valuation") == "Expensive", -8)))
    evidence = (
        2 + pts((C("document").isNotNull() & C("document_hash").isNotNull(), 2))
        + pts(((F.size("_facts") > 0) & ~F.array_contains("_facts", "Needs OCR"), 2))
        - pts((C("_warn") > 0, 2)) - pts((C("_err") > 0, 2)))
    df = df.withColumns({
        "_score": score, "confidence": F.when(evidence >= 5, "High").when(evidence >= 2, "Medium").otherwise("Low"),
        "improved": _list((ry >= 0.12, "revenue"), (py >= 0.15, "profit"), (~C("financial") & (bps >= 100), "margin")),
        "weakened": _list((ry < 0, "revenue"), (py < 0, "profit"), (~C("financial") & (bps <= -100), "margin")),
        "unanswered": _list(
            (~F.coalesce((ry >= 0.12) | (ry < 0), F.lit(False)), "revenue growth"), (~F.coalesce((py >= 0.15) | (py < 0), F.lit(False)), "profit growth"),
            (C("financial"), "margin of a financial company"), (C("valuation") == "Insufficient data", "valuation")),
        "risks": F.concat("notes", _list(
            (C("document").isNotNull() & ~found, "little evidence in the document"), (C("document").isNull(), "no document"),
            (C("_err") > 0, "extraction errors"), (C("_warn") > 0, "validation warnings"))),
    })
    low, strong = C("confidence") == "Low", C("strength") == "Strong"
    df = df.withColumn("strength", F.when(low, "Needs verification").when(C("_score") >= 55, "Strong").when(C("_score") >= 25, "Mixed").otherwise("Weak"))
    df = df.withColumns({
        "score": F.least(F.greatest(C("_score"), F.lit(0)), F.lit(100)).cast("double"),
        "action": F.when(low, "Needs verification").when(strong & fair, "Research priority")
        .when(strong, "Promising results — investment assessment incomplete").when(C("strength") == "Mixed", "Mixed — monitor").otherwise("Weak results"),
        "shortlisted": strong & fair & ~low & (F.size("risks") == 0),
        **{f"{m}_{k}": growth_text(C(f"_{m}_{k}"), C(m)) for m, k in (
            ("revenue", "yoy"), ("revenue", "qoq"), ("net_profit", "yoy"), ("net_profit", "qoq"), ("eps", "yoy"))},
    })
    return df.select(
        "symbol", "period_end", "revenue_yoy", "revenue_qoq", "net_profit_yoy", "net_profit_qoq", "eps_yoy", "operating_margin", "margin_change_bps",
        "pe", "valuation", "confidence", "score", "strength", "action", "shortlisted", "improved", "weakened", "risks", "unanswered")
