"""Point-in-time fundamentals: long facts, event features, availability and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions import text as tx
from barloom.functions.frames import with_row
from barloom.functions.rolling import Series, ratio
from barloom.operators.asof import as_of, next_session
from barloom.operators.order_stats import quantiles
from barloom.sources.staging import stage

C = F.col


def merge_point_in_time(market: DataFrame, facts: DataFrame, lag_days: int = 45) -> DataFrame:
    """Backward as-of join on the availability date; same-day facts are visible.

    A missing publication date is replaced by period end plus a reporting lag and marked.
    """
    f = facts.withColumns(
        {
            "availability_estimated": C("publication_date").isNull(),
            "available_from": F.coalesce("publication_date", F.date_add("period_end", lag_days)),
        }
    )
    return as_of(market, f, ["symbol"], "date", "available_from", ties=["period_end"])


def pit_violations(merged: DataFrame, known: str = "available_from") -> DataFrame:
    """Rows that saw a fact before it was available; must be empty."""
    return merged.where(C(known) > C("date"))


def daily_features(market: DataFrame, events: DataFrame) -> DataFrame:
    """As-of join on the verified publication date with the report age in days."""
    usable = events.where(
        C("publication_date").isNotNull() & (F.upper("publication_date_quality") != "MISSING")
    )
    out = as_of(market, usable, ["symbol"], "date", "publication_date", ties=["period_end"])
    return out.withColumn("days_since_report", F.datediff("date", "publication_date"))


def effective_session_features(market: DataFrame, events: DataFrame, sessions: DataFrame) -> DataFrame:
    """As-of join on the first session strictly after publication (the stricter mode)."""
    ev = next_session(events, sessions, "publication_date", "effective_date")
    out = as_of(market, ev, ["symbol"], "date", "effective_date", ties=["period_end"])
    return out.withColumn("days_since_report", F.datediff("date", "effective_date"))


def latest_known(events: DataFrame, as_of_date: Column, known: str = "publication_date") -> DataFrame:
    """Newest fact of each symbol known at a cutoff."""
    rest = [c for c in events.columns if c != "symbol"]
    order = [known, *[c for c in rest if c != known]]
    return (
        events.where(C(known) <= as_of_date)
        .groupBy("symbol").agg(F.max(F.struct(*order)).alias("_r"))
        .select("symbol", *[C(f"_r.{c}").alias(c) for c in rest])
    )


def base_grid(symbols: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every symbol with every session. The calendar travels as one array (bounded by the
    number of sessions) in a scalar subquery, and is exploded per symbol."""
    cal = sessions.select("date").distinct().agg(F.sort_array(F.collect_set("date")).alias("_c"))
    return with_row(symbols.select("symbol").distinct(), cal).select("symbol", F.explode("_c").alias("date"))


def to_long(wide: DataFrame, ids: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Wide statement columns to (ids, field, value) rows, NULL cells left out."""
    return wide.unpivot(list(ids), list(fields), "field", "value").where(C("value").isNotNull())


def parse_statement(raw: DataFrame, aliases: DataFrame, table_type: str) -> DataFrame:
    """Raw statement cells (symbol, label, period_label, cell) to normalised long facts."""
    annual = table_type in ("annual_pnl", "balance_sheet", "cashflow", "ratios")
    df = raw.join(aliases, tx.clean_label(C("label")) == C("alias"))
    return df.select(
        "symbol", tx.period_end(C("period_label"), annual).alias("period_end"), "field",
        C("cell").alias("raw_value"), tx.parse_number(C("cell")).alias("value"),
    ).where(C("period_end").isNotNull())


def to_wide(long: DataFrame, keys: Sequence[str], fields: Sequence[str], seq: str) -> DataFrame:
    """One row per key, one column per field, last written value wins."""
    aggs = [
        F.max(F.when((C("field") == f) & C("value").isNotNull(), F.struct(seq, "value")))["value"].alias(f)
        for f in fields
    ]
    return long.groupBy(*keys).agg(*aggs)


def event_features(quarters: DataFrame) -> DataFrame:
    """Year-over-year growth, acceleration, margin and coverage per (symbol, period)."""
    s = Series("symbol", "period_end")
    df = quarters.withColumns(
        {f"{c}_growth_yoy": s.change(c, 4) for c in ("sales", "net_profit", "eps")}
        | {
            "operating_margin": tx.coalesce_percent(C("opm_pct"), ratio("operating_profit", "sales")),
            "interest_coverage": ratio("operating_profit", "interest"),
        }
    )
    return df.withColumns(
        {
            "sales_growth_acceleration": s.diff("sales_growth_yoy", 1),
            "profit_growth_acceleration": s.diff("net_profit_growth_yoy", 1),
            "operating_margin_change_yoy": s.diff("operating_margin", 4),
        }
    )


def add_latest_annual(events: DataFrame, annual: DataFrame) -> DataFrame:
    """Latest annual period not after the quarter, and the ratios built on it.

    Balance-sheet ratios are blanked for financial companies.
    """
    a = annual.withColumnRenamed("period_end", "annual_period_end")
    df = as_of(events, a, ["symbol"], "period_end", "annual_period_end")
    equity = F.coalesce("equity_capital", F.lit(0.0)) + F.coalesce("reserves", F.lit(0.0))
    bank = C("financial_type").isin("BANK", "NBFC", "INSURANCE")
    keep = lambda c: F.when(~bank, c)
    return df.withColumns(
        {
            "debt_to_equity": keep(ratio("borrowings", equity)),
            "cashflow_to_profit": keep(ratio("operating_cashflow", "net_profit")),
            "free_cashflow_margin": keep(ratio("free_cashflow", "sales")),
            "operating_margin": keep(C("operating_margin")),
            "operating_margin_change_yoy": keep(C("operating_margin_change_yoy")),
        }
    )


def resolve_publications(periods: DataFrame, announcements: DataFrame, sessions: DataFrame) -> DataFrame:
    """Best-scoring announcement 0..90 (annual 0..120) days after each period end.

    ``announcements``: symbol, ts, description, body, reference, confidence, source. The texts are scored once, before
    any shuffle; repeated announcements are removed on the scored rows, and of different ones with one symbol, ts and
    reference the best counts. The best match is a max of a struct, so a symbol with very many announcements is combined
    map-side.
    """
    ann = announcements.select(
        "symbol", "ts", "reference", "confidence", "source", F.to_date("ts").alias("ann_date"),
        tx.period_in_text(F.concat_ws(" ", "description", "body")).alias("named_period"),
        tx.announcement_score(C("description"), C("body")).alias("base_score"),
    ).distinct()
    limit = F.when(C("result_type") == "ANNUAL", 120).otherwise(90)
    days = F.datediff("ann_date", "period_end")
    score = F.when(C("named_period").isNull(), C("base_score") + 10).when(
        C("named_period") == C("period_end"), C("base_score") + 50).otherwise(0)
    # equi-join on (symbol, quarter): the range of a period covers two or three
    quarter = lambda d: F.year(d) * 4 + F.quarter(d)
    spans = periods.withColumn(
        "_quarter", F.explode(F.sequence(quarter("period_end"), quarter(F.date_add("period_end", limit)))))
    ann = ann.withColumn("_quarter", quarter("ann_date"))
    hits = spans.join(ann, ["symbol", "_quarter"]).where((days >= 0) & (days <= limit))
    hits = hits.withColumns({"score": score, "days_after": days}).where(C("score") > 0)
    best = hits.groupBy("symbol", "period_end", "result_type").agg(
        F.min(F.struct((-C("score")).alias("neg"), "days_after", "ts", "reference", "confidence", "source")).alias("_b")
    )
    out = periods.join(best, ["symbol", "period_end", "result_type"], "left").select(
        "symbol", "period_end", "result_type",
        C("_b.ts").alias("publication_ts"), F.to_date("_b.ts").alias("publication_date"),
        F.coalesce(-C("_b.neg"), F.lit(0)).alias("match_score"),
        F.coalesce(F.when(-C("_b.neg") >= 80, C("_b.confidence")).when(C("_b.neg").isNotNull(), "MEDIUM"),
                   F.lit("MISSING")).alias("confidence"),
        F.coalesce("_b.source", F.lit("MISSING")).alias("source"),
        C("_b.reference").alias("reference"),
    )
    # the calendar reads the dates of the matches and the result their rows: the search is done once
    return next_session(stage(out, "publications"), sessions, "publication_date", "effective_date")


def availability_master(resolved: DataFrame) -> DataFrame:
    """VERIFIED_HIGH / VERIFIED_MEDIUM / TRUE_UNRESOLVED from the resolved publications."""
    known = C("publication_date").isNotNull()
    level = F.when(known & (C("confidence") == "HIGH"), "VERIFIED_HIGH").when(
        known & (C("confidence") == "MEDIUM"), "VERIFIED_MEDIUM").otherwise("TRUE_UNRESOLVED")
    df = resolved.withColumn("publication_confidence", level)
    ok = C("publication_confidence") != "TRUE_UNRESOLVED"
    return df.withColumns(
        {
            "availability_method": F.when(ok, "VERIFIED_PUBLICATION").otherwise("TRUE_UNRESOLVED"),
            "known_public_by": F.when(ok, C("publication_date")),
            "ml_effective_date": F.when(ok, C("effective_date")),
            "delay_days": F.when(ok, F.datediff("publication_date", "period_end")),
            "is_conservative": F.lit(0),
        }
    )


def value_matches(docs: DataFrame, facts: DataFrame, within_days: int | None = None) -> DataFrame:
    """Whether each expected value is found in each document of its symbol.

    ``docs``: symbol, reference, known_by, body. The document is normalised once before
    the join and whole texts are searched. With ``within_days`` a document is only held
    against periods that ended at most that many days before it was known: an equi-join on
    symbol and period bucket, so work grows with the documents and not with a symbol's history.
    """
    d = docs.withColumn("_norm", tx.normalize_number_text(C("body"))).drop("body")
    f = facts.withColumn("_variants", tx.number_variants(C("value"), C("raw_value")))
    found = F.exists("_variants", lambda v: F.contains(C("_norm"), v))
    if within_days is None:
        pairs = d.join(f, "symbol")
    else:
        bucket = lambda day: F.floor(F.unix_date(day) / (within_days + 1))
        last = bucket(C("known_by"))
        d = d.withColumn("_bucket", F.explode(F.array(last - 1, last)))
        pairs = d.join(f.withColumn("_bucket", bucket(C("period_end"))), ["symbol", "_bucket"])
        pairs = pairs.where(F.datediff("known_by", "period_end").between(0, within_days))
    return pairs.select(
        "symbol", "period_end", "reference", "known_by", "field", found.alias("found")
    )


def safe_late(matches: DataFrame) -> DataFrame:
    """Earliest document per (symbol, period) that confirms at least two values."""
    per = matches.groupBy("symbol", "period_end", "reference", "known_by").agg(
        F.count(F.when(C("found"), 1)).alias("matched"),
        F.count(F.when(~C("found"), 1)).alias("missed"),
    )
    return per.where(C("matched") >= 2).groupBy("symbol", "period_end").agg(
        F.min(F.struct("known_by", "reference", "matched")).alias("_b")
    ).select("symbol", "period_end", "_b.*")


def apply_safe_late(master: DataFrame, late: DataFrame, sessions: DataFrame) -> DataFrame:
    """Upgrade unresolved rows that a later document proves to be public."""
    dated = next_session(late, sessions, "known_by", "_eff").where(C("_eff").isNotNull())
    j = master.join(
        dated.select("symbol", "period_end", "known_by", "_eff", "matched"), ["symbol", "period_end"], "left"
    )
    up = (C("publication_confidence") == "TRUE_UNRESOLVED") & C("_eff").isNotNull()
    return j.withColumns(
        {
            "known_public_by": F.when(up, C("known_by")).otherwise(C("known_public_by")),
            "ml_effective_date": F.when(up, C("_eff")).otherwise(C("ml_effective_date")),
            "delay_days": F.when(up, F.datediff("known_by", "period_end")).otherwise(C("delay_days")),
            "is_conservative": F.when(up, 1).otherwise(C("is_conservative")),
            "availability_method": F.when(up, "VALUE_MATCH_DOCUMENT").otherwise(C("availability_method")),
            "match_count": F.when(up, C("matched")).otherwise(0),
            "publication_confidence": F.when(up, "SAFE_LATE_AVAILABILITY").otherwise(
                C("publication_confidence")),
        }
    ).drop("known_by", "_eff", "matched")


def best_evidence(candidates: DataFrame, keys: Sequence[str], priority: str, ts: str) -> DataFrame:
    """One candidate per key: lowest priority number, then earliest time."""
    rest = [c for c in candidates.columns if c not in keys]
    order = [priority, ts, *[c for c in rest if c not in (priority, ts)]]
    return candidates.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_b")).select(
        *keys, *[C(f"_b.{c}").alias(c) for c in rest]
    )


def evidence_conflicts(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose sources disagree on the date, with the spread in days."""
    return candidates.groupBy(*keys).agg(
        F.countDistinct("event_date").alias("dates"), F.countDistinct("source").alias("sources"),
        F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"),
    ).where(C("dates") > 1).withColumn("spread_days", F.datediff("last_date", "first_date"))


def versions(facts: DataFrame) -> DataFrame:
    """Versioned facts: a new version only when the payload hash differs from the one before."""
    s = Series(["symbol", "period_end"], "ts")
    h = F.sha2(F.to_json(F.struct("sales", "net_profit", "eps")), 256)
    df = facts.withColumn("payload_hash", h)
    df = df.withColumn(
        "revised", F.coalesce(s.lag("payload_hash") != C("payload_hash"), F.lit(False))
    )
    first = s.lag("payload_hash").isNull()
    return df.withColumn("_new", (first | C("revised")).cast("int")).withColumn(
        "version", F.sum("_new").over(s.w)
    ).drop("_new")


def snapshot_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """ADDED / REMOVED / CHANGED / SAME rows between two snapshots."""
    a = before.select(*keys, F.struct(*values).alias("_a"))
    b = after.select(*keys, F.struct(*values).alias("_b"))
    return a.join(b, list(keys), "full").withColumn(
        "change",
        F.when(C("_a").isNull(), "ADDED").when(C("_b").isNull(), "REMOVED")
        .when(C("_a").eqNullSafe(C("_b")), "SAME").otherwise("CHANGED"),
    ).drop("_a", "_b")


def coverage(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct periods per field and the status ladder of each key."""
    df = long.groupBy(*keys).agg(
        F.countDistinct("period_end").alias("periods"),
        F.countDistinct("field").alias("fields"),
        F.countDistinct(F.when(C("publication_date").isNotNull(), C("period_end"))).alias("published"),
        F.countDistinct(F.when(C("field") == "sales", C("period_end"))).alias("sales_periods"),
    )
    return df.withColumn(
        "status",
        F.when((C("periods") >= 8) & (C("published") >= 8), "GOOD")
        .when(C("periods") >= 4, "PARTIAL").otherwise("POOR"),
    )


def fill_medians(df: DataFrame, features: Sequence[str], fit: Column) -> DataFrame:
    """Missing flags and median imputation; medians come from the fit rows only."""
    fitted = df.where(fit)
    j = df
    for f in features:
        j = with_row(j, quantiles(fitted, [], f, {f"_m_{f}": 0.5}))
    flags = {f"{f}_missing": C(f).isNull().cast("int") for f in features}
    return j.withColumns(flags).withColumns(
        {f: F.coalesce(C(f), C(f"_m_{f}")) for f in features}
    ).drop(*[f"_m_{f}" for f in features])
