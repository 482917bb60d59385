"""Evidence from several sources: shared-holder links, fundamental snapshots, pattern flags on strength snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.rolling import Series, ratio
from barloom.functions.scoring import freshness

C = F.col
S = Series()

#: Alternative fields, either of which answers a required question, by its label.
REQUIRED = {
    "Revenue growth": ("sales_growth", "sales"), "Profit growth": ("profit_growth", "net_profit"), "Operating margin": ("operating_margin", "operating_profit"),
    "Debt/equity": ("debt_to_equity", "borrowings"), "Operating cash flow": ("operating_cashflow", "free_cashflow"),
}


def holder_links(holdings: DataFrame, hub: int = 32) -> DataFrame:
    """Links of ``holdings`` (holder, company, percent): source, target, relation, holders, weight, overlap.

    Rows without holder or company are ignored, repeated ones count once with their largest percent. A holder of one company
    links nothing. Two companies with common holders get one ``common`` row (source < target): the number of holders, the
    weight, which shares one unit of a holder in d companies among its d - 1 partners, and the sum of the smaller percents.
    A holder of more than ``hub`` companies would make a number of pairs with the square of d; it stands between its
    companies as a ``hub`` row for each (source: the holder) with the same weight, so every link is a path of two rows.
    Repeats are combined before holders meet, so a holder has at most as many rows in a task as there are companies. The pairs
    of a smaller holder come from one row with its companies, without a join. Pairs are not shuffled one by one: each holding
    goes once to the task of its company, with the companies after it (below ``hub`` / 2 of them on average) as arrays.
    """
    rows = holdings.where(C("holder").isNotNull() & C("company").isNotNull())
    rows = rows.groupBy("holder", "company").agg(F.max("percent").alias("percent"))
    degree = rows.groupBy("holder").agg(F.count(F.lit(1)).alias("degree")).where("degree > 1")
    rows = rows.join(degree, "holder").withColumn("unit", 1.0 / (C("degree") - 1))
    # a small holder is one row with its companies in order; each meets the ones after it
    small = rows.where(C("degree") <= hub).groupBy("holder", "unit").agg(F.sort_array(F.collect_list(F.struct("company", "percent"))).alias("_all"))
    firsts = small.select("unit", "_all", F.posexplode("_all").alias("_i", "_a")).where(F.size("_all") > C("_i") + 1)
    later = F.slice("_all", C("_i") + 2, F.lit(hub))
    lists = firsts.select(
        C("_a.company").alias("source"), "unit", F.transform(later, lambda b: b["company"]).alias("_targets"),
        F.transform(later, lambda b: F.least(C("_a.percent"), b["percent"])).alias("_least"))
    others = lists.repartition("source").select("source", "unit", F.explode(F.arrays_zip("_targets", "_least")).alias("_b"))
    pairs = others.groupBy("source", C("_b._targets").alias("target")).agg(
        F.count(F.lit(1)).alias("holders"), F.sum("unit").alias("weight"), F.sum("_b._least").alias("overlap"))
    hubs = rows.where(C("degree") > hub).select(
        C("holder").alias("source"), C("company").alias("target"), F.lit(1).cast("bigint").alias("holders"), C("unit").alias("weight"), C("percent").alias("overlap"))
    return pairs.withColumn("relation", F.lit("common")).unionByName(hubs.withColumn("relation", F.lit("hub")))


def fundamental_snapshot(as_of: DataFrame, evidence: DataFrame, fresh: int = 30, aging: int = 120) -> DataFrame:
    """The value of every field that counts for each row of ``as_of`` (symbol, as_of), with its source and age.

    ``evidence`` is long: symbol, field, value, source, precedence, seen (date). Of what was seen by ``as_of``, the highest
    precedence wins, then the latest date, then the larger value. Null values, NaN and rows without a date never count.
    """
    known = evidence.where(C("value").isNotNull() & ~F.isnan("value") & C("seen").isNotNull())
    best = F.max(F.struct("precedence", "seen", "value", "source")).alias("b")
    out = known.join(as_of, "symbol").where("seen <= as_of").groupBy("symbol", "as_of", "field").agg(best)
    return out.select(
        "symbol", "as_of", "field", "b.value", "b.source", "b.seen", F.datediff("as_of", "b.seen").alias("age_days"),
        freshness(C("as_of"), C("b.seen"), fresh, aging).alias("freshness"),
    )


def snapshot_gaps(as_of: DataFrame, snapshot: DataFrame, fresh: int = 30, aging: int = 120) -> DataFrame:
    """Per row of ``as_of``: fields found, sources used, freshness of the newest one, the required questions left open."""
    has = {label: F.coalesce(F.max(C("field").isin(*fields).cast("int")), F.lit(0)) for label, fields in REQUIRED.items()}
    found = as_of.join(snapshot.drop("freshness"), ["symbol", "as_of"], "left").groupBy("symbol", "as_of").agg(
        F.count("field").alias("fields"), F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"), F.max("seen").alias("seen"),
        F.concat_ws(", ", *[F.when(h == 0, label) for label, h in has.items()]).alias("missing"),
    )
    return found.withColumn("freshness", freshness(C("as_of"), C("seen"), fresh, aging))


def pattern_shapes(bars: DataFrame) -> DataFrame:
    """Shape inputs of the pattern flags per bar: dry-up, contraction, tight range, box, breakout of it, cup with handle.

    A comparison with an unfilled frame counts as false. The cup looks at fixed parts of the last 100 rows: left rim 1-30,
    low 21-75, right rim 61-90, handle the last 12.
    """
    prior = S.lag("close")
    df = bars.withColumns({
        "_tr": F.greatest(C("high") - C("low"), F.abs(C("high") - prior), F.abs(C("low") - prior)),
        "box_top": S.max("high", 20, end=-1), "box_bottom": S.min("low", 20, end=-1),
        "_left": F.max("high").over(S.frame(30, -70)), "_low": F.min("close").over(S.frame(55, -25)),
        "_right": F.max("high").over(S.frame(30, -10)), "_handle": F.min("close").over(S.frame(12)), "_row": S.position(),
    })
    df = df.withColumn("_above", (C("close") > C("box_top")).cast("int"))
    depth, handle = ratio("_low", "_left") - 1, ratio("_handle", "_right") - 1
    flags = {
        "volume_dry_up": S.mean("volume", 5) < 0.75 * S.mean("volume", 20),
        "atr_contracting": S.mean("_tr", 14) < S.mean("_tr", 50),
        "tight_range": ratio(S.max("high", 10), S.min("low", 10)) - 1 <= 0.08,
        "in_box": (ratio("box_top", "box_bottom") - 1 <= 0.15) & (C("close") >= C("box_top") * 0.95),
        "left_box": F.max("_above").over(S.frame(5)) == 1,
        "cup_with_handle": (C("_row") >= 100) & depth.between(-0.35, -0.10) & (C("_right") >= C("_left") * 0.92)
        & handle.between(-0.12, -0.02) & (C("close") >= C("_right") * 0.95),
    }
    df = df.withColumns({name: F.coalesce(c, F.lit(False)) for name, c in flags.items()})
    return df.select("symbol", "date", "box_top", "box_bottom", *flags)


def pattern_flags(bars: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Candidate flags of every row of a strength ``snapshot``; shapes come from the symbol's bars up to its date."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    df = snapshot.join(pattern_shapes(bars), ["symbol", "date"])
    stage2 = C("stage") == "Stage 2"
    return df.withColumns({
        "vcp_candidate": yes(stage2 & C("distance_to_pivot").between(-0.05, 0.01) & C("volume_dry_up") & C("atr_contracting") & C("tight_range")),
        "darvas_candidate": yes(C("in_box") & (C("sma200") > C("sma200_prior"))),
        "darvas_breakout": yes(C("left_box") & (C("rs_rating") >= 70)),
        "volume_surge": yes((C("volume_ratio") >= 1.5) & (C("ret_1d") > 0)),
        "just_entered_stage2": yes(stage2 & ~yes(C("stage_5d_ago") == "Stage 2")),
    })
