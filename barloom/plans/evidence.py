"""Queries over holder links, fundamental snapshots and pattern flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators import evidence as ev
from barloom.plans import reports as rp
from barloom.plans import shapes as sh
from barloom.plans.fundamentals import FIELDS, annual_facts, market_days, quarter_facts
from barloom.plans.registry import query
from barloom.plans.shapes import with_
from barloom.plans.sqlkit import over, roll
from barloom.sources.tables import read

C = F.col
HUB = 32


@query(
    "source:s target:s relation:s holders:i weight overlap:f4",
    covers="JOIN-16",
    sql=f"""WITH q AS (SELECT l_partkey AS p, printf('S%012d', l_suppkey) AS c, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
 h AS MATERIALIZED (SELECT printf('P%012d', p) AS holder, c, 100 * v / sum(v) OVER (PARTITION BY p) AS percent, count(*) OVER (PARTITION BY p) AS d FROM q)
SELECT a.c AS source, b.c AS target, 'common' AS relation, count(*) AS holders, sum(1.0 / CAST(a.d - 1 AS DOUBLE)) AS weight, sum(least(a.percent, b.percent)) AS overlap
 FROM h a JOIN h b ON a.holder = b.holder AND a.c < b.c WHERE a.d <= {HUB} GROUP BY ALL
UNION ALL SELECT holder, c, 'hub', 1, 1.0 / CAST(d - 1 AS DOUBLE), percent FROM h WHERE d > {HUB}""",
)
def shared_holder_links(spark, sf):
    """Companies (suppliers) linked by common holders (parts); a holding is the share of the part's quantity."""
    q = read(spark, sf, "lineitem").where("l_partkey IS NOT NULL").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("v"))
    unknown = F.lit(-(2**63))  # stands for a null key and sorts first, as its name does
    key = lambda c: F.coalesce(C(c).cast("bigint"), unknown)
    held = q.withColumns({"holder": key("l_partkey"), "company": key("l_suppkey")})
    total = F.sum("v").over(Window.partitionBy("holder"))
    held = held.select("holder", "company", (100 * C("v") / total).alias("percent"))
    name = lambda letter, c: F.format_string(f"{letter}%012d", F.nullif(C(c), unknown))
    links = ev.holder_links(held, HUB)  # on numbers; named when the pairs are counted
    return links.withColumns({"source": F.when(C("relation") == "hub", name("P", "source")).otherwise(name("S", "source")), "target": name("S", "target")})


ANNUAL = ("borrowings", "equity_capital", "reserves", "operating_cashflow", "free_cashflow")


def _evidence(spark, sf):
    """Three sources: quarterly statements (by publication, else 45 days after), annual ones (90 days after), the market's day."""
    long = lambda df, fields, source, rank: df.select(
        "symbol", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c.cast("double").alias("value")) for n, c in fields.items()])).alias("f"),
        F.lit(source).alias("source"), F.lit(rank).alias("precedence"), "seen").select("symbol", "f.*", "source", "precedence", "seen")
    quarters = quarter_facts(spark, sf).withColumn("seen", F.coalesce("publication_date", F.date_add("period_end", 45)))
    years = annual_facts(spark, sf).withColumn("seen", F.date_add("period_end", 90))
    days = market_days(spark, sf).withColumn("seen", C("date"))
    parts = [
        long(quarters, {f: C(f) for f in FIELDS}, "statement", 2),
        long(years, {f: C(f) for f in ANNUAL} | {"net_profit": C("free_cashflow")}, "annual", 1),
        long(days, {"sales": C("turnover"), "turnover": C("turnover")}, "market", 0),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _as_of(spark, sf):
    """Every customer at its last order day, and at the middle of its history."""
    span = market_days(spark, sf).groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    half = F.date_add("a", F.floor(F.datediff("b", "a") / 2).cast("int"))
    return span.select("symbol", F.explode(F.array_distinct(F.array("b", half))).alias("as_of"))


_LONG = (
    [f"SELECT symbol, '{f}' AS field, CAST({f} AS DOUBLE) AS value, 'statement' AS source, 2 AS precedence, coalesce(publication_date, period_end + 45) AS seen FROM qf" for f in FIELDS]
    + [f"SELECT symbol, '{n}', CAST({f} AS DOUBLE), 'annual', 1, annual_period_end + 90 FROM annf" for n, f in [*[(f, f) for f in ANNUAL], ("net_profit", "free_cashflow")]]
    + [f"SELECT symbol, '{n}', CAST(turnover AS DOUBLE), 'market', 0, date FROM mkt" for n in ("sales", "turnover")]
)
_BLOCKS = {
    "evi": " UNION ALL ".join(_LONG),
    "aso": "SELECT DISTINCT symbol, unnest([b, a + CAST(floor(date_diff('day', a, b) / 2) AS INTEGER)]) AS as_of FROM (SELECT symbol, min(date) AS a, max(date) AS b FROM mkt GROUP BY symbol)",
    "fsn": """SELECT symbol, as_of, field, b.value AS value, b.source AS source, b.seen AS seen, date_diff('day', b.seen, as_of) AS age_days FROM (
 SELECT symbol, as_of, field, arg_max(struct_pack(value := value, source := source, seen := seen), (precedence, seen, value, source)) AS b
 FROM evi JOIN aso USING (symbol) WHERE seen <= as_of AND value IS NOT NULL GROUP BY ALL)""",
}
_FRESH = "CASE WHEN {0} IS NULL THEN 'MISSING' WHEN {0} <= 30 THEN 'FRESH' WHEN {0} <= 120 THEN 'AGING' ELSE 'STALE' END AS freshness"


@query(
    "symbol:s as_of:d field:s value:f4 source:s seen:d age_days:i freshness:s",
    covers="RUL-24 SCA-15",
    sql=with_("qf annf mkt", f"SELECT *, {_FRESH.format('age_days')} FROM fsn", **_BLOCKS),
)
def fundamental_snapshot(spark, sf):
    return ev.fundamental_snapshot(_as_of(spark, sf), _evidence(spark, sf))


@query(
    "symbol:s as_of:d fields:i sources:s seen:d missing:s freshness:s",
    covers="RUL-24 SCA-15",
    sql=with_(
        "qf annf mkt",
        f"SELECT *, {_FRESH.format('date_diff(' + repr('day') + ', seen, as_of)')} FROM (SELECT symbol, as_of, count(field) AS fields, coalesce(string_agg(DISTINCT source, ', ' ORDER BY source), '') AS sources, max(seen) AS seen, concat_ws(', ', "
        + ", ".join(f"CASE WHEN count(*) FILTER (field IN {fields}) = 0 THEN '{label}' END" for label, fields in ev.REQUIRED.items())
        + ") AS missing FROM aso LEFT JOIN fsn USING (symbol, as_of) GROUP BY ALL)",
        **_BLOCKS,
    ),
)
def fundamental_snapshot_gaps(spark, sf):
    as_of = _as_of(spark, sf)
    return ev.snapshot_gaps(as_of, ev.fundamental_snapshot(as_of, _evidence(spark, sf)))


@query(
    "symbol:s date:d stage:s rs_rating box_top box_bottom volume_dry_up:b atr_contracting:b tight_range:b cup_with_handle:b "
    "vcp_candidate:b darvas_candidate:b darvas_breakout:b volume_surge:b just_entered_stage2:b",
    covers="RUL-19",
    sql=with_(
        "bars snap",
        """SELECT *, coalesce(stage = 'Stage 2' AND distance_to_pivot BETWEEN -0.05 AND 0.01 AND volume_dry_up AND atr_contracting AND tight_range, FALSE) AS vcp_candidate,
 coalesce(in_box AND sma200 > p200, FALSE) AS darvas_candidate, coalesce(left_box AND rs_rating >= 70, FALSE) AS darvas_breakout,
 coalesce(volume_ratio >= 1.5 AND ret_1d > 0, FALSE) AS volume_surge, coalesce(stage = 'Stage 2' AND coalesce(stage5, '') <> 'Stage 2', FALSE) AS just_entered_stage2
 FROM snap JOIN shp USING (symbol, date)""",
        shp0=f"""SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc,
 {roll('max', 'high', 20, -1)} AS box_top, {roll('min', 'low', 20, -1)} AS box_bottom, max(high) OVER {over(30, -70)} AS rim_a, min(close) OVER {over(55, -25)} AS cup,
 max(high) OVER {over(30, -10)} AS rim_b, min(close) OVER {over(12)} AS hnd, row_number() OVER (PARTITION BY symbol ORDER BY date) AS pos FROM bars)""",
        shp=f"""SELECT symbol, date, box_top, box_bottom, coalesce({roll('avg', 'volume', 5)} < 0.75 * {roll('avg', 'volume', 20)}, FALSE) AS volume_dry_up,
 coalesce({roll('avg', 'tr', 14)} < {roll('avg', 'tr', 50)}, FALSE) AS atr_contracting, coalesce({roll('max', 'high', 10)} / {roll('min', 'low', 10)} - 1 <= 0.08, FALSE) AS tight_range,
 coalesce(box_top / box_bottom - 1 <= 0.15 AND close >= box_top * 0.95, FALSE) AS in_box,
 coalesce(max(CAST(close > box_top AS INTEGER)) OVER {over(5)} = 1, FALSE) AS left_box,
 coalesce(pos >= 100 AND cup / rim_a - 1 BETWEEN -0.35 AND -0.10 AND rim_b >= rim_a * 0.92 AND hnd / rim_b - 1 BETWEEN -0.12 AND -0.02 AND close >= rim_b * 0.95, FALSE) AS cup_with_handle FROM shp0""",
    ),
)
def web_pattern_flags(spark, sf):
    stored = sh.stored_bars(spark, sf)
    return ev.pattern_flags(stored[0], rp.snapshot(spark, sf, stored))
