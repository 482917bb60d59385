"""Queries over quarterly results."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import results as rs
from barloom.plans.fundamentals import quarter_facts
from barloom.plans.registry import query
from barloom.plans.shapes import define_cte, with_
from barloom.sources.tables import read

C = F.col


def result_records(spark, sf):
    """A quarter's statement with what was published beside it.

    Sales stand for the price of the company, so their ratio to profit is its P/E. Orders without a priority are other
    income, pending ones an exceptional item and a scan not read yet, medium ones a limited review with an emphasis.
    """
    o = read(spark, sf, "orders")
    has = lambda cond: F.max(F.when(cond, 1).otherwise(0)) == 1
    pe = F.last_day(F.add_months(F.trunc(F.to_date("o_orderdate"), "quarter"), 2))
    seen = o.groupBy(F.format_string("C%012d", C("o_custkey").cast("bigint")).alias("symbol"), pe.alias("period_end")).agg(
        has(C("o_orderstatus") == "P").alias("pending"), has(C("o_orderpriority") == "4-NOT SPECIFIED").alias("other"),
        has(C("o_orderpriority") == "3-MEDIUM").alias("medium"), has(C("o_orderpriority") == "1-URGENT").alias("urgent"))
    c = read(spark, sf, "customer").select(
        F.format_string("C%012d", C("c_custkey").cast("bigint")).alias("symbol"), C("c_name").alias("company"),
        F.when(C("c_mktsegment") == "HOUSEHOLD", "Household Finance").otherwise(C("c_mktsegment")).alias("sector"))
    q = quarter_facts(spark, sf).withColumnRenamed("sales", "revenue")
    j = q.join(seen, ["symbol", "period_end"]).join(c, "symbol", "left")
    entry = lambda label, v: F.struct(F.lit(label).alias("label"), v.alias("value"))
    return j.select(
        "symbol", "period_end", "company", "sector", "revenue", "operating_profit", "net_profit", "eps",
        F.array(entry("Market Cap", F.format_string("%.2f", "revenue")),
                entry("Current stock p/e", F.when(C("net_profit") > 0, F.format_string("%.4f x", C("revenue") / C("net_profit"))))).alias("ratios"),
        F.concat_ws("; ", F.when(C("other"), "Other Income"), F.when(C("pending"), "Exceptional items"), F.when(C("medium"), "Limited review, emphasis of matter")).alias("text"),
        C("publication_date").cast("string").alias("document"), F.when(C("urgent"), C("publication_date").cast("string")).alias("document_hash"),
        F.when(C("eps") >= 2, F.array(F.when(C("pending"), "Needs OCR").otherwise("found"))).alias("facts"),
        F.when(C("operating_profit") > C("revenue") * 0.19, 1).alias("warnings"), F.when(C("interest") > C("revenue") * 0.049, 1).alias("errors"))


_GROWTH = "CASE WHEN {b} IS NULL OR {c} IS NULL OR {b} = 0 OR ({b} < 0 AND {c} >= 0) THEN NULL WHEN {b} < 0 THEN (abs({b}) - abs({c})) / abs({b}) ELSE {c} / {b} - 1 END"
_TEXT = """CASE WHEN {b} IS NULL OR {c} IS NULL THEN 'Unavailable' WHEN {b} = 0 THEN CASE WHEN {c} > 0 THEN 'Turnaround from zero base' WHEN {c} < 0 THEN 'Loss from zero base' ELSE 'No change from zero base' END WHEN {b} < 0 AND {c} >= 0 THEN 'Turnaround to profit'
 WHEN {b} < 0 THEN CASE WHEN abs({c}) < abs({b}) THEN printf('Loss reduced %+.1f%%', (abs({b}) - abs({c})) / abs({b}) * 100) ELSE printf('Loss increased %+.1f%%', abs((abs({b}) - abs({c})) / abs({b})) * 100) END ELSE printf('%+.1f%%', ({c} / {b} - 1) * 100) END"""
define_cte(
    "resrec",
    """SELECT q.symbol, q.period_end, c.company, c.sector, q.sales AS revenue, q.operating_profit, q.net_profit, q.eps, CASE WHEN q.net_profit > 0 THEN round(q.sales / q.net_profit, 4) END AS pe, s.*, q.publication_date IS NOT NULL AS doc, q.eps >= 2 AS facts,
  q.operating_profit > q.sales * 0.19::DOUBLE AS warned, q.interest > q.sales * 0.049::DOUBLE AS failed, row_number() OVER w AS pos, lag(q.sales) OVER w AS pr, lag(q.net_profit) OVER w AS pn, """
    + ", ".join(f"CASE WHEN row_number() OVER w >= 5 THEN lag(q.{m}, 4) OVER w WHEN row_number() OVER w >= 3 THEN first_value(q.{m}) OVER w END AS y{a}" for m, a in (("sales", "r"), ("net_profit", "n"), ("eps", "e"), ("operating_profit", "o")))
    + """ FROM qf q JOIN (SELECT printf('C%012d', o_custkey) AS sy, CAST(last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS DATE) AS pe_, bool_or(o_orderstatus = 'P') AS pending, bool_or(o_orderpriority = '4-NOT SPECIFIED') AS other, bool_or(o_orderpriority = '3-MEDIUM') AS medium, bool_or(o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1, 2) s ON s.sy = q.symbol AND s.pe_ = q.period_end
 LEFT JOIN (SELECT printf('C%012d', c_custkey) AS sy2, c_name AS company, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Household Finance' ELSE c_mktsegment END AS sector FROM customer) c ON c.sy2 = q.symbol WINDOW w AS (PARTITION BY q.symbol ORDER BY q.period_end)""",
    "qf",
)
define_cte(
    "resgrow",
    f"""SELECT *, {_GROWTH.format(c='revenue', b='yr')} AS ry, {_GROWTH.format(c='net_profit', b='yn')} AS py, operating_profit / nullif(revenue, 0) AS operating_margin, (operating_profit / nullif(revenue, 0) - yo / nullif(yr, 0)) * 10000 AS bps,
  contains(lower(coalesce(sector, '') || ' ' || coalesce(company, '')), 'financ') AS fin, CASE WHEN pe IS NULL THEN 'Insufficient data' WHEN pe <= 18 THEN 'Attractive' WHEN pe <= 35 THEN 'Reasonable' ELSE 'Expensive' END AS valuation,
  CAST(pending AS INTEGER) + CAST(other AS INTEGER) + CAST(medium AS INTEGER) AS n_notes, 2 + CASE WHEN doc AND urgent THEN 2 ELSE 0 END + CASE WHEN facts AND NOT pending THEN 2 ELSE 0 END - CASE WHEN warned THEN 2 ELSE 0 END - CASE WHEN failed THEN 2 ELSE 0 END AS ev FROM resrec""",
    "resrec",
)
define_cte(
    "resscore",
    """SELECT *, CASE WHEN ev >= 5 THEN 'High' WHEN ev >= 2 THEN 'Medium' ELSE 'Low' END AS confidence, CASE WHEN ry >= 0.12 THEN 18 WHEN ry < 0 THEN -10 ELSE 0 END + CASE WHEN py >= 0.15 THEN 22 WHEN py < 0 THEN -16 ELSE 0 END
  + CASE WHEN fin THEN 0 WHEN bps >= 100 THEN 14 WHEN bps <= -100 THEN -12 ELSE 0 END - least(15, 5 * n_notes) + CASE WHEN doc AND facts THEN 8 ELSE 0 END + CASE WHEN valuation IN ('Attractive', 'Reasonable') THEN 10 WHEN valuation = 'Expensive' THEN -8 ELSE 0 END AS raw FROM resgrow""",
    "resgrow",
)


@query(
    "symbol:s period_end:d revenue_yoy:s revenue_qoq:s net_profit_yoy:s net_profit_qoq:s eps_yoy:s operating_margin margin_change_bps:f4 valuation:s confidence:s score strength:s action:s shortlisted:b improved:s weakened:s risks:i unanswered:i",
    covers="RUL-4 SCA-10 SCA-19",
    sql=with_(
        "resscore",
        f"""SELECT *, least(greatest(raw, 0), 100) AS score, bps AS margin_change_bps, {_TEXT.format(c='revenue', b='yr')} AS revenue_yoy, {_TEXT.format(c='revenue', b='pr')} AS revenue_qoq, {_TEXT.format(c='net_profit', b='yn')} AS net_profit_yoy, {_TEXT.format(c='net_profit', b='pn')} AS net_profit_qoq, {_TEXT.format(c='eps', b='ye')} AS eps_yoy,
  CASE WHEN strength = 'Needs verification' THEN strength WHEN strength = 'Strong' AND valuation IN ('Attractive', 'Reasonable') THEN 'Research priority' WHEN strength = 'Strong' THEN 'Promising results — investment assessment incomplete' WHEN strength = 'Mixed' THEN 'Mixed — monitor' ELSE 'Weak results' END AS action,
  strength = 'Strong' AND valuation IN ('Attractive', 'Reasonable') AND n_risks = 0 AS shortlisted, n_risks AS risks,
  concat_ws(',', CASE WHEN ry >= 0.12 THEN 'revenue' END, CASE WHEN py >= 0.15 THEN 'profit' END, CASE WHEN NOT fin AND bps >= 100 THEN 'margin' END) AS improved, concat_ws(',', CASE WHEN ry < 0 THEN 'revenue' END, CASE WHEN py < 0 THEN 'profit' END, CASE WHEN NOT fin AND bps <= -100 THEN 'margin' END) AS weakened,
  CASE WHEN ry >= 0.12 OR ry < 0 THEN 0 ELSE 1 END + CASE WHEN py >= 0.15 OR py < 0 THEN 0 ELSE 1 END + CAST(fin AS INTEGER) + CASE WHEN valuation = 'Insufficient data' THEN 1 ELSE 0 END AS unanswered
 FROM (SELECT *, CASE WHEN confidence = 'Low' THEN 'Needs verification' WHEN raw >= 55 THEN 'Strong' WHEN raw >= 25 THEN 'Mixed' ELSE 'Weak' END AS strength, n_notes + CASE WHEN doc AND facts THEN 0 ELSE 1 END + CAST(warned AS INTEGER) + CAST(failed AS INTEGER) AS n_risks FROM resscore)""",
    ),
)
def quarterly_result_analysis(spark, sf):
    df = rs.analysed_results(result_records(spark, sf))
    return df.withColumns({"improved": F.array_join("improved", ","), "weakened": F.array_join("weakened", ","), "risks": F.size("risks"), "unanswered": F.size("unanswered")})
