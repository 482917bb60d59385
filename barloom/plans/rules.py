"""Queries over rule scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import scoring as sc
from barloom.operators import point_in_time as pit
from barloom.operators import rules as ru
from barloom.plans import shapes as sh
from barloom.plans.evaluation import scored
from barloom.plans.fundamentals import quarter_facts
from barloom.plans.registry import query
from barloom.plans.shapes import define_cte, with_
from barloom.plans.sqlkit import chg, lag, over, roll
from barloom.sources.tables import read

C = F.col


def _bandsql(v, e, g, f, p, higher=True):
    if not higher:
        return _bandsql(f"(-({v}))", -e, -g, -f, -p)
    return (f"CASE WHEN {v} >= {e} THEN 100 WHEN {v} >= {g} THEN 75 + 25.0 * ({v} - ({g})) / ({e - g}) WHEN {v} >= {f} THEN 50 + 25.0 * ({v} - ({f})) / ({g - f}) "
            f"WHEN {v} >= {p} THEN 25 + 25.0 * ({v} - ({p})) / ({f - p}) WHEN {v} IS NOT NULL THEN greatest(0, 25.0 * ({v} - ({p})) / ({f - p} + 1e-9)) END")


def companies(spark, sf):
    """Latest quarter of each customer as a company record; some fields stay unknown."""
    ev = pit.event_features(quarter_facts(spark, sf))
    keep = ["period_end", "sales", "net_profit", "operating_margin", "interest_coverage", "sales_growth_yoy", "net_profit_growth_yoy", "eps_growth_yoy", "k"]
    last = ev.groupBy("symbol").agg(F.max(F.struct(*keep)).alias("x")).select("symbol", "x.*")
    none = F.lit(None).cast("double")
    return last.select(
        "symbol", "period_end", (C("k") % 40).cast("double").alias("roe"), (C("k") % 25).cast("double").alias("roce"), (ru.ratio("net_profit", "sales") * 100).alias("net_margin"),
        (C("operating_margin") * 100).alias("operating_margin"), (C("sales_growth_yoy") * 100).alias("revenue_growth"), (C("eps_growth_yoy") * 100).alias("eps_growth"),
        (C("net_profit_growth_yoy") * 100).alias("profit_growth"), (C("k") % 30 / 10.0).alias("debt_to_equity"), none.alias("current_ratio"), "interest_coverage",
        (C("k") % 7 - 3).cast("double").alias("free_cash_flow"), (C("k") % 80).cast("double").alias("pe"), (C("k") % 14).cast("double").alias("pb"), none.alias("ev_to_ebitda"),
        (C("k") % 70).cast("double").alias("promoter_holding"), (C("k") % 61).cast("double").alias("promoter_pledge"), (C("k") % 20).cast("double").alias("fii_holding"), none.alias("dii_holding"))


def _mean(*xs):
    lst = ", ".join(xs)
    return f"round(coalesce(list_avg(list_filter([{lst}], lambda x: x IS NOT NULL)), 0) * 1.000000000001, 2)"


@query(
    "symbol:s profitability_score:f2 growth_score:f2 health_score:f2 valuation_score:f2 ownership_score:f2 overall_score:f2 confidence:f4 strengths:i warnings:i",
    covers="RUL-1 RUL-2 SCA-11 SCA-12",
    sql=with_(
        "evf",
        f"""SELECT *, profitability_score * 0.25 + growth_score * 0.2 + health_score * 0.25 + valuation_score * 0.2 + ownership_score * 0.1 AS overall_score FROM (
 SELECT symbol, {_mean(_bandsql('roe', 20, 15, 10, 0), _bandsql('roce', 20, 15, 10, 0), _bandsql('nm', 20, 12, 5, 0), _bandsql('om', 25, 15, 7, 0))} AS profitability_score,
  {_mean(_bandsql('g1', 20, 12, 5, 0), _bandsql('g2', 20, 12, 5, 0), _bandsql('g3', 20, 12, 5, 0))} AS growth_score,
  {_mean(_bandsql('de', 0.25, 0.5, 1.0, 2.0, False), _bandsql('ic', 8, 4, 2, 1), "CASE WHEN fcf >= 0 THEN 75.0 ELSE 25.0 END")} AS health_score,
  {_mean("CASE WHEN pe <= 0 THEN 0.0 WHEN pe <= 15 THEN 90 WHEN pe <= 25 THEN 75 WHEN pe <= 40 THEN 50 WHEN pe <= 60 THEN 25 ELSE 0 END", _bandsql('pb', 1, 3, 6, 12, False))} AS valuation_score,
  {_mean(_bandsql('ph', 50, 35, 20, 0), "CASE WHEN pl <= 5 THEN 100.0 WHEN pl <= 20 THEN 60 WHEN pl <= 50 THEN 25 ELSE 0 END", _bandsql('fii', 30, 15, 5, 0))} AS ownership_score,
  (3 + CAST(om IS NOT NULL AS INTEGER)) / 4 * 0.25 + (CAST(g1 IS NOT NULL AS INTEGER) + CAST(g2 IS NOT NULL AS INTEGER) + CAST(g3 IS NOT NULL AS INTEGER)) / 3 * 0.2 + (2 + CAST(ic IS NOT NULL AS INTEGER)) / 4 * 0.25 + 2 / 3 * 0.2 + 3 / 4 * 0.1 AS confidence,
  CAST(roe >= 20 AS INTEGER) + CAST(coalesce(g1 >= 20, FALSE) AS INTEGER) + CAST(de <= 0.25 AS INTEGER) + CAST(coalesce(ic >= 8, FALSE) AS INTEGER) AS strengths, CAST(de > 2 AS INTEGER) + CAST(coalesce(ic < 1, FALSE) AS INTEGER) + CAST(pl > 50 AS INTEGER) AS warnings
 FROM (SELECT symbol, CAST(k % 40 AS DOUBLE) AS roe, CAST(k % 25 AS DOUBLE) AS roce, net_profit / sales * 100 AS nm, operating_margin * 100 AS om, sales_growth_yoy * 100 AS g1, eps_growth_yoy * 100 AS g2, net_profit_growth_yoy * 100 AS g3, k % 30 / 10 AS de, interest_coverage AS ic,
  k % 7 - 3 AS fcf, CAST(k % 80 AS DOUBLE) AS pe, CAST(k % 14 AS DOUBLE) AS pb, CAST(k % 70 AS DOUBLE) AS ph, CAST(k % 61 AS DOUBLE) AS pl, CAST(k % 20 AS DOUBLE) AS fii FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) AS rn FROM evf) WHERE rn = 1))""",
    ),
)
def fundamental_scorecard(spark, sf):
    s = ru.scorecard(companies(spark, sf))
    return s.withColumns({"strengths": F.size("strengths"), "warnings": F.size("warnings")})


@query(
    "symbol:s period_end:d value note:s",
    covers="SCA-10 RUL-4",
    sql=with_("qf", "SELECT symbol, period_end, CASE WHEN b IS NULL OR b = 0 THEN NULL WHEN b < 0 AND c >= 0 THEN NULL WHEN b < 0 THEN (abs(b) - abs(c)) / abs(b) ELSE c / b - 1 END AS value, "
              "CASE WHEN b IS NULL THEN 'unavailable' WHEN b = 0 THEN 'zero_base' WHEN b < 0 AND c >= 0 THEN 'turnaround' WHEN b < 0 THEN 'loss_change' ELSE '' END AS note "
              "FROM (SELECT symbol, period_end, c, lag(c) OVER (PARTITION BY symbol ORDER BY period_end) AS b FROM (SELECT *, net_profit - interest * 2 AS c FROM qf))"),
)
def growth_with_notes(spark, sf):
    q = quarter_facts(spark, sf).withColumn("c", C("net_profit") - C("interest") * 2)
    s = ru.Series("symbol", "period_end")
    return q.withColumn("g", sc.growth(C("c"), s.lag("c"))).select("symbol", "period_end", "g.*")


def holdings(spark, sf):
    """Share of order value by customer segment per nation and quarter."""
    o, cu = read(spark, sf, "orders"), read(spark, sf, "customer")
    j = o.join(cu, o.o_custkey == cu.c_custkey)
    q = F.trunc(F.to_date("o_orderdate"), "quarter")
    seg = lambda *n: F.sum(F.when(C("c_mktsegment").isin(*n), C("o_totalprice")).otherwise(0.0)) / F.sum("o_totalprice") * 100
    return j.groupBy(C("c_nationkey").alias("symbol"), q.alias("period")).agg(
        seg("AUTOMOBILE").alias("fii"), seg("BUILDING").alias("dii"), seg("FURNITURE").alias("promoter"), seg("MACHINERY").alias("public"))


define_cte(
    "hold",
    "SELECT c_nationkey AS symbol, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, " + ", ".join(
        f"sum(CASE WHEN c_mktsegment = '{s}' THEN o_totalprice ELSE 0 END) / sum(o_totalprice) * 100 AS {n}"
        for n, s in (("fii", "AUTOMOBILE"), ("dii", "BUILDING"), ("promoter", "FURNITURE"), ("public", "MACHINERY"))
    ) + " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
)


@query(
    "symbol:i fii_latest institutional_score",
    covers="RUL-3 SCA-18",
    sql=with_(
        "hold",
        """SELECT symbol, f[-1] AS fii_latest, round(least(greatest(12 * CAST(f[-1] > f[-2] AS INTEGER) + 8 * CAST(f[-1] > f[-2] AND f[-2] > f[-3] AS INTEGER) + 12 * CAST(d[-1] > d[-2] AS INTEGER) + 8 * CAST(d[-1] > d[-2] AND d[-2] > d[-3] AS INTEGER) + 15 * CAST(b[-1] > b[-2] AS INTEGER)
  - 20 * CAST(b[-1] < b[-2] AND b[-2] < b[-3] AS INTEGER) + 10 * CAST(p[-1] >= p[-2] AS INTEGER) - 15 * CAST(p[-5] - p[-1] > 2 AS INTEGER) + 8 + 12 * CAST(b[-1] > b[-2] AND u[-1] < u[-2] AS INTEGER), 0), 100), 1) AS institutional_score
 FROM (SELECT symbol, list(fii ORDER BY period) AS f, list(dii ORDER BY period) AS d, list(fii + dii ORDER BY period) AS b, list(promoter ORDER BY period) AS p, list(public ORDER BY period) AS u FROM hold GROUP BY symbol)""",
    ),
)
def shareholding_scores(spark, sf):
    cols = ("fii", "dii", "promoter", "public")
    h = holdings(spark, sf).groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("period", *cols))).alias("a"))
    series = lambda c: F.transform("a", lambda x: x[c]).alias(c)
    h = h.select("symbol", *[series(c) for c in cols]).withColumn("pledge", F.transform("fii", lambda x: F.lit(0.0)))
    return ru.shareholding_score(h).withColumn("fii_latest", sc.latest(C("fii")))


@query(
    "symbol:i holder:s period:d change",
    covers="WIN-58",
    sql=with_("hold", "SELECT * FROM (SELECT symbol, holder, period, pct - lag(pct) OVER (PARTITION BY symbol, holder ORDER BY period) AS change FROM (SELECT * FROM hold) UNPIVOT (pct FOR holder IN (fii, dii, promoter, public))) WHERE abs(change) >= 10"),
)
def holding_changes(spark, sf):
    long = holdings(spark, sf).unpivot(["symbol", "period"], ["fii", "dii", "promoter", "public"], "holder", "pct")
    return ru.holding_changes(long, 10.0)


def material_prices(spark, sf):
    li, p = read(spark, sf, "lineitem"), read(spark, sf, "part")
    return li.join(p, li.l_partkey == p.p_partkey).groupBy(C("p_type").alias("material"), F.to_date("l_shipdate").alias("date")).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"))


define_cte("mat", "SELECT p_type AS material, CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
define_cte(
    "expo",
    """SELECT printf('S%012d', l_suppkey) AS symbol, p_type AS material, sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER (PARTITION BY l_suppkey) AS spend_pct, l_suppkey AS k FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_type""",
)


def exposures(spark, sf):
    li, p = read(spark, sf, "lineitem"), read(spark, sf, "part")
    spend = li.join(p, li.l_partkey == p.p_partkey).groupBy("l_suppkey", C("p_type").alias("material")).agg(F.sum("l_extendedprice").alias("v"))
    total = spend.groupBy("l_suppkey").agg(F.sum("v").alias("t"))
    k = C("l_suppkey")
    return spend.join(total, "l_suppkey").select(
        sh._symbol("l_suppkey").alias("symbol"), "material", (C("v") / C("t")).alias("spend_pct"),
        F.when(k % 3 == 0, "CONSUMER").when(k % 3 == 1, "PRODUCER").otherwise("INTEGRATED").alias("relationship"),
        (k % 5 / 10.0).alias("hedge_ratio"), F.when(k % 7 != 0, k % 4 / 10.0).alias("pass_through"), (k % 9 / 10.0).alias("import_dependency"),
        (k % 8 / 10.0).alias("supplier_concentration"), F.when(k % 2 == 0, 1.0).otherwise(0.55).alias("verification"),
        F.lit("1995-01-01").cast("date").alias("effective_from"), F.when(k % 11 == 0, F.lit("2000-01-01").cast("date")).alias("effective_to"))


@query(
    "symbol:s material:s margin_bps direction:s severity:f2 evidence:f2 priority:f2 alert_level:s",
    covers="RUL-5 JOIN-14 WIN-11 SCA-13",
    sql=with_(
        "mat expo",
        f"""SELECT *, round(severity * evidence / 100 * 1.000000000001, 2) AS priority, CASE WHEN pt IS NULL OR evidence < 70 THEN 'NONE' WHEN abs(margin_bps) >= 100 AND round(severity * evidence / 100, 2) >= 70 THEN 'CRITICAL' WHEN abs(margin_bps) >= 25 AND round(severity * evidence / 100, 2) >= 45 THEN 'MATERIAL' WHEN round(severity * evidence / 100, 2) >= 25 THEN 'WATCH' ELSE 'INFORMATIONAL' END AS alert_level FROM (
 SELECT *, CASE WHEN margin_bps IS NULL THEN 'INSUFFICIENT_DATA' WHEN abs(margin_bps) < 5 THEN 'MIXED' WHEN margin_bps > 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS direction,
  round(least(abs(pc) / 0.15, 1) * 25 + least(spend_pct / 0.25, 1) * 20 + least(k % 9 / 10 / 0.75, 1) * 15 + least(abs(coalesce(margin_bps, 0)) / 100, 1) * 25 + least(k % 8 / 10 / 0.75, 1) * 10 + least(v20 / 0.45, 1) * 5, 2) AS severity,
  round(CASE WHEN k % 2 = 0 THEN 1 ELSE 0.55 END * 35 + 25 + (5 + CAST(pt IS NOT NULL AS INTEGER)) / 6 * 25 + 12, 2) AS evidence FROM (
  SELECT *, CASE k % 3 WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END * least(spend_pct, 1) * pc * (1 - k % 5 / 10) * (1 - pt) * 10000 AS margin_bps FROM (SELECT e.*, m.pc, m.v20, CASE WHEN k % 7 <> 0 THEN k % 4 / 10 END AS pt FROM expo e JOIN m USING (material) WHERE k % 11 <> 0)))""",
        m=f"SELECT material, pc, v20 FROM (SELECT *, row_number() OVER (PARTITION BY material ORDER BY date DESC) AS rn, {roll('stddev_samp', 'r', 20, need=2, part='material')} * sqrt(252) AS v20 FROM (SELECT *, {chg('price', 30, 'material')} AS pc, {chg('price', 1, 'material')} AS r FROM mat)) WHERE rn = 1",
    ),
)
def material_margin_impact(spark, sf):
    as_of = F.lit("2001-11-05").cast("date")
    m = ru.active_mappings(exposures(spark, sf), as_of).join(ru.material_changes(material_prices(spark, sf)), "material")
    return ru.margin_impact(m.withColumn("price_change", C("change_30")), as_of)


@query("alert_level:s direction:s rows:i", covers="AGG-38")
def material_alert_overview(spark, sf):
    return material_margin_impact(spark, sf).groupBy("alert_level", "direction").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "material:s date:d price:f4 change_1m_pct change_3m_pct change_12m_pct",
    covers="AGG-37 SRC-11",
    sql=with_(
        "mat",
        "SELECT l.material, l.date, l.price, " + ", ".join(f"(l.price / p{k}.price - 1) * 100 AS change_{k}m_pct" for k in (1, 3, 12))
        + " FROM (SELECT material, max(date) AS date, arg_max(price, date) AS price FROM mm GROUP BY material) l " + " ".join(
            f"LEFT JOIN mm p{k} ON p{k}.material = l.material AND p{k}.date = last_day(l.date - INTERVAL {k} MONTH)" for k in (1, 3, 12)),
        mm="SELECT material, CAST(last_day(date) AS DATE) AS date, avg(price) AS price FROM mat GROUP BY 1, 2",
    ),
)
def material_month_changes(spark, sf):
    m = material_prices(spark, sf)
    return ru.calendar_month_changes(m.groupBy("material", F.last_day("date").alias("date")).agg(F.avg("price").alias("price")))


@query("symbol:s date:d technical_state:s stop_loss:f4 target_1:f4 quantity:i sizing_status:s", covers="RUL-7 SCA-23")
def technical_setups(spark, sf):
    return ru.position_size(ru.technical_setups(sh.bars(spark, sf)), 1_000_000.0)


@query("symbol:s date:d right:s score:i underlying_stop:f4 underlying_target:f4 watch_reason:s ema20_direction:s", covers="RUL-11 RUL-13 WIN-57 SCA-16")
def option_directions(spark, sf):
    return ru.option_direction(ru.indicator_snapshot(*sh.stored_bars(spark, sf)))


@query("symbol:s expiry:d strike:f4 right:s reward_risk:f4 lots:i", covers="RUL-12 TOP-9 SCA-15")
def best_option_contracts(spark, sf):
    d = ru.option_direction(ru.indicator_snapshot(*sh.stored_bars(spark, sf)))
    last = d.groupBy("symbol").agg(F.max(F.struct("date", "close", "underlying_stop", "underlying_target", "right")).alias("x")).select("symbol", "x.*")
    li = read(spark, sf, "lineitem")
    k = C("l_orderkey")
    chain = li.select(
        sh._symbol("l_suppkey").alias("symbol"), F.when(k % 2 == 0, "CALL").otherwise("PUT").alias("right"),
        F.date_add(F.lit("2001-11-05").cast("date"), (k % 60).cast("int")).alias("expiry"), (C("l_extendedprice") / C("l_quantity")).alias("strike"),
        (C("l_quantity") * 2.0).alias("bid"), (C("l_quantity") * (2.0 + C("l_discount") * 0.2)).alias("ask"), (0.3 + k % 50 / 100.0).alias("delta"),
        C("l_tax").alias("theta"), (k % 100).cast("double").alias("iv_percentile"), C("l_quantity").alias("volume"), C("l_partkey").cast("double").alias("open_interest"), F.lit(10.0).alias("lot_size"))
    return ru.best_contract(ru.option_contracts(chain, last, F.lit("2001-11-05").cast("date"), 1e8))


_RULES = {"primary_min": 0.97, "binary_min": 0.80, "sell_min": 0.90, "accumulate_primary": 0.80, "accumulate_binary": 0.50, "tuned_min": 0.5}


@query(
    "date:d symbol:s recommendation:s confidence:s tuned_status:s",
    covers="RUL-14 TOP-7",
    sql=with_(
        "pp",
        """SELECT *, CASE WHEN buy AND pb >= 0.9 THEN 'HIGH' WHEN buy THEN 'MEDIUM' ELSE 'LOW' END AS confidence, CASE WHEN buy AND pb >= 0.9 THEN 'CONFIRMED' WHEN buy THEN 'NOT_CONFIRMED' WHEN pa >= 0.97 AND pb >= 0.9 THEN 'RESEARCH_ONLY_TUNED_SIGNAL' ELSE 'NO_TUNED_CONFIRMATION' END AS tuned_status,
  CASE WHEN buy THEN 'BUY' WHEN pa <= CAST(1 AS DOUBLE) - CAST(0.9 AS DOUBLE) AND pb <= CAST(1 AS DOUBLE) - CAST(0.9 AS DOUBLE) THEN 'SELL' WHEN pa >= 0.8 AND pb >= 0.5 THEN 'ACCUMULATE' ELSE 'WATCH' END AS recommendation FROM (SELECT *, pa >= 0.97 AND pb >= 0.8 AS buy FROM pp)""",
    ),
)
def signal_recommendations(spark, sf):
    return ru.signal_rules(scored(spark, sf).withColumn("pc", C("pb")), _RULES | {"tuned_min": 0.9})


@query(
    "symbol:s decision:s confidence weighted_score positive_stack:i vetoes:i",
    covers="RUL-10",
    sql=with_(
        "uni",
        """SELECT *, CASE WHEN vetoes > 0 THEN 'REJECT' WHEN tech < -0.25 AND ps >= 2 THEN 'WATCH' WHEN (risk < -0.25 OR sec < -0.25) AND ps >= 2 THEN 'WATCH' WHEN ps >= 3 AND risk > -0.25 THEN 'BUY' WHEN bear >= 3 THEN 'EXIT' ELSE 'WATCH' END AS decision,
  CASE WHEN vetoes > 0 THEN least(0.9, 0.55 + 0.08 * vetoes) WHEN tech < -0.25 AND ps >= 2 THEN 0.55 WHEN (risk < -0.25 OR sec < -0.25) AND ps >= 2 THEN 0.5 WHEN ps >= 3 AND risk > -0.25 THEN least(0.85, cf) WHEN bear >= 3 THEN least(0.8, cf) ELSE least(0.65, cf) END AS confidence, ps AS positive_stack FROM (
 SELECT symbol, count_if(veto) AS vetoes, sum(score * conf) / sum(conf) AS weighted_score, count_if(category <> 'risk' AND score > 0.25) AS ps, max(score) FILTER (category = 'risk') AS risk, max(score) FILTER (category = 'sector') AS sec, max(score) FILTER (category = 'technical') AS tech, count_if(score < -0.25) AS bear,
  least(greatest(avg(conf) * (0.65 + 0.35 * abs(sum(CASE WHEN score > 0.25 THEN 1 WHEN score < -0.25 THEN -1 ELSE 0 END)) / count(*)), 0), 1) AS cf FROM (
  SELECT symbol, category, (k * m % 21 - 10) / 10 AS score, 0.3 + k * m % 7 / 10 AS conf, category = 'risk' AND k % 13 = 0 AS veto FROM (SELECT symbol, CAST(substr(symbol, 2) AS BIGINT) AS k FROM uni), (VALUES ('fundamentals', 3), ('valuation', 5), ('technical', 7), ('sector', 11), ('risk', 13)) c(category, m)) GROUP BY symbol)""",
    ),
)
def consensus_decisions(spark, sf):
    u = sh.universe(spark, sf).select("symbol", F.substring("symbol", 2, 20).cast("bigint").alias("k"))
    cats = F.array(*[F.struct(F.lit(n).alias("category"), F.lit(m).alias("m")) for n, m in (("fundamentals", 3), ("valuation", 5), ("technical", 7), ("sector", 11), ("risk", 13))])
    x = u.select("symbol", "k", F.explode(cats).alias("c")).select("symbol", "k", "c.*")
    km = C("k") * C("m")
    s = x.select("symbol", "category", ((km % 21 - 10) / 10).alias("score"), (0.3 + km % 7 / 10).alias("confidence"), ((C("category") == "risk") & (C("k") % 13 == 0)).alias("veto"))
    return ru.consensus(s)


@query(
    "isin:s reason_codes:s eligible:b",
    covers="FIL-13 JOIN-12 SRC-15",
    sql="SELECT 'INE' || k AS isin, concat_ws(',', CASE WHEN n AND b THEN NULL ELSE 'NOT_DUAL_LISTED' END, CASE WHEN n AND b AND k % 9 = 0 THEN 'STALE_REFERENCE_DATA' END, CASE WHEN n AND b AND k % 8 = 0 THEN 'NOT_DUAL_LISTED' END, CASE WHEN n AND b AND k % 10 = 0 THEN 'SURVEILLANCE_RESTRICTED' END, CASE WHEN n AND b AND k % 4 = 0 THEN 'FO_STOCK_EXCLUDED' END) AS reason_codes, "
        "n AND b AND k % 9 <> 0 AND k % 8 <> 0 AND k % 10 <> 0 AND k % 4 <> 0 AS eligible FROM (SELECT s_suppkey AS k, s_suppkey % 3 <> 0 AS n, s_suppkey % 5 <> 0 AS b FROM supplier) WHERE n OR b",
)
def dual_listing_gates(spark, sf):
    s = read(spark, sf, "supplier")
    k = C("s_suppkey")
    d = F.lit("2001-11-05").cast("date")
    base = s.select(F.concat(F.lit("INE"), k).alias("isin"), k.alias("k"), C("s_name").alias("symbol"), (k % 8 != 0).alias("active"), F.lit("EQ").alias("series"),
                    (k % 10 == 0).alias("surveillance"), F.when(k % 9 == 0, F.date_sub(d, 9)).otherwise(d).alias("as_of"))
    out = ru.dual_listing(base.where(C("k") % 3 != 0), base.where(C("k") % 5 != 0), base.where(C("k") % 4 == 0), d)
    return out.withColumn("reason_codes", F.array_join("reason_codes", ","))


@query("l_partkey:i companies:i", covers="JOIN-16", sql="SELECT l_partkey, count(DISTINCT l_suppkey) AS companies FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def shared_holders(spark, sf):
    return ru.shared_holders(read(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


@query(
    "symbol:s period_end:d sales:f4",
    covers="TOP-6",
    sql=with_("qf", "SELECT symbol, period_end, sales FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) AS rn FROM qf) WHERE rn = 1"),
)
def latest_company_records(spark, sf):
    return pit.latest_known(quarter_facts(spark, sf), F.lit("2999-01-01").cast("date"), "period_end")


# Terms of the finance post classifier.
MARKET_TERMS = (
    "nifty", "banknifty", "bank nifty", "sensex", "stock", "stocks", "market", "equity", "gold", "silver", "crude", "oil", "bitcoin", "btc",
    "crypto", "commodity", "bullish", "bearish", "rally", "correction", "support", "resistance", "breakout", "breakdown", "index", "futures",
    "options", "dow", "nasdaq", "s&p",
)
UP_TERMS = ("bullish", "rally", "rise", "upside", "positive", "breakout", "higher", "buy", "strength", "strong", "upmove", "gain")
DOWN_TERMS = ("bearish", "fall", "correction", "downside", "negative", "breakdown", "lower", "sell", "weakness", "weak", "decline", "drop")


@query(
    "doc_id:i market_terms:s stance:s",
    covers="SCA-9",
    sql="SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(t, '{w}') THEN '{w}' END" for w in sorted(MARKET_TERMS)) + "], lambda x: x IS NOT NULL), ', ') AS market_terms, "
        "CASE WHEN u > d THEN 'Bullish' WHEN d > u THEN 'Bearish' ELSE 'Neutral / unclear' END AS stance FROM (SELECT doc_id, t, " + " + ".join(f"CAST(contains(t, '{w}') AS INTEGER)" for w in UP_TERMS) + " AS u, "
        + " + ".join(f"CAST(contains(t, '{w}') AS INTEGER)" for w in DOWN_TERMS) + " AS d FROM (SELECT doc_id, lower(text) AS t FROM documents))",
)
def document_keyword_labels(spark, sf):
    d = ru.keyword_labels(read(spark, sf, "documents"), "text", {"market": MARKET_TERMS}, UP_TERMS, DOWN_TERMS)
    return d.withColumn("market_terms", F.array_join("market_terms", ", "))


_BODIES = ("click", "error", "purchase", "signup", "view")


def positions(spark, sf):
    ev = read(spark, sf, "events")
    return ev.groupBy(F.to_date("ts").alias("date"), C("event_type").alias("body")).agg(
        F.pmod(F.sum(F.round(C("value") * 100).cast("bigint")) / 7.0, F.lit(360.0)).alias("longitude"))


define_cte("posn", "SELECT CAST(ts AS DATE) AS date, event_type AS body, fmod(sum(CAST(round(value * 100) AS BIGINT)) / 7.0, 360.0) AS longitude FROM events GROUP BY 1, 2")


@query(
    "date:d body_a:s body_b:s separation aspect distance",
    covers="JOIN-15 SCA-21",
    sql=with_("posn", "SELECT *, abs(separation - aspect) AS distance FROM (SELECT a.date, a.body AS body_a, b.body AS body_b, abs(fmod(fmod(b.longitude - a.longitude + 180, 360) + 360, 360) - 180) AS separation, unnest([0.0, 60.0, 90.0, 120.0, 180.0]) AS aspect FROM posn a JOIN posn b ON a.date = b.date AND a.body < b.body)"),
)
def aspect_distances(spark, sf):
    p = positions(spark, sf)
    return ru.aspect_distances(p, _BODIES, (0, 60, 90, 120, 180))


@query(
    "date:d body:s retrograde:b ingress:b",
    covers="SCA-21 RUL-27",
    sql=with_("posn", "SELECT date, body, fmod(fmod(longitude - p + 180, 360) + 360, 360) - 180 < 0 AS retrograde, floor(p / 30) <> floor(longitude / 30) AS ingress FROM (SELECT *, lag(longitude) OVER (PARTITION BY body ORDER BY date) AS p FROM posn)"),
)
def motion_features(spark, sf):
    return ru.motion_features(positions(spark, sf))


@query(
    "symbol:s date:d state:s",
    covers="SCA-17",
    sql=with_("bars", f"SELECT symbol, date, CASE WHEN p > 0 AND o > 0 THEN 'LONG_BUILDUP' WHEN p > 0 AND o < 0 THEN 'SHORT_COVERING' WHEN p < 0 AND o > 0 THEN 'SHORT_BUILDUP' WHEN p < 0 AND o < 0 THEN 'LONG_UNWINDING' ELSE 'UNKNOWN' END AS state FROM (SELECT symbol, date, close - {lag('close')} AS p, volume - {lag('volume')} AS o FROM bars)"),
)
def futures_interest_states(spark, sf):
    return sh.bars(spark, sf).withColumn("state", sc.oi_state(ru.S.diff("close"), ru.S.diff("volume"))).select("symbol", "date", "state")
