"""Queries that join several operators: matrices, comparisons, screens, alerts, sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.functions import scoring as sc
from barloom.functions.rolling import Series
from barloom.operators import evaluation as ev
from barloom.operators import features as ft
from barloom.operators import learning as ln
from barloom.operators import screens as sn
from barloom.operators import signals as sg
from barloom.plans import evaluation as pe
from barloom.plans import features as _features  # noqa: F401  defines shared SQL blocks
from barloom.plans import rules as pr
from barloom.plans import shapes as sh
from barloom.plans.registry import query
from barloom.plans.shapes import define_cte, with_
from barloom.plans.sqlkit import chg, lag, over, roll
from barloom.sources import readers as rd
from barloom.sources.tables import read
from barloom.sources.staging import stage, staging_root
from barloom.streaming import jobs

C = F.col


@query(
    "symbol:s date:d ret_20d volatility_20d score pa y:i",
    covers="JOIN-19",
    sql=with_("pp feat", "SELECT p.symbol, p.date, f.ret_20d, f.volatility_20d, p.score, p.pa, p.y FROM pp p JOIN feat f ON f.symbol = p.symbol AND f.date = p.date"),
)
def technical_and_scores_matrix(spark, sf):
    f = ft.add_volatility(ft.add_returns(sh.bars(spark, sf))).select("symbol", "date", "ret_20d", "volatility_20d")
    return pe.scored(spark, sf).join(f, ["symbol", "date"])


@query(
    "model:s " + pe._MOUT,
    covers="JOIN-21",
    sql=with_("pp", f"SELECT 'a' AS model, {pe._M} FROM pp WHERE pa >= 0.9 UNION ALL SELECT 'b', {pe._M} FROM pp WHERE pb >= 0.9"),
)
def matched_scope_comparison(spark, sf):
    df = pe.scored(spark, sf)
    keys = df.where(C("pa").isNotNull() & C("pb").isNotNull()).select("date", "symbol")
    scope = df.join(keys, ["date", "symbol"], "left_semi")
    return ev.selection_metrics(ev.tag(scope, {"a": C("pa") >= 0.9, "b": C("pb") >= 0.9}, "model"), ["model"])


@query(
    "material:s date:d adjusted",
    covers="SCA-14",
    sql=with_("mat", f"SELECT material, date, (1 + ({chg('price', 30, 'material')})) * (1 + day(date) / 1000) - 1 AS adjusted FROM mat"),
)
def currency_adjusted_returns(spark, sf):
    s = ft.Series("material", "date")
    p = pr.material_prices(spark, sf)
    return p.withColumn("adjusted", sc.inr_return(s.change("price", 30), F.dayofmonth("date") / 1000.0))


@query(
    "rule:s signals:i precision",
    covers="RUL-28",
    sql=with_("pp", f"SELECT rule, count(*) AS signals, avg(y) AS precision FROM ({pe._GRIDSQL}) GROUP BY rule ORDER BY round(avg(y), 9) DESC, signals DESC LIMIT 1"),
)
def champion_rule(spark, sf):
    m = ev.tag(pe.scored(spark, sf), pe.grid_rules()).groupBy("rule").agg(
        F.count(F.lit(1)).alias("signals"), F.round(F.avg(C("y").cast("double")), 9).alias("precision"))
    return ln.champion(m, ["precision", "signals"])


@query(
    "symbol:s date:d score",
    covers="UDF-1 WIN-37",
    sql=with_("bars", f"SELECT symbol, date, {lag('close', 21)} / nullif({lag('close', 126)}, 0) - 1 AS score FROM bars"),
)
def registered_signal_scores(spark, sf):
    return sg.apply_signal(sh.bars(spark, sf), "momentum_6_1")


@query(
    "symbol:s date:d bias:s",
    covers="RUL-8",
)
def technical_bias(spark, sf):
    b = sh.bars(spark, sf)
    df = ft.add_trend(b, ft.S, (20, 50))
    df = ft.add_adx(ft.add_atr(ft.add_rsi(df), ft.S, (14,)))
    return sn.technical_bias(df.join(ft.recursive_features(b).select("symbol", "date", "macd", "macd_signal"), ["symbol", "date"]))


@query(
    "symbol:s trend_score volume_score relative_score:f2",
    covers="RUL-9 RUL-22",
    sql=with_(
        "bars bench",
        """SELECT symbol, CASE WHEN n < 30 THEN 0 ELSE least(greatest(CASE WHEN c1 > m20 THEN 1.5 ELSE -1.0 END + CASE WHEN m20 > m50 THEN 1.0 ELSE -0.8 END + least(greatest((c1 / c0 - 1) * 5, -1.0), 1.5) + 1.5, 0), 3.5) END AS trend_score,
  CASE WHEN n < 30 THEN 0.5 WHEN v10 >= v30 THEN 1.5 ELSE 0.8 END AS volume_score, CASE WHEN n < 30 THEN 0.8 WHEN c1 / c0 > (SELECT arg_max(close, date) / arg_min(close, date) FROM bench) THEN 1.5 ELSE 0.6 END AS relative_score
 FROM (SELECT symbol, count(*) AS n, arg_min(close, date) AS c0, arg_max(close, date) AS c1, avg(close) FILTER (rv <= 20) AS m20, avg(close) FILTER (rv <= 50) AS m50, avg(volume) FILTER (rv <= 10) AS v10, avg(volume) FILTER (rv <= 30) AS v30
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rv FROM bars) GROUP BY symbol)""",
    ),
)
def buying_screen_scores(spark, sf):
    return sn.buying_scores(sh.bars(spark, sf), sh.benchmark(spark, sf))


def supplier_profiles(spark, sf):
    """Sales and earnings (the discount) of a supplier's last year against the year before, its balance and returns."""
    y, x = F.year("l_shipdate"), C("l_extendedprice")
    li = read(spark, sf, "lineitem").where(C("l_quantity") > 0)
    years = li.groupBy(C("l_suppkey"), y.alias("y")).agg(
        F.sum(x).alias("rev"), F.sum(x * C("l_discount")).alias("earn"), F.count(F.lit(1)).alias("analysts"),
        F.avg(F.when(C("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("returned"))
    s = Series("l_suppkey", "y")
    years = years.withColumns({"revenue_growth": s.change("rev"), "earnings_growth": s.change("earn")})
    cols = ["y", "rev", "earn", "analysts", "returned", "revenue_growth", "earnings_growth"]
    last = years.groupBy("l_suppkey").agg(F.max_by(F.struct(*cols), "y").alias("r")).select(C("l_suppkey").alias("s_suppkey"), "r.*")
    j = sh.universe(spark, sf).join(last.select(F.format_string("S%012d", C("s_suppkey").cast("bigint")).alias("symbol"), *cols), "symbol")
    up = F.when(C("balance") > 0, C("balance"))
    return j.select(
        "symbol", "sector", "revenue_growth", "earnings_growth", (C("earn") / (up * 100)).alias("roe"), (C("earn") / F.nullif(C("rev"), F.lit(0.0)) * 2).alias("margin"),
        (C("rev") / up).alias("debt_to_equity"), C("balance").alias("cash_flow"), (C("rev") / F.nullif(C("earn"), F.lit(0.0))).alias("pe"), (C("rev") / (up * 100)).alias("pb"),
        F.lit(None).cast("double").alias("ev_to_ebitda"), "analysts", (C("returned") * 20).alias("governance_risk"))


define_cte(
    "prof",
    """SELECT symbol, sector, rg, eg, earn / (up * 100) AS roe, earn / nullif(rev, 0) * 2 AS margin, rev / up AS dte, balance AS cf, rev / nullif(earn, 0) AS pe, rev / (up * 100) AS pb, analysts, returned * 20 AS gov FROM (
 SELECT u.*, CASE WHEN balance > 0 THEN balance END AS up, y.* EXCLUDE (sy) FROM uni u JOIN (SELECT printf('S%012d', l_suppkey) AS sy, y, rev, earn, analysts, returned, rev / nullif(lag(rev) OVER w, 0) - 1 AS rg, earn / nullif(lag(earn) OVER w, 0) - 1 AS eg, row_number() OVER (PARTITION BY l_suppkey ORDER BY y DESC) AS k
  FROM (SELECT l_suppkey, year(l_shipdate) AS y, sum(l_extendedprice) AS rev, sum(l_extendedprice * l_discount) AS earn, count(*) AS analysts, avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END) AS returned FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_suppkey ORDER BY y)) y ON y.sy = u.symbol WHERE k = 1)""",
    "uni",
)
_N = "* 1.000000000001::DOUBLE, 2)"
_BUYSTAT = """SELECT symbol, count(*) AS n, max(date) AS last, arg_min(close, date) AS c0, arg_max(close, date) AS c1, avg(close) FILTER (rv <= 20) AS m20, avg(close) FILTER (rv <= 50) AS m50, avg(volume) FILTER (rv <= 10) AS v10, avg(volume) FILTER (rv <= 30) AS v30,
  avg(volume) FILTER (rv <= 20) AS v20, min(low) FILTER (rv <= 20) AS lo, coalesce(stddev_pop(r), 0) AS vol, avg(d) FILTER (rv <= 14 AND d >= 0) AS gain, avg(-d) FILTER (rv <= 14 AND d < 0) AS loss
 FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rv, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS r, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS d FROM {}) GROUP BY symbol"""
_TREND = "CASE WHEN n < 30 THEN 0 ELSE least(greatest(CASE WHEN c1 > m20 THEN 1.5 ELSE -1.0 END::DOUBLE + CASE WHEN m20 > m50 THEN 1.0 ELSE -0.8 END::DOUBLE + least(greatest((c1 / c0 - 1) * 5, -1.0), 1.5) + 1.5::DOUBLE, 0), 3.5) END"
define_cte("bstat", _BUYSTAT.format("bars"), "bars")
define_cte("mstat", _BUYSTAT.format("(SELECT 'market' AS symbol, * FROM bench)"), "bench")
define_cte(
    "buya",
    f"""SELECT b.*, p.* EXCLUDE (symbol), m.c1 / m.c0 AS mg, 4.5::DOUBLE + m.trend AS macro_raw, m.last AS fin, {_TREND.replace('n <', 'b.n <').replace('c1', 'b.c1').replace('c0', 'b.c0').replace('m20', 'b.m20').replace('m50', 'b.m50')} AS trend, CASE WHEN b.n < 30 THEN 0.5 WHEN b.v10 >= b.v30 THEN 1.5 ELSE 0.8 END::DOUBLE AS volsc,
  CASE WHEN b.n < 30 THEN 0.8 WHEN b.c1 / b.c0 > m.c1 / m.c0 THEN 1.5 ELSE 0.6 END::DOUBLE AS rel, CASE WHEN b.n < 15 THEN NULL WHEN coalesce(b.loss, 0) = 0 THEN 100 ELSE 100 - 100 / (1 + coalesce(b.gain, 0) / b.loss) END AS rsi,
  least(greatest(0.45::DOUBLE + CASE WHEN roe IS NULL THEN 0 WHEN roe > 0.15 THEN 0.2 ELSE -0.1 END::DOUBLE + CASE WHEN margin IS NULL THEN 0 WHEN margin > 0.1 THEN 0.15 ELSE -0.1 END::DOUBLE + CASE WHEN dte IS NULL THEN 0 WHEN dte < 100 THEN 0.1 ELSE -0.2 END::DOUBLE + CASE WHEN cf IS NULL THEN 0 WHEN cf > 0 THEN 0.1 ELSE -0.25 END::DOUBLE, 0), 1) AS quality,
  coalesce(least(greatest(0.5::DOUBLE + list_avg(list_filter([rg, eg], lambda g: g IS NOT NULL)), 0), 1), 0.45::DOUBLE) AS growth, least(greatest(5 + CASE WHEN pe IS NULL THEN 0 WHEN pe > 0 AND pe <= 25 THEN 1.0 ELSE -1.5 END::DOUBLE + CASE WHEN pb IS NULL THEN 0 WHEN pb > 0 AND pb <= 4 THEN 0.8 ELSE -0.8 END::DOUBLE, 0), 10) AS val,
  CAST(coalesce(gov >= 8, FALSE) AS INTEGER) + CAST(coalesce(cf <= 0, FALSE) AS INTEGER) + CAST(coalesce(dte > 200, FALSE) AS INTEGER) AS reds
 FROM bstat b LEFT JOIN prof p ON p.symbol = b.symbol CROSS JOIN (SELECT *, {_TREND} AS trend FROM mstat) m""",
    "bstat mstat prof",
)
define_cte(
    "buyb",
    f"""SELECT *, round(least(greatest(macro_raw, 0), 10) {_N} AS macro, CASE WHEN coalesce(sector, 'Unknown') = 'Unknown' THEN 5.0 ELSE 6.0 END::DOUBLE AS sector_score, round(least(greatest(2.5::DOUBLE + trend + volsc + rel + CASE WHEN rsi IS NULL THEN 0 WHEN rsi BETWEEN 45 AND 70 THEN 1.0 ELSE -0.5 END::DOUBLE, 0), 10) {_N} AS technical,
  round(quality * 10 {_N} AS fundamentals, round(val {_N} AS valuation, CASE WHEN analysts >= 10 THEN 5.8 ELSE 5.0 END::DOUBLE AS sentiment, round(least(7::DOUBLE - CASE WHEN vol > 0.045 THEN 1.5 ELSE 0 END::DOUBLE, CASE WHEN reds > 0 THEN 3 ELSE 10 END) {_N} AS risk,
  round(least(greatest((growth * 0.2::DOUBLE + quality * 0.25::DOUBLE + trend / 3.5::DOUBLE * 0.2::DOUBLE + volsc / 1.5::DOUBLE * 0.15::DOUBLE + rel / 1.5::DOUBLE * 0.2::DOUBLE) * 100, 0), 100) {_N} AS screen_score, round(least(c1 * 0.93::DOUBLE, lo * 0.99::DOUBLE) {_N} AS stop_loss FROM buya""",
    "buya",
)


@query(
    "symbol:s macro sector_score technical fundamentals valuation sentiment risk score screen_score stop_loss:f2 target_1:f2 reward_risk:f2 action:s allocation:s passed:b rejections:i red_flags:i",
    covers="RUL-9 RUL-22",
    sql=with_(
        "buyb",
        f"""SELECT *, reds AS red_flags, rejections = 0 AS passed, CASE WHEN n >= 30 THEN CASE WHEN score >= 82 THEN 'BUY' WHEN score >= 70 THEN 'ACCUMULATE' WHEN score >= 55 THEN 'WATCH' ELSE 'AVOID' END END AS action,
  CASE WHEN score >= 85 AND risk >= 7 AND reward_risk >= 3 THEN 'Up to 8% of portfolio' WHEN score >= 75 AND risk >= 6 THEN 'Up to 5% of portfolio' ELSE 'Up to 3% of portfolio' END AS allocation FROM (
 SELECT *, round(greatest(target_1 - c1, 0) / greatest(c1 - stop_loss, 0.01::DOUBLE) {_N} AS reward_risk, CAST(n < 30 AS INTEGER) + CAST(v20 < 25 AS INTEGER) + CAST(date_diff('day', last, fin) > 10 AS INTEGER) + CAST(screen_score < 55 AS INTEGER) + reds AS rejections FROM (
 SELECT *, round((c1 + (c1 - stop_loss) * 2) {_N} AS target_1, round((macro * 10 * 0.1::DOUBLE + sector_score * 10 * 0.15::DOUBLE + technical * 10 * 0.2::DOUBLE + fundamentals * 10 * 0.25::DOUBLE + valuation * 10 * 0.15::DOUBLE + sentiment * 10 * 0.05::DOUBLE + risk * 10 * 0.1::DOUBLE) {_N} AS score FROM buyb))""",
    ),
)
def buying_recommendations(spark, sf):
    b = stage(sh.bars(spark, sf), "bars")
    bench = b.groupBy("date").agg(*[F.avg(c).alias(c) for c in ("open", "high", "low", "close")], F.sum("volume").alias("volume"))
    r = sn.buying_composite(b, bench, supplier_profiles(spark, sf), min_volume=25.0)
    return r.withColumns({"rejections": F.size("rejections"), "red_flags": F.size("red_flags")})


@query("symbol:s date:d vetoes:i reason_codes:s", covers="RUL-21")
def risk_vetoes(spark, sf):
    from barloom.operators import rules as ru

    return sn.risk_vetoes(ru.technical_setups(sh.bars(spark, sf))).withColumns(
        {"vetoes": F.size("vetoes"), "reason_codes": F.array_join("reason_codes", ",")})


@query(
    "event_id:i user_id:i alert:s",
    covers="ST-5",
    sql="SELECT event_id, user_id, 'large ' || event_type AS alert FROM events WHERE value >= 50 AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')",
)
def streamed_alerts(spark, sf):
    """Large ticks of users that ever bought, written per micro-batch by ``foreachBatch``."""
    root = f"{staging_root(spark)}/alerts-{uuid.uuid4().hex}"
    ticks = jobs.stream_table(spark, sf, "events").withColumnRenamed("user_id", "symbol")
    watch = read(spark, sf, "events").where(C("event_type") == "purchase").select(C("user_id").alias("symbol")).distinct()
    rules = lambda b: b.where(C("value") >= 50).select("event_id", C("symbol").alias("user_id"), F.concat(F.lit("large "), C("event_type")).alias("alert"))
    q = ticks.writeStream.foreachBatch(jobs.alert_batches(rules, watch, f"{root}/out")).option(
        "checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("event_id bigint, user_id bigint, alert string, batch int").parquet(f"{root}/out")


@query(
    "symbol:s date:d close:f8",
    covers="SRC-13 SRC-2",
    sql=with_("bars", "SELECT symbol, date, close FROM bars WHERE date BETWEEN DATE '1998-03-01' AND DATE '1999-02-15'"),
)
def partitioned_bar_store(spark, sf):
    path = f"{staging_root(spark)}/bars-{uuid.uuid4().hex}"
    rd.write_bars(sh.bars(spark, sf), path)
    return rd.read_bars(spark, path, start="1998-03-01", end="1999-02-15")
