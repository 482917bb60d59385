"""Queries for the sector rotation report."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import rotation as ro
from barloom.plans import shapes as sh
from barloom.plans.registry import query
from barloom.plans.shapes import define_cte, with_
from barloom.plans.sqlkit import chg, flag, lag, roll, rsi

C = F.col

define_cte(
    "rstk",
    f"""SELECT *, {rsi('ag', 'al')} AS rsi14 FROM (SELECT *, {roll('avg', 'gain', 14)} AS ag, {roll('avg', 'loss', 14)} AS al FROM (
 SELECT *, CASE WHEN delta IS NOT NULL THEN greatest(delta, 0) END AS gain, CASE WHEN delta IS NOT NULL THEN greatest(-delta, 0) END AS loss FROM (
 SELECT *, {chg('close')} AS r1, close - {lag('close')} AS delta, {", ".join(f"{roll('avg', 'close', n)} AS sma{n}" for n in (20, 50, 200))},
  first_value(close) OVER (PARTITION BY symbol ORDER BY date) AS fc, count(*) OVER (PARTITION BY symbol) AS nn FROM sbars) WHERE nn >= 240))""",
    "sbars",
)


def _z(fn, n, x="c"):
    return roll(fn, x, n, part="sector")


define_cte(
    "rsec",
    f"""SELECT i.*, br.* EXCLUDE (date, sector), b.close AS bench_close, b.r20 AS bench_ret_20d, b.r60 AS bench_ret_60d FROM (
  SELECT *, {_z('stddev_samp', 20, 'r')} AS sector_volatility_20d FROM (SELECT *, {chg('c', 20, 'sector')} AS sr20, {chg('c', 60, 'sector')} AS sr60, {chg('c', 1, 'sector')} AS r,
   {", ".join(f"{_z('avg', n)} AS ss{n}" for n in (20, 50, 200))} FROM (
   SELECT date, sector, avg(close / fc * 100) AS c, sum(volume) AS sector_volume FROM rstk
   WHERE sector IN (SELECT sector FROM rstk GROUP BY sector HAVING count(DISTINCT symbol) >= 2) GROUP BY date, sector))) i
 LEFT JOIN (SELECT *, breadth50 - lag(breadth50, 10) OVER w AS breadth_change_10d, up_volume_ratio - lag(up_volume_ratio, 10) OVER w AS volume_improvement FROM (
  SELECT date, sector, count(*) AS constituent_count, avg({flag('close > sma20')}) * 100 AS breadth20, avg({flag('close > sma50')}) * 100 AS breadth50,
   avg({flag('close > sma200')}) * 100 AS breadth200, avg({flag('rsi14 > 50')}) * 100 AS rsi_above_50_fraction,
   sum(CASE WHEN r1 > 0 THEN volume ELSE 0 END) / nullif(sum(CASE WHEN r1 <> 0 THEN volume ELSE 0 END), 0) AS up_volume_ratio
  FROM rstk GROUP BY date, sector) WINDOW w AS (PARTITION BY sector ORDER BY date)) br USING (date, sector)
 JOIN (SELECT date, close, {chg('close', 20, '')} AS r20, {chg('close', 60, '')} AS r60 FROM bench) b USING (date)""",
    "rstk bench",
)
define_cte(
    "rsec2",
    f"""SELECT *, excess_return_20d - lag(excess_return_20d, 10) OVER w AS rs_acceleration, rs_ratio / lag(rs_ratio, 20) OVER w - 1 AS rs_slope,
  {flag('c > ss50')} * 35 + {flag('c > ss20 AND ss20 > ss50 AND ss50 > ss200')} * 45 + {flag('ss200 - lag(ss200, 20) OVER w > 0')} * 20 AS trend_score,
  coalesce(c > ss50, FALSE) AS above50, coalesce(c > ss20 AND ss20 > ss50 AND ss50 > ss200, FALSE) AS stack
 FROM (SELECT *, sr20 - bench_ret_20d AS excess_return_20d, sr60 - bench_ret_60d AS excess_return_60d, c / bench_close AS rs_ratio FROM rsec)
 WINDOW w AS (PARTITION BY sector ORDER BY date)""",
    "rsec",
)


def _pct(x):
    return (
        f"CASE WHEN {x} IS NULL THEN 0.5 ELSE (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + "
        f"(count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY date) END"
    )


define_cte(
    "rsec3",
    f"""SELECT *, rank() OVER (PARTITION BY date ORDER BY leadership_score DESC) AS sector_rank FROM (
 SELECT *, round((pe20 * 45 + pe60 * 35 + psl * 20) * 0.35 + (pb20 * 25 + pb50 * 50 + pb200 * 25) * 0.30 + trend_score * 0.15 + pv * 100 * 0.10 + (100 - pvol * 100) * 0.10, 9) AS leadership_score
 FROM (SELECT *, {_pct('excess_return_20d')} AS pe20, {_pct('excess_return_60d')} AS pe60, {_pct('rs_slope')} AS psl, {_pct('breadth20')} AS pb20, {_pct('breadth50')} AS pb50,
  {_pct('breadth200')} AS pb200, {_pct('up_volume_ratio')} AS pv, {_pct('sector_volatility_20d')} AS pvol, {_pct('rs_acceleration')} AS pacc, {_pct('breadth_change_10d')} AS pbc, {_pct('volume_improvement')} AS pvi FROM rsec2))""",
    "rsec2",
)
define_cte(
    "rsec4",
    f"""SELECT *, round(pacc * 100 * 0.40 + pbc * 100 * 0.25 + {_pct('rank_velocity')} * 100 * 0.20 + pvi * 100 * 0.15, 9) AS rotation_score FROM (
 SELECT *, {", ".join(f"lag(sector_rank, {k}) OVER w - sector_rank AS rank_change_{k}d" for k in (5, 10, 20))}, lag(sector_rank, 10) OVER w - sector_rank AS rank_velocity
 FROM rsec3 WINDOW w AS (PARTITION BY sector ORDER BY date))""",
    "rsec3",
)
define_cte(
    "rreg",
    f"""SELECT date, market_breadth50, CASE WHEN close > s50 AND s50 > s200 AND market_breadth50 >= 55 THEN 'RISK_ON'
  WHEN coalesce(close < s200, FALSE) OR coalesce(market_breadth50 <= 35, FALSE) THEN 'RISK_OFF' ELSE 'NEUTRAL' END AS market_regime
 FROM (SELECT date, close, {roll('avg', 'close', 50, part='')} AS s50, {roll('avg', 'close', 200, part='')} AS s200 FROM bench)
 LEFT JOIN (SELECT date, avg({flag('close > sma50')}) * 100 AS market_breadth50 FROM rstk GROUP BY date) USING (date)""",
    "bench rstk",
)
_neg = "coalesce({} < 0, FALSE)"
define_cte(
    "rsec5",
    f"""SELECT *, CASE WHEN em AND persistence_count >= 3 THEN 'EMERGING_ROTATION'
  WHEN leadership_score >= 70 AND rotation_score >= 55 AND excess_return_20d > 0 AND excess_return_60d > 0 AND breadth50 >= 60 AND stack THEN 'CONFIRMED_LEADER'
  WHEN rotation_score <= 30 AND {_neg.format('rs_acceleration')} AND {_neg.format('breadth_change_10d')} AND {_neg.format('rank_velocity')} AND NOT above50 THEN 'LAGGING_ROTATION_OUT'
  WHEN leadership_score >= 60 AND (rotation_score < 40 OR {_neg.format('rs_acceleration')} OR {_neg.format('breadth_change_10d')} OR {_neg.format('rank_velocity')}) THEN 'WEAKENING'
  ELSE 'NEUTRAL' END AS rotation_state FROM (
 SELECT *, sum(CAST(em AS INTEGER)) OVER (PARTITION BY sector ORDER BY date ROWS 4 PRECEDING) AS persistence_count FROM (
  SELECT r.*, g.market_breadth50, g.market_regime, coalesce(leadership_score >= 55 AND rotation_score >= 70 AND excess_return_20d > 0 AND rs_acceleration > 0 AND breadth50 >= 55
   AND breadth_change_10d > 5 AND rank_velocity >= 3 AND above50, FALSE) AS em FROM rsec4 r LEFT JOIN rreg g USING (date)))""",
    "rsec4 rreg",
)


def _bd(x):
    return f"(CASE WHEN ({x}) IS NULL THEN 100 ELSE least(greatest({x}, 0), 100) END)"


_cnt = "(CAST(coalesce(rank_change_5d {0} 0, FALSE) AS INTEGER) + CAST(coalesce(rank_change_10d {0} 0, FALSE) AS INTEGER) + CAST(coalesce(rank_change_20d {0} 0, FALSE) AS INTEGER))"
_tot = "(coalesce(rank_change_5d, 0) + coalesce(rank_change_10d, 0) + coalesce(rank_change_20d, 0))"
define_cte(
    "rfinal",
    f"""SELECT *, CASE WHEN rotation_state IN ('EMERGING_ROTATION', 'CONFIRMED_LEADER') AND priority_score >= 55 THEN '⭐ HUNT' WHEN rotation_state = 'WEAKENING' THEN '⚠️ CAUTION'
  WHEN rotation_state = 'LAGGING_ROTATION_OUT' THEN '❌ AVOID' WHEN priority_score >= 45 THEN '👀 WATCH' ELSE '⚠️ CAUTION' END AS action_label,
  CASE WHEN {_tot} >= 8 AND {_cnt.format('>')} >= 2 THEN '🚀 STRONG IMPROVEMENT' WHEN {_tot} >= 2 AND {_cnt.format('>')} >= 2 THEN '↑ IMPROVING'
  WHEN {_tot} <= -8 AND {_cnt.format('<')} >= 2 THEN '🔻 STRONG DETERIORATION' WHEN {_tot} <= -2 AND {_cnt.format('<')} >= 2 THEN '↓ WEAKENING' ELSE '→ STABLE' END AS rank_trend_label
 FROM (SELECT *, pv * 100 AS volume_score, round({_bd("(rotation_score * 0.30 + leadership_score * 0.20 + " + _bd('rs_acceleration * 1000 + 50') + " * 0.15 + " + _bd('breadth_change_10d * 2 + 50') + " * 0.12 + " + _bd('rank_change_20d * 5 + 50') + " * 0.12 + " + _bd('persistence_count / 5.0 * 100') + " * 0.06 + pv * 100 * 0.05) * CASE market_regime WHEN 'RISK_ON' THEN 1.05 WHEN 'RISK_OFF' THEN 0.82 ELSE 1.0 END")}, 9) AS priority_score FROM rsec5)""",
    "rsec5",
)


def _history(spark, sf):
    return ro.rotation_history(sh.sector_bars(spark, sf), sh.benchmark(spark, sf))


@query(
    "date:d sector:s excess_return_20d excess_return_60d rs_slope rs_acceleration trend_score breadth20 breadth50 breadth200 "
    "rsi_above_50_fraction up_volume_ratio breadth_change_10d volume_improvement constituent_count:i",
    covers="AGG-1 AGG-2 WIN-24 WIN-25",
    sql=with_("rsec2", "SELECT * FROM rsec2"),
)
def sector_rotation_inputs(spark, sf):
    return _history(spark, sf)


@query(
    "date:d sector:s leadership_score rotation_score sector_rank:i rank_change_5d:i rank_change_20d:i rank_velocity:i volume_score "
    "market_breadth50 market_regime:s persistence_count:i rotation_state:s priority_score rank_trend_label:s action_label:s",
    covers="WIN-26 WIN-27 WIN-28 WIN-29 WIN-30 WIN-31",
    sql=with_("rfinal", "SELECT * FROM rfinal"),
)
def sector_rotation_history(spark, sf):
    return _history(spark, sf)


@query(
    "priority:i sector:s priority_score action_label:s stock_selection_priority:b",
    covers="WIN-31",
    sql=with_(
        "rfinal",
        "SELECT *, row_number() OVER (ORDER BY priority_score DESC, sector) AS priority, rotation_state IN ('EMERGING_ROTATION', 'CONFIRMED_LEADER') AS stock_selection_priority "
        "FROM rfinal WHERE date = (SELECT max(date) FROM rfinal)",
    ),
)
def sector_rotation_latest(spark, sf):
    return ro.latest_report(_history(spark, sf))


@query(
    "sector:s symbol:s date:d rs_20d rs_60d rs_momentum_20d rs_change momentum_change contribution_score direction:s rank:i",
    covers="WIN-32",
    sql=with_(
        "sbars bench",
        f"""SELECT *, rank() OVER (PARTITION BY sector ORDER BY abs(contribution_score) DESC) AS rank, CASE WHEN contribution_score >= 0 THEN 'Positive' ELSE 'Negative' END AS direction FROM (
  SELECT *, coalesce(rs_20d, 0) * 0.6 + coalesce(rs_change, 0) * 0.4 AS contribution_score FROM (SELECT *, rs_20d - {lag('rs_20d', 10)} AS rs_change FROM x) y
  WHERE date = (SELECT max(date) FROM x z WHERE z.sector = y.sector) AND rs_20d IS NOT NULL)""",
        x=f"""SELECT symbol, sector, date, r20 - b20 AS rs_20d, r60 - b60 AS rs_60d, {chg('rat', 20)} AS rs_momentum_20d, r20 - {lag('r20', 10)} AS momentum_change FROM (
  SELECT s.*, {chg('close', 20)} AS r20, {chg('close', 60)} AS r60, close / bc AS rat FROM (SELECT sbars.*, b.bc, b.b20, b.b60 FROM sbars JOIN (
   SELECT date, close AS bc, {chg('close', 20, '')} AS b20, {chg('close', 60, '')} AS b60 FROM bench) b USING (date)) s)""",
    ),
)
def sector_stock_contributions(spark, sf):
    return ro.stock_contributions(sh.sector_bars(spark, sf), sh.benchmark(spark, sf))
