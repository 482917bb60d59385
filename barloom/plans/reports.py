"""Queries for the breadth, EMA and strength reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import breadth as br
from barloom.operators import ema_screens as es
from barloom.operators import strength as st
from barloom.plans import shapes as sh
from barloom.plans.registry import query
from barloom.plans.shapes import define_cte, with_
from barloom.plans.sqlkit import chg, lag, over, roll
from barloom.sources.staging import stage

C = F.col


def nation_weeks(spark, sf):
    """Dense weekly bars per nation (symbol) with its region as sector."""
    from barloom.sources.tables import read

    li = read(spark, sf, "lineitem").where(C("l_quantity") > 0)
    s = read(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    n = read(spark, sf, "nation")
    return (
        li.join(s, li.l_suppkey == s.s_suppkey).join(n, C("s_nationkey") == C("n_nationkey"))
        .groupBy(C("n_name").alias("symbol"), F.date_trunc("week", "l_shipdate").cast("date").alias("date"))
        .agg(*sh.bar_aggs("week"))
    )


def nation_universe(spark, sf):
    from barloom.sources.tables import read

    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        C("n_name").alias("symbol"), C("n_name").alias("company"), C("r_name").alias("sector")
    )


def flat_bench(bars):
    return bars.groupBy("date").agg(F.avg("close").alias("close"))


define_cte(
    "nbars",
    f"""SELECT n_name AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,{sh._AGGS}
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
 WHERE l_quantity > 0 GROUP BY ALL""",
)
define_cte("nuni", "SELECT n_name AS symbol, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey")
define_cte(
    "ncal",
    "SELECT date, row_number() OVER (ORDER BY date) AS session FROM (SELECT DISTINCT date FROM nbars)",
    "nbars",
)


def _rng(fn, x, n, end=0):
    a = n - 1 - end
    f = f"(PARTITION BY symbol ORDER BY session RANGE BETWEEN {a} PRECEDING AND {-end} PRECEDING)"
    return f"CASE WHEN count({x}) OVER {f} = {n} THEN {fn}({x}) OVER {f} END"


_one = "(PARTITION BY symbol ORDER BY session RANGE BETWEEN {0} PRECEDING AND {0} PRECEDING)"
define_cte(
    "bpanel",
    f"""SELECT *, CAST(coalesce(r > 1e-10, FALSE) AS INTEGER) AS advance, CAST(coalesce(r < -1e-10, FALSE) AS INTEGER) AS decline,
  CAST(coalesce(abs(r) <= 1e-10, FALSE) AS INTEGER) AS unch, CASE WHEN r > 1e-10 THEN volume ELSE 0 END AS av,
  CASE WHEN r < -1e-10 THEN volume ELSE 0 END AS dv, CASE WHEN n21 = 21 THEN CAST(close > l20 AS DOUBLE) END AS pos20,
  CAST(high >= ph AS DOUBLE) AS nh, CAST(low <= pl AS DOUBLE) AS nl,
  CAST(close > s20 AS DOUBLE) AS a20, CAST(close > s50 AS DOUBLE) AS a50, CAST(close > s200 AS DOUBLE) AS a200
 FROM (SELECT *, close / (max(close) OVER {_one.format(1)}) - 1 AS r, max(close) OVER {_one.format(20)} AS l20,
  count(close) OVER (PARTITION BY symbol ORDER BY session RANGE BETWEEN 20 PRECEDING AND CURRENT ROW) AS n21,
  {_rng('max', 'high', 252, -1)} AS ph, {_rng('min', 'low', 252, -1)} AS pl,
  {", ".join(f"{_rng('avg', 'close', n)} AS s{n}" for n in (20, 50, 200))}
 FROM nbars JOIN ncal USING (date) JOIN nuni USING (symbol))""",
    "nbars ncal nuni",
)
_BR = """count(*) AS observed, count(*) AS eligible, sum(advance) AS advancers, sum(decline) AS decliners, sum(unch) AS unchanged,
  count(r) AS ad_eligible, sum(av) AS advancing_volume, sum(dv) AS declining_volume,
  count(a20) AS sma20_eligible, avg(a20) * 100 AS above_sma20_pct, count(a50) AS sma50_eligible, avg(a50) * 100 AS above_sma50_pct,
  count(a200) AS sma200_eligible, avg(a200) * 100 AS above_sma200_pct, count(pos20) AS positive_20d_eligible,
  sum(pos20) AS positive_20d_count, count(nh) AS new_high_eligible, sum(nh) AS new_high_count, count(nl) AS new_low_eligible,
  sum(nl) AS new_low_count, avg(pos20) * 100 AS positive_20d_pct, sum(advance) / nullif(count(r), 0) * 100 AS advancing_pct,
  sum(advance) / nullif(sum(decline), 0) AS ad_ratio, sum(advance) - sum(decline) AS net_advances,
  sum(av) / nullif(sum(av) + sum(dv), 0) * 100 AS up_volume_pct"""
define_cte(
    "btime",
    f"""SELECT *, ad_eligible / requested >= 0.6 AS reliable, eligible / requested * 100 AS coverage_pct FROM (
  SELECT date, (SELECT count(*) FROM nuni) AS requested, {_BR} FROM bpanel GROUP BY date)""",
    "bpanel nuni",
)
_BOUT = (
    "observed:i eligible:i advancers:i decliners:i unchanged:i ad_eligible:i advancing_volume declining_volume "
    "sma20_eligible:i above_sma20_pct sma50_eligible:i above_sma50_pct sma200_eligible:i above_sma200_pct "
    "positive_20d_eligible:i positive_20d_count:i new_high_eligible:i new_high_count:i new_low_eligible:i "
    "new_low_count:i positive_20d_pct advancing_pct ad_ratio net_advances:i up_volume_pct coverage_pct"
)


def _levels(spark, sf):
    bars = nation_weeks(spark, sf)
    return br.breadth_levels(br.breadth_panel(bars, flat_bench(bars)), nation_universe(spark, sf))


@query(
    "date:d " + _BOUT + " reliable:b ad_line:i breadth50_change_5d breadth50_change_10d breadth50_change_20d",
    covers="AGG-4 AGG-5 WIN-35 WIN-36 JOIN-7",
    sql=with_(
        "btime",
        """SELECT *, CASE WHEN reliable THEN sum(CASE WHEN reliable THEN net_advances END) OVER (PARTITION BY island ORDER BY date) END AS ad_line,
  above_sma50_pct - lag(above_sma50_pct, 5) OVER (ORDER BY date) AS breadth50_change_5d,
  above_sma50_pct - lag(above_sma50_pct, 10) OVER (ORDER BY date) AS breadth50_change_10d,
  above_sma50_pct - lag(above_sma50_pct, 20) OVER (ORDER BY date) AS breadth50_change_20d
 FROM (SELECT *, sum(CAST(NOT reliable AS INTEGER)) OVER (ORDER BY date) AS island FROM btime)""",
    ),
)
def breadth_timeline(spark, sf):
    return br.breadth_timeline(_levels(spark, sf))


@query(
    "date:d sector:s requested:i " + _BOUT + " breadth50_change_10d",
    covers="AGG-4 AGG-5",
    sql=with_(
        "bpanel nuni",
        f"""SELECT *, eligible / requested * 100 AS coverage_pct, above_sma50_pct - lag(above_sma50_pct, 10) OVER (PARTITION BY sector ORDER BY date) AS breadth50_change_10d
 FROM (SELECT date, sector, {_BR} FROM bpanel GROUP BY date, sector) JOIN (SELECT sector, count(*) AS requested FROM nuni GROUP BY sector) USING (sector)""",
    ),
)
def sector_breadth_timeline(spark, sf):
    return br.sector_breadth(_levels(spark, sf))


@query(
    "symbol:s sector:s tradable:b daily_return status:s last_date:d excluded_rows:i missing_sessions:i",
    covers="AGG-5 JOIN-13",
    sql=with_(
        "bars uni",
        """SELECT u.symbol, u.sector, CASE WHEN l.symbol IS NOT NULL THEN TRUE END AS tradable, l.r AS daily_return,
  CASE WHEN l.symbol IS NOT NULL THEN 'PASS' WHEN s.last_date IS NULL THEN 'MISSING' ELSE 'REVIEW' END AS status,
  s.last_date, s.x AS excluded_rows, (SELECT max(session) FROM cal) - s.f + 1 - s.n AS missing_sessions
 FROM uni u LEFT JOIN (SELECT symbol, max(date) AS last_date, 0 AS x, count(*) AS n, min(session) AS f FROM p GROUP BY symbol) s USING (symbol)
 LEFT JOIN (SELECT symbol, close / pc - 1 AS r FROM p WHERE session = (SELECT max(session) FROM cal)) l ON l.symbol = u.symbol""",
        cal="SELECT date, row_number() OVER (ORDER BY date) AS session FROM (SELECT DISTINCT date FROM bars)",
        p=f"SELECT symbol, date, session, close, max(close) OVER {_one.format(1)} AS pc FROM bars JOIN cal USING (date)",
    ),
)
def breadth_symbol_status(spark, sf):
    bars = sh.bars(spark, sf)
    bench = flat_bench(bars)
    return br.symbol_status(br.breadth_panel(bars, bench), sh.universe(spark, sf), bench)


define_cte(
    "emar",
    """SELECT symbol, date, session, close, run, row_number() OVER (PARTITION BY symbol, run ORDER BY session) AS rn FROM (
  SELECT b.symbol, b.date, session, close, session - row_number() OVER (PARTITION BY symbol ORDER BY session) AS run FROM nbars b JOIN ncal USING (date))""",
    "nbars ncal",
)
define_cte(
    "emax",
    """/*recursive*/ SELECT symbol, run, rn, date, session, close, close AS e20, close AS e50, close AS e200 FROM emar WHERE rn = 1
 UNION ALL SELECT b.symbol, b.run, b.rn, b.date, b.session, b.close, e.e20 + (b.close - e.e20) * 2.0 / 21,
  e.e50 + (b.close - e.e50) * 2.0 / 51, e.e200 + (b.close - e.e200) * 2.0 / 201
 FROM emax e JOIN emar b ON b.symbol = e.symbol AND b.run = e.run AND b.rn = e.rn + 1""",
    "emar",
)
sh._CTES["emax"] = (sh._CTES["emax"][0].replace("emax AS MATERIALIZED", "emax AS"), ("emar",))
_pr = "OVER (PARTITION BY symbol, run ORDER BY session)"
define_cte(
    "emao0",
    f"""SELECT symbol, run, date, session, close, {", ".join(f"CASE WHEN rn >= {n} THEN e{n} END AS ema{n}" for n in (20, 50, 200))} FROM emax""",
    "emax",
)
define_cte(
    "emao",
    "SELECT *, " + ", ".join(
        f"max(CASE WHEN pc {a}= p{n} AND close {b} ema{n} THEN date END) {_pr} AS ema{n}_{d}_date, "
        f"session - max(CASE WHEN pc {a}= p{n} AND close {b} ema{n} THEN session END) {_pr} AS ema{n}_{d}_age, "
        f"(close / ema{n} - 1) * 100 AS ema{n}_distance_pct_{d}"
        for n in (20, 50, 200) for d, a, b in (("up", "<", ">"), ("down", ">", "<"))
    ) + f""" FROM (SELECT *, lag(close) {_pr} AS pc, {", ".join(f"lag(ema{n}) {_pr} AS p{n}" for n in (20, 50, 200))} FROM emao0)""",
    "emao0",
)


def _ema(spark, sf):
    bars = nation_weeks(spark, sf)
    return es.ema_observations(br.breadth_panel(bars, flat_bench(bars)))


@query(
    "symbol:s date:d ema20:f4 ema50:f4 ema200:f4 ema200_distance_pct ema20_up_date:d ema20_up_age:i "
    "ema50_down_date:d ema50_down_age:i ema200_up_age:i",
    covers="WIN-33",
    sql=with_("emao", "SELECT *, ema200_distance_pct_up AS ema200_distance_pct FROM emao"),
)
def ema_distance_and_crosses(spark, sf):
    return _ema(spark, sf)


@query(
    "symbol:s direction:s crossed:s sessions_since:i cross_date:d position:s",
    covers="WIN-34 FIL-9",
    sql=with_(
        "emao",
        """SELECT symbol, direction, concat_ws(', ', CASE WHEN h20 THEN 'EMA20' END, CASE WHEN h50 THEN 'EMA50' END, CASE WHEN h200 THEN 'EMA200' END) AS crossed,
  least(CASE WHEN h20 THEN g20 END, CASE WHEN h50 THEN g50 END, CASE WHEN h200 THEN g200 END) AS sessions_since,
  greatest(CASE WHEN h20 THEN d20 END, CASE WHEN h50 THEN d50 END, CASE WHEN h200 THEN d200 END) AS cross_date,
  CASE WHEN abs(dist) <= 25 + 1e-10 THEN CASE WHEN dist > 1e-10 THEN 'Above EMA200' WHEN dist < -1e-10 THEN 'Below EMA200' ELSE 'At EMA200' END END AS position
 FROM (""" + " UNION ALL ".join(
            f"""SELECT symbol, 'Crossed {w}' AS direction, ema200_distance_pct_up AS dist, {", ".join(
                f"coalesce(ema{n}_{d}_age >= 0 AND ema{n}_{d}_age < 10 AND close {op} ema{n}, FALSE) AS h{n}, ema{n}_{d}_age AS g{n}, ema{n}_{d}_date AS d{n}"
                for n in (20, 50, 200))} FROM emao WHERE date = (SELECT max(date) FROM emao)"""
            for d, w, op in (("up", "above", ">"), ("down", "below", "<"))
        ) + ") WHERE h20 OR h50 OR h200",
    ),
)
def ema_crossing_screen(spark, sf):
    obs = _ema(spark, sf)
    latest = obs.join(obs.agg(F.max("date").alias("date")), "date", "left_semi")
    near = es.near_ema200(latest, 25.0).select("symbol", "position")
    return es.ema_crossings(latest, direction="Both", within=10).join(near, "symbol", "left")


_cr = (63, 126, 189, 252)
define_cte(
    "srec0",
    f"""SELECT b.*, row_number() OVER (PARTITION BY symbol ORDER BY date) AS history, {chg('close')} AS ret_1d, {chg('close', 21)} AS ret_1m,
  {", ".join(f"{chg('close', n)} AS ret_{n}" for n in _cr)}, {", ".join(f"{roll('avg', 'close', n)} AS sma{n}" for n in (20, 50, 150, 200))},
  {roll('max', 'high', 20, -1)} AS pvt, {roll('max', 'high', 252)} AS high52, {roll('min', 'low', 252)} AS low52,
  volume / nullif({roll('avg', 'volume', 20)}, 0) AS volume_ratio, CASE WHEN close < {lag('close')} THEN volume END AS dv,
  close / bclose AS rat FROM (SELECT bars.*, bench.close AS bclose FROM bars LEFT JOIN bench USING (date)) b""",
    "bars bench",
)
define_cte(
    "srec",
    f"""SELECT *, 0.4 * ret_63 + 0.2 * ret_126 + 0.2 * ret_189 + 0.2 * ret_252 AS rs_composite FROM (
 SELECT *, {lag('sma200', 20)} AS p200, {roll('max', 'dv', 10, -1)} AS mdv, max(rat) OVER {over(252, -1)} AS rprior, count(rat) OVER {over(253)} AS rn_ FROM srec0)
 WHERE history >= 253""",
    "srec0",
)
define_cte(
    "asofd",
    """SELECT max(date) AS as_of FROM (SELECT date, count(*) AS c FROM (
  SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rv, count(*) OVER (PARTITION BY symbol) AS n FROM bars)
  WHERE rv <= 10 AND n >= 253 GROUP BY date) WHERE c >= greatest(1, ceil(0.6 * (SELECT count(*) FROM (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) >= 253))))""",
    "bars",
)
define_cte(
    "srated",
    """SELECT *, least(greatest(round_even(((rank() OVER (PARTITION BY date ORDER BY rs_composite) + (count(*) OVER (PARTITION BY date, rs_composite) - 1) / 2.0)
   / count(*) OVER (PARTITION BY date)) * 98 + 1, 0), 1), 99) AS rs_rating,
  CASE WHEN close > sma50 AND sma50 > sma150 AND sma150 > sma200 AND sma200 > p200 THEN 'Stage 2'
   WHEN close < sma50 AND sma50 < sma150 AND sma150 < sma200 AND sma200 < p200 THEN 'Stage 4'
   WHEN close >= sma200 AND sma50 >= sma200 THEN 'Stage 1' ELSE 'Stage 3' END AS stage
 FROM srec JOIN (SELECT date, back FROM (SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS back FROM bench WHERE date <= (SELECT as_of FROM asofd)) WHERE back IN (0, 5, 20)) USING (date)
 WHERE rs_composite IS NOT NULL""",
    "srec asofd bench",
)
define_cte(
    "snap",
    """SELECT s.*, u.sector, r5, stage5, s.rs_rating - r5 AS rs_change_5d, s.rs_rating - r20 AS rs_change_20d,
  close > sma50 AND sma50 > sma150 AND sma150 > sma200 AND coalesce(sma200 > p200, FALSE) AND close >= high52 * 0.75 AND close >= low52 * 1.25 AS trend_template,
  close / high52 - 1 AS distance_52w_high, close / low52 - 1 AS distance_52w_low, close / pvt - 1 AS distance_to_pivot,
  coalesce(close > pvt AND volume_ratio >= 1.5, FALSE) AS breakout, coalesce(close / pvt - 1 BETWEEN -0.03 AND 0, FALSE) AS near_breakout,
  coalesce(ret_1d > 0 AND close > sma50 AND volume > mdv, FALSE) AS pocket_pivot, coalesce(rn_ >= 127 AND rat >= rprior, FALSE) AS rs_line_new_high,
  CAST(close > sma150 AND close > sma200 AS INTEGER) + CAST(sma150 > sma200 AS INTEGER) + CAST(coalesce(sma200 > p200, FALSE) AS INTEGER)
  + CAST(sma50 > sma150 AND sma50 > sma200 AS INTEGER) + CAST(close > sma50 AS INTEGER) + CAST(close >= low52 * 1.3 AS INTEGER)
  + CAST(close >= high52 * 0.75 AS INTEGER) + CAST(s.rs_rating >= 70 AS INTEGER) AS trend_checks
 FROM srated s LEFT JOIN (SELECT symbol, max(CASE WHEN back = 5 THEN rs_rating END) AS r5, max(CASE WHEN back = 5 THEN stage END) AS stage5,
  max(CASE WHEN back = 20 THEN rs_rating END) AS r20 FROM srated WHERE back > 0 GROUP BY symbol) p USING (symbol)
 LEFT JOIN uni u USING (symbol) WHERE back = 0""",
    "srated uni",
)


def snapshot(spark, sf, stored=None):
    bars, bench = stored or sh.stored_bars(spark, sf)
    return st.strength_snapshot(bars, bench, sh.universe(spark, sf))


@query(
    "symbol:s date:d sector:s rs_composite rs_rating rs_change_5d rs_change_20d stage:s trend_template:b trend_checks:i "
    "distance_52w_high distance_52w_low distance_to_pivot volume_ratio breakout:b near_breakout:b pocket_pivot:b rs_line_new_high:b",
    covers="WIN-47 WIN-48 WIN-49 FIL-7",
    sql=with_("snap", "SELECT * FROM snap"),
)
def strength_snapshot(spark, sf):
    return snapshot(spark, sf)


_SURGE = "(volume_ratio >= 1.5 AND ret_1d > 0)"
_SCANS = {
    "RS Leaders": "rs_rating >= 90",
    "Stage 2 Leaders": "stage = 'Stage 2' AND rs_rating >= 70",
    "Trend Template Leaders": "trend_template",
    "Just Entered Stage 2": "stage = 'Stage 2' AND coalesce(stage5, '') <> 'Stage 2'",
    "RS Line New Highs": "rs_line_new_high",
    "Near 52-Week High": "distance_52w_high >= -0.05",
    "Near Breakout": "near_breakout",
    "Confirmed Breakout": "breakout",
    "Pocket Pivot": "pocket_pivot",
    "Volume Surge": _SURGE,
    "Strong in Weak Market": "rs_rating >= 85 AND ret_1m > 0",
    "Laggards": "rs_rating <= 20 AND stage = 'Stage 4'",
}


@query(
    "scan:s symbol:s rs_rating rs_composite",
    covers="FIL-8",
    sql=with_("snap", " UNION ALL ".join(
        f"SELECT '{n}' AS scan, symbol, rs_rating, rs_composite FROM snap WHERE {c}" for n, c in _SCANS.items())),
)
def ready_scans(spark, sf):
    return st.all_scans(snapshot(spark, sf))


@query(
    "symbol:s setup:s rs_rating volume_ratio",
    covers="TOP-4",
    sql=with_(
        "snap",
        f"""SELECT *, concat_ws(' · ', CASE WHEN breakout THEN 'Confirmed breakout' END, CASE WHEN near_breakout THEN 'Near breakout' END,
  CASE WHEN pocket_pivot THEN 'Pocket pivot' END, CASE WHEN {_SURGE} THEN 'Volume surge' END) AS setup FROM snap
 WHERE breakout OR near_breakout OR pocket_pivot OR {_SURGE}""",
    ),
)
def breakout_candidates(spark, sf):
    return st.breakout_candidates(snapshot(spark, sf))


@query(
    "eligible_stocks:i above_sma20_pct above_sma50_pct above_sma200_pct advancing_pct stage2_pct near_high_pct market_regime:s",
    covers="AGG-6 WIN-30",
    sql=with_(
        "snap bench",
        f"""SELECT x.*, CASE WHEN close > s50 AND s50 > s200 AND above_sma50_pct >= 55 THEN 'BULLISH PARTICIPATION'
  WHEN close < s50 AND s50 < s200 AND above_sma50_pct <= 40 THEN 'BEARISH PARTICIPATION'
  WHEN close > s200 AND above_sma50_pct < 45 THEN 'NARROW / CAUTIOUS' ELSE 'SIDEWAYS / MIXED' END AS market_regime
 FROM (SELECT max(date) AS date, count(*) AS eligible_stocks, avg(CAST(close > sma20 AS DOUBLE)) * 100 AS above_sma20_pct, avg(CAST(close > sma50 AS DOUBLE)) * 100 AS above_sma50_pct,
  avg(CAST(close > sma200 AS DOUBLE)) * 100 AS above_sma200_pct, avg(CAST(ret_1d > 0 AS DOUBLE)) * 100 AS advancing_pct,
  avg(CAST(stage = 'Stage 2' AS DOUBLE)) * 100 AS stage2_pct, avg(CAST(distance_52w_high >= -0.05 AS DOUBLE)) * 100 AS near_high_pct FROM snap) x
 JOIN (SELECT date, close, {roll('avg', 'close', 50, part='')} AS s50, {roll('avg', 'close', 200, part='')} AS s200 FROM bench) b USING (date)""",
    ),
)
def snapshot_breadth_and_regime(spark, sf):
    stored = sh.stored_bars(spark, sf)
    return st.participation_regime(stored[1], stage(snapshot(spark, sf, stored), "snapshot"))


@query(
    "sector:s stocks:i sector_rs median_rs median_1m rs_momentum breadth50 stage2_pct leaders:i top_stock:s",
    covers="AGG-7",
    sql=with_(
        "snap",
        """SELECT sector, count(*) AS stocks, avg(rs_rating) AS sector_rs, median(rs_rating) AS median_rs, median(ret_1m) AS median_1m,
  median(rs_change_20d) AS rs_momentum, avg(CAST(close > sma50 AS DOUBLE)) * 100 AS breadth50, avg(CAST(stage = 'Stage 2' AS DOUBLE)) * 100 AS stage2_pct,
  sum(CAST(rs_rating >= 80 AS INTEGER)) AS leaders, arg_max(symbol, (rs_rating, rs_composite, symbol)) AS top_stock FROM snap GROUP BY sector""",
    ),
)
def sector_strength_summary(spark, sf):
    return st.sector_summary(stage(snapshot(spark, sf), "snapshot"))


@query(
    "symbol:s alert:s severity:s value",
    covers="RUL-6",
    sql=with_(
        "snap uni",
        " UNION ALL ".join(
            f"SELECT symbol, '{a}' AS alert, '{s}' AS severity, {v} AS value FROM snap JOIN (SELECT symbol FROM uni WHERE balance > 0) USING (symbol) WHERE {c}"
            for a, s, v, c in (
                ("RS leader", "Positive", "rs_rating", "rs_rating >= 90"),
                ("Near breakout", "Watch", "distance_to_pivot", "near_breakout"),
                ("Price-volume breakout", "Positive", "volume_ratio", "breakout"),
                ("RS deterioration", "Caution", "rs_change_5d", "rs_change_5d <= -15"),
            )
        ),
    ),
)
def watchlist_alerts(spark, sf):
    watch = sh.universe(spark, sf).where(C("balance") > 0)
    return st.watchlist_alerts(snapshot(spark, sf), watch)


@query(
    "symbol:s date:d normalized",
    covers="WIN-50",
    sql=with_(
        "bars",
        """SELECT symbol, date, close / first_value(close) OVER (PARTITION BY symbol ORDER BY date) * 100 AS normalized FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rv FROM bars) WHERE rv <= 126""",
    ),
)
def rebased_comparison(spark, sf):
    return st.rebased_comparison(sh.bars(spark, sf))
