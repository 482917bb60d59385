"""Queries over chart patterns and event reactions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators import patterns as pt
from barloom.plans import shapes as sh
from barloom.plans.registry import query
from barloom.plans.shapes import define_cte, with_
from barloom.plans.sqlkit import chg, div, flag, lag, lead, over, roll
from barloom.sources.staging import stage

C = F.col


@query(
    "symbol:s date:d box_top box_bottom volume_confirmed:b box_status:s box_height_pct",
    covers="PAT-1",
    sql=with_(
        "bars",
        f"""SELECT *, CASE WHEN box_top IS NULL THEN NULL WHEN close > box_top AND volume_confirmed THEN 'Breakout' WHEN close < box_bottom THEN 'Breakdown' WHEN close >= box_top * 0.98 THEN 'Near breakout' WHEN close >= box_bottom AND close <= box_top THEN 'In box' ELSE 'Outside box' END AS box_status,
  (box_top - box_bottom) / nullif(close, 0) AS box_height_pct FROM (SELECT symbol, date, close, {roll('max', 'high', 20, -1)} AS box_top, {roll('min', 'low', 20, -1)} AS box_bottom, coalesce(volume >= avg(volume) OVER {over(20, -1)} * 1.2, FALSE) AS volume_confirmed FROM bars)""",
    ),
)
def darvas_box_states(spark, sf):
    return pt.darvas_box(sh.bars(spark, sf))


define_cte("tail0", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, max(high) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ph FROM bars", "bars")


def _ext(k):
    return f"(SELECT *, i - greatest(n - {k}, 0) AS p, least(n, {k}) AS sz FROM tail0 WHERE i >= n - {k})"


@query(
    "symbol:s name:s status:s confidence start_index:i end_index:i level",
    covers="PAT-2 PAT-3 PAT-4 PAT-5 PAT-6 PAT-7 UDF-5",
    sql=with_(
        "tail0",
        """SELECT symbol, 'Life High / Uncharted Territory' AS name, CASE WHEN close > ph THEN 'Breakout' ELSE 'Near life high' END AS status, CASE WHEN close > ph THEN 0.7 ELSE 0.55 END AS confidence, 0 AS start_index, n - 1 AS end_index, ph AS level FROM tail0 WHERE i = n - 1 AND n >= 30 AND close >= ph * 0.98
 UNION ALL SELECT symbol, 'Darvas Breakout-Retest', 'Retest holding', 0.72, n - 35, n - 1, lv FROM (SELECT symbol, any_value(n) AS n, any_value(lv) AS lv, max(close) FILTER (i = n - 1) AS c, bool_or(i BETWEEN n - 8 AND n - 3 AND close > lv * 1.01) AS broke, bool_or(i >= n - 5 AND low <= lv * 1.03) AS ret FROM (SELECT t.*, l.lv FROM tail0 t JOIN (SELECT symbol, max(high) AS lv FROM tail0 WHERE i BETWEEN n - 35 AND n - 9 GROUP BY symbol) l USING (symbol)) GROUP BY symbol) WHERE n >= 35 AND broke AND ret AND c >= lv
 UNION ALL SELECT symbol, 'Fibonacci 50-61.8 Pullback', 'In golden pullback zone', 0.66, greatest(0, n - sz + lo_at), n - 1, hi FROM (SELECT f.symbol, any_value(f.n) AS n, any_value(f.sz) AS sz, any_value(m.lo_at) AS lo_at, any_value(m.lo) AS lo, max(f.high) FILTER (f.p >= m.lo_at) AS hi, arg_max(f.p, (f.high, -f.p)) FILTER (f.p >= m.lo_at) AS hi_at, max(f.close) FILTER (f.i = f.n - 1) AS c FROM """ + _ext(90) + """ f JOIN (SELECT symbol, min(low) AS lo, arg_min(p, (low, p)) AS lo_at FROM """ + _ext(90) + """ GROUP BY symbol) m USING (symbol) GROUP BY f.symbol) WHERE n >= 35 AND sz - lo_at >= 8 AND hi > lo AND hi_at < sz - 2 AND (hi - c) / (hi - lo) BETWEEN 0.47 AND 0.65
 UNION ALL SELECT symbol, 'DarvaX High-Dry-Fry Base', CASE WHEN c > bh THEN 'Base breakout' ELSE 'Tight base after dry fry' END, CASE WHEN pv >= av * 1.4 THEN 0.74 ELSE 0.6 END, greatest(0, n - sz + pk_at), n - 1, pk FROM (SELECT f.symbol, any_value(f.n) AS n, any_value(f.sz) AS sz, any_value(m.pk_at) AS pk_at, any_value(m.pk) AS pk, min(f.low) FILTER (f.p <= m.pk_at) AS lo, min(f.low) FILTER (f.p >= m.pk_at) AS pl, avg(f.volume) AS av, max(f.volume) FILTER (f.p BETWEEN m.pk_at - 2 AND m.pk_at) AS pv, max(f.high) FILTER (f.p >= f.sz - 6) AS b6, min(f.low) FILTER (f.p >= f.sz - 6) AS l6, max(f.high) FILTER (f.p BETWEEN f.sz - 6 AND f.sz - 2) AS bh, max(f.close) FILTER (f.i = f.n - 1) AS c FROM """ + _ext(70) + """ f JOIN (SELECT symbol, max(high) AS pk, arg_min(p, (-high, p)) AS pk_at FROM """ + _ext(70) + """ WHERE p < sz - 5 GROUP BY symbol) m USING (symbol) GROUP BY f.symbol) WHERE n >= 45 AND pk_at >= 7 AND (pk - lo) / lo BETWEEN 0.18 AND 0.65 AND (pk - pl) / pk BETWEEN 0.08 AND 0.28 AND (b6 - l6) / c <= 0.09
 UNION ALL SELECT symbol, '1-2-3 / Double Bottom', CASE WHEN c > nk THEN 'Neckline breakout' ELSE 'At neckline' END, 0.64, greatest(0, n - sz + l1_at), n - 1, nk FROM (SELECT f.symbol, any_value(f.n) AS n, any_value(f.sz) AS sz, any_value(m.l1_at) AS l1_at, any_value(m.l1) AS l1, any_value(m.l2) AS l2, max(f.high) FILTER (f.p >= m.l1_at AND f.p < m.l2_at) AS nk, max(f.close) FILTER (f.i = f.n - 1) AS c FROM """ + _ext(80) + """ f JOIN (SELECT a.symbol, any_value(l1_at) AS l1_at, any_value(l1) AS l1, min(low) AS l2, arg_min(p, (low, p)) AS l2_at FROM """ + _ext(80) + """ a JOIN (SELECT symbol, min(low) AS l1, arg_min(p, (low, p)) AS l1_at FROM """ + _ext(80) + """ WHERE p < sz - 10 GROUP BY symbol) q USING (symbol) WHERE p >= l1_at + 5 GROUP BY a.symbol) m USING (symbol) GROUP BY f.symbol) WHERE n >= 40 AND sz - l1_at - 5 >= 12 AND abs(l2 - l1) / l1 <= 0.04 AND c >= nk * 0.99""",
    ),
)
def chart_patterns(spark, sf):
    d = pt.swing_patterns(pt.last_bars(sh.bars(spark, sf))).select("symbol", F.explode("patterns").alias("p"))
    lv = C("levels")
    return d.select("symbol", "p.*").withColumn(
        "level", F.coalesce(lv["life_high"], lv["retest_level"], lv["swing_high"], lv["peak"], lv["neckline"]))


@query("symbol:s name:s status:s confidence end_index:i", covers="PAT-7")
def visible_patterns(spark, sf):
    d = pt.detected_patterns(sh.bars(spark, sf))
    return pt.visible(d.withColumn("last_index", C("end_index")), "last_index")


define_cte(
    "zbars",
    f"""SELECT symbol, close, i, n, coalesce(({roll('avg', 'tr', 14)}) * 2, 0) AS band FROM (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
 row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT *, {lag('close')} AS pc FROM bars))""".replace("ORDER BY date ROWS", "ORDER BY i ROWS"),
    "bars",
)
# one row per bar: side and extreme after it, and the swing that the bar ended
define_cte(
    "zig",
    """/*recursive*/ SELECT symbol, i, n, 0 AS side, CAST(0 AS BIGINT) AS pos, close AS top, NULL::INTEGER AS done, NULL::BIGINT AS done_pos, NULL::DOUBLE AS done_top FROM zbars WHERE i = 0
 UNION ALL SELECT symbol, i, n, CASE WHEN opens THEN CASE WHEN x > top THEN 1 ELSE -1 END WHEN turns THEN -side ELSE side END, CASE WHEN opens OR goes OR turns THEN i ELSE pos END, CASE WHEN opens OR goes OR turns THEN x ELSE top END,
  CASE WHEN turns THEN side END, CASE WHEN turns THEN pos END, CASE WHEN turns THEN top END
 FROM (SELECT *, side <> 0 AND NOT goes AND (top - x) * side >= need AS turns FROM (SELECT b.symbol, b.i, b.n, z.side, z.pos, z.top, b.close AS x, greatest(b.band, z.top * 0.03) AS need,
   z.side = 0 AND abs(b.close - z.top) >= greatest(b.band, z.top * 0.03) AS opens, z.side <> 0 AND (b.close - z.top) * z.side >= 0 AS goes FROM zig z JOIN zbars b ON b.symbol = z.symbol AND b.i = z.i + 1))""",
    "zbars",
)
define_cte(
    "swing",
    """SELECT symbol, pos, kind, price, row_number() OVER (PARTITION BY symbol ORDER BY pos) AS k, count(*) OVER (PARTITION BY symbol) AS m FROM (SELECT symbol, done_pos AS pos, CASE WHEN done > 0 THEN 'high' ELSE 'low' END AS kind, done_top AS price FROM zig WHERE done IS NOT NULL
 UNION ALL SELECT symbol, pos, CASE WHEN side > 0 THEN 'high' ELSE 'low' END, top FROM zig WHERE i = n - 1 AND side <> 0)""",
    "zig",
)
define_cte(
    "pull",
    """SELECT symbol, src, pos, v, row_number() OVER (PARTITION BY symbol, src ORDER BY pos DESC) AS back FROM (
 SELECT symbol, 0 AS src, pos, (price - np) / nullif(price, 0) * 100 AS v, 2 AS least_v FROM (SELECT *, lead(kind) OVER w AS nk, lead(price) OVER w AS np FROM swing WINDOW w AS (PARTITION BY symbol ORDER BY pos)) WHERE m - k < 12 AND kind = 'high' AND nk = 'low' AND price > 0
 UNION ALL SELECT symbol, 1, pos, (price - np) / nullif(price, 0) * 100, 1 FROM (SELECT *, lead(kind) OVER w AS nk, lead(price) OVER w AS np FROM (
   SELECT symbol, g, kind, CASE WHEN kind = 'high' THEN max(close) ELSE min(close) END AS price, min(p) AS pos FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY p) AS g FROM (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY symbol ORDER BY p) THEN 0 ELSE 1 END AS fresh FROM (
     SELECT symbol, p, close, CASE WHEN close = hi THEN 'high' WHEN close = lo THEN 'low' END AS kind FROM (SELECT symbol, close, i - greatest(n - 120, 0) AS p, least(n, 120) AS sz, max(close) OVER f AS hi, min(close) OVER f AS lo FROM zbars WHERE i >= n - 120 WINDOW f AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) WHERE sz >= 20 AND p BETWEEN 2 AND sz - 3) WHERE kind IS NOT NULL)) GROUP BY symbol, g, kind) WINDOW w AS (PARTITION BY symbol ORDER BY pos)) WHERE kind = 'high' AND nk = 'low' AND price > 0) WHERE v >= least_v AND v <= 45""",
    "swing",
)
define_cte(
    "tight",
    """/*recursive*/ SELECT symbol, vals, 0 AS used, src, CAST([] AS DOUBLE[]) AS seq FROM (SELECT s.symbol, CASE WHEN len(coalesce(a, [])) >= 2 THEN a ELSE coalesce(b, []) END AS vals, CASE WHEN len(coalesce(a, [])) >= 2 THEN 'swings' ELSE 'local' END AS src FROM (SELECT DISTINCT symbol FROM bars) s
   LEFT JOIN (SELECT symbol, list(v ORDER BY pos) FILTER (src = 0) AS a, list(v ORDER BY pos) FILTER (src = 1) AS b FROM pull WHERE back <= 5 GROUP BY symbol) USING (symbol))
 UNION ALL SELECT symbol, vals, used + 1, src, CASE WHEN len(seq) = 0 OR vals[used + 1] < seq[-1] THEN list_append(seq, vals[used + 1]) WHEN len(seq) >= 2 AND vals[used + 1] < seq[-2] THEN list_append(seq[1:len(seq) - 1], vals[used + 1]) ELSE seq END FROM tight WHERE used < len(vals)""",
    "pull",
)


@query(
    "symbol:s swings:i last_kind:s last_price contractions:s source:s shrinking:b pivot_price",
    covers="PAT-9 PAT-10 SCA-22",
    sql=with_(
        "tight",
        """SELECT t.symbol, coalesce(s.m, 0) AS swings, s.kind AS last_kind, s.price AS last_price, coalesce(list_aggregate(list_transform(seq, lambda v: printf('%.1f%%', v)), 'string_agg', ' -> '), '') AS contractions, src AS source,
  len(seq) BETWEEN 2 AND 5 AND len(list_filter(range(2, len(seq) + 1), lambda q: seq[q] > seq[q - 1] * 0.85)) = 0 AS shrinking, coalesce(h.pv, b.pv) AS pivot_price
 FROM (SELECT * FROM tight WHERE used = len(vals)) t LEFT JOIN (SELECT * FROM swing WHERE k = m) s USING (symbol)
 LEFT JOIN (SELECT symbol, max(price) AS pv FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY k DESC) AS r FROM swing WHERE m - k < 8 AND kind = 'high') WHERE r <= 3 GROUP BY symbol) h USING (symbol)
 LEFT JOIN (SELECT symbol, max(high) AS pv FROM (SELECT symbol, high, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r, count(*) OVER (PARTITION BY symbol) AS n FROM bars) WHERE r <= 20 AND n >= 20 GROUP BY symbol) b USING (symbol)""",
    ),
)
def zigzag_contractions(spark, sf):
    bars = sh.bars(spark, sf)
    z = stage(pt.with_contractions(pt.zigzag_swings(bars)), "swings")
    last = F.try_element_at("swings", F.lit(-1))
    n = F.size("sequence")
    z = z.join(pt.recent_high(bars), "symbol", "left")
    return z.select(
        "symbol", F.size("swings").alias("swings"), last["kind"].alias("last_kind"), last["price"].alias("last_price"),
        F.array_join(F.transform("sequence", lambda v: F.format_string("%.1f%%", v)), " -> ").alias("contractions"), "source",
        ((n >= 2) & (n <= 5) & pt.shrinks(C("sequence"))).alias("shrinking"), F.coalesce(pt.swing_pivot(C("swings")), "recent_high").alias("pivot_price"))


@query(
    "symbol:s vcp_score trigger_score action_score distance_to_pivot trend_ok:b contractions_ok:b volatility_ok:b dry_up:b rs_ok:b breakout:b distribution:b",
    covers="PAT-8 PAT-11 TOP-5 WIN-37",
)
def vcp_scan(spark, sf):
    return pt.vcp_scan(*sh.stored_bars(spark, sf)).orderBy(C("action_score").desc(), "symbol")


@query("symbol:s vcp_score institutional_component", covers="PAT-12 RUL-26")
def vcp_with_shareholding(spark, sf):
    scan = pt.vcp_scan(*sh.stored_bars(spark, sf))
    held = sh.universe(spark, sf).where(C("balance") > 0).select(
        "symbol", F.least(C("balance") / 100.0, F.lit(100.0)).alias("institutional_component"))
    return pt.vcp_adjusted(scan, held)


@query(
    "symbol:s top:f4 bottom:f4 quality state:s entry:f4 stop:f4 target:f4 gross_reward_risk:f4 net_reward_risk:f4 decision:s",
    covers="PAT-13 RUL-25",
)
def darvas_setups(spark, sf):
    cfg = pt.DarvasConfig(max_height_pct=1e6, touch_pct=25.0)
    return pt.darvas_setups(sh.bars(spark, sf), cfg)


_EVT = "volume >= 90"
define_cte(
    "evr",
    f"""SELECT *, post_return - bench_return AS excess, pre_return * post_return < 0 AND abs(post_return) >= 0.02 AS trend_flip FROM (
 SELECT symbol, date, close / pre - 1 AS pre_return, post / prior - 1 AS post_return, post10 / prior - 1 AS post10_return, bpost / pb - 1 AS bench_return, volume_ratio, range_ratio FROM (
  SELECT *, coalesce({lag('close')}, close) AS prior, coalesce({lag('bc')}, bc) AS pb, coalesce({lag('close', 5)}, first_value(close) OVER (PARTITION BY symbol ORDER BY date)) AS pre, {lead('close', 5)} AS post, {lead('bc', 5)} AS bpost,
   coalesce({lead('close', 10)}, last_value(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS post10,
   avg(volume) OVER {over(6, 5)} / avg(volume) OVER {over(20, -1)} AS volume_ratio, avg(rg) OVER {over(6, 5)} / nullif(avg(rg) OVER {over(20, -1)}, 0) AS range_ratio
  FROM (SELECT b.*, n.close AS bc, (b.high - b.low) / b.close AS rg FROM bars b LEFT JOIN bench n USING (date))) WHERE {_EVT} AND post IS NOT NULL)""",
    "bars bench",
)


@query(
    "symbol:s date:d pre_return post_return post10_return excess volume_ratio range_ratio trend_flip:b reaction_score",
    covers="PAT-14",
    sql=with_(
        "evr",
        """SELECT *, least(greatest(least(abs(post_return) * 260, 24) + least(abs(post10_return) * 160, 16) + coalesce(least(abs(excess) * 300, 24), 0) + CASE WHEN volume_ratio IS NULL THEN 0 ELSE greatest(0, least((volume_ratio - 1) * 18, 12)) END
  + CASE WHEN range_ratio IS NULL THEN 0 ELSE greatest(0, least((range_ratio - 1) * 16, 10)) END + CASE WHEN trend_flip THEN 10 ELSE 0 END + 10.5, 0), 100) AS reaction_score FROM evr""",
    ),
)
def event_reactions(spark, sf):
    return pt.event_reactions(sh.bars(spark, sf), sh.benchmark(spark, sf), C("volume") >= 90)


define_cte(
    "rdf",
    f"""SELECT *, max(CASE WHEN volume >= 90 THEN i END) OVER (PARTITION BY symbol ORDER BY date) AS at FROM (SELECT *, {chg('close')} AS r, {lag('close')} AS pc, avg(volume) OVER {over(20, -1)} AS v20, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i,
  {lead('close', 2)} / close - exp(sum(ln(1 + br)) OVER {over(2, 2)}) AS x2, {lead('close', 5)} / close - exp(sum(ln(1 + br)) OVER {over(5, 5)}) AS x5, count(br) OVER {over(2, 2)} AS c2, count(br) OVER {over(5, 5)} AS c5
  FROM (SELECT b.*, n.br FROM bars b LEFT JOIN (SELECT date, {chg('close', 1, '')} AS br FROM bench) n USING (date)))""",
    "bars bench",
)


@query(
    "symbol:s date:d sessions_since:i day_return day_excess volume_to_avg20 gap excess_2d excess_5d post_volatility window_label:s",
    covers="PAT-16 JOIN-20",
    sql=with_(
        "rdf",
        """SELECT b.symbol, b.date, b.i - b.at AS sessions_since, e.r AS day_return, e.r - e.br AS day_excess, e.volume / nullif(e.v20, 0) AS volume_to_avg20, e.open / e.pc - 1 AS gap, CASE WHEN b.i - b.at >= 2 AND e.c2 = 2 THEN e.x2 END AS excess_2d, CASE WHEN b.i - b.at >= 5 AND e.c5 = 5 THEN e.x5 END AS excess_5d,
  CASE WHEN count(b.r) OVER w >= 2 THEN stddev_pop(b.r) OVER w END AS post_volatility, CASE WHEN b.i - b.at <= 5 THEN 'D0_5' WHEN b.i - b.at <= 10 THEN 'D6_10' ELSE 'D11_20' END AS window_label
 FROM rdf b JOIN rdf e ON e.symbol = b.symbol AND e.i = b.at WHERE b.i - b.at BETWEEN 0 AND 20 WINDOW w AS (PARTITION BY b.symbol, b.at ORDER BY b.date)""",
    ),
)
def result_day_features(spark, sf):
    return pt.result_day_features(sh.bars(spark, sf), sh.benchmark(spark, sf), C("volume") >= 90)


@query(
    "symbol:s date:d support resistance atr_stop",
    covers="WIN-56",
    sql=with_(
        "bars",
        f"""SELECT symbol, date, min(low) OVER {over(20)} AS support, max(high) OVER {over(20)} AS resistance, close - ({roll('avg', 'tr', 14)}) * 2 AS atr_stop FROM (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM (SELECT *, {lag('close')} AS pc FROM bars))""",
    ),
)
def support_resistance_levels(spark, sf):
    return pt.support_levels(sh.bars(spark, sf))


@query(
    "symbol:s date:d event_date:d days_to_event:i watch_score",
    covers="PAT-15",
    sql=with_(
        "feat",
        """SELECT l.symbol, l.date, e.event_date, date_diff('day', l.date, e.event_date) AS days_to_event, least(greatest(0, 30 - date_diff('day', l.date, e.event_date)) + CASE WHEN close > sma_20 THEN 20 ELSE 0 END + CASE WHEN close > sma_50 THEN 20 ELSE 0 END + CASE WHEN volume_to_avg20 < 0.8 THEN 15 ELSE 0 END + 10.5, 100) AS watch_score
 FROM (SELECT * FROM feat WHERE date <= DATE '2001-01-01' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1) l JOIN (SELECT symbol, min(date) AS event_date FROM bars WHERE volume >= 90 AND date > DATE '2001-01-01' GROUP BY symbol) e USING (symbol)""",
    ),
)
def upcoming_event_watch(spark, sf):
    from barloom.operators import features as ft

    bars = sh.bars(spark, sf)
    f = ft.add_trend(bars, pt.S, (20, 50)).withColumn("volume_to_avg20", ft.ratio("volume", pt.S.mean("volume", 20)))
    as_of = F.lit("2001-01-01").cast("date")
    last = Window.partitionBy("symbol").orderBy(C("date").desc())
    latest = f.where(C("date") <= as_of).withColumn("_r", F.row_number().over(last)).where(C("_r") == 1).drop("_r")
    ev = bars.where((C("volume") >= 90) & (C("date") > as_of)).select("symbol", C("date").alias("event_date"), F.lit(3).alias("priority"))
    return pt.upcoming_event_watch(latest, ev)
