"""Queries over resampling and learned models."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.draws import draw_sql, mixed_sql, pick_sql
from barloom.operators import backtest as bt
from barloom.operators import learning as ln
from barloom.operators import performance as pf
from barloom.operators import resampling as rs
from barloom.operators import signals as sg
from barloom.plans import backtests as bp
from barloom.plans import shapes as sh
from barloom.plans.evaluation import A, B, scored
from barloom.plans.registry import query
from barloom.plans.shapes import define_cte, with_
from barloom.plans.sqlkit import lag, lead, over, roll
from barloom.sources.staging import stage

C = F.col
FEATURES = ("score", "score_b", "pa", "pb")


PATHS, SAMPLES, ORIGIN_PATHS, PORTFOLIOS = 2000, 2000, 500, 1000  # the reference's numbers of draws


@query(
    "sample:i log_terminal max_drawdown",
    covers="BT-15",
    sql=with_(
        "per",
        f"""SELECT sample, arg_max(e, pos) AS log_terminal, min(exp(e - pk) - 1) AS max_drawdown FROM (SELECT *, max(e) OVER (PARTITION BY sample ORDER BY pos) AS pk FROM (
  SELECT sample, pos, sum(ln(1 + net_return)) OVER (PARTITION BY sample ORDER BY pos) AS e FROM (SELECT sample, pos, {pick_sql('(SELECT count(*) FROM per)', 42, 'sample', 'pos')} AS idx FROM range(1, {SAMPLES + 1}) a(sample), (SELECT unnest(range(1, (SELECT count(*) FROM per) + 1)) AS pos)) g
  JOIN (SELECT net_return, row_number() OVER (ORDER BY signal_date) AS idx FROM per) r USING (idx))) GROUP BY sample""",
    ),
)
def monte_carlo_paths(spark, sf):
    return rs.monte_carlo(stage(bp._staged(spark, sf)[1], "periods"), SAMPLES)


define_cte(
    "boot",
    f"""SELECT sample, sum(a_hits) / nullif(sum(a_n), 0) AS a_precision, sum(b_hits) / nullif(sum(b_n), 0) AS b_precision, sum(b_hits) / nullif(sum(b_n), 0) - sum(a_hits) / nullif(sum(a_n), 0) AS difference FROM (
  SELECT sample, {pick_sql('(SELECT count(*) FROM bd)', 7, 'sample', 'pos')} AS idx FROM range(1, {SAMPLES + 1}) a(sample), (SELECT unnest(range(1, (SELECT count(*) FROM bd) + 1)) AS pos)) JOIN bd USING (idx) GROUP BY sample""",
    "bd",
)
define_cte("bd", "SELECT *, row_number() OVER (ORDER BY date) AS idx FROM (SELECT date, count_if(pa >= 0.9 AND y = 1) AS a_hits, count_if(pa >= 0.9) AS a_n, count_if(pb >= 0.8 AND y = 1) AS b_hits, count_if(pb >= 0.8) AS b_n FROM pp GROUP BY date)", "pp")


def _boot(spark, sf):
    n = lambda c: F.count(F.when(c, 1))
    per = scored(spark, sf).groupBy("date").agg(
        n(A() & (C("y") == 1)).alias("a_hits"), n(A()).alias("a_n"), n(B() & (C("y") == 1)).alias("b_hits"), n(B()).alias("b_n"))
    return rs.block_bootstrap(per, SAMPLES)


@query("sample:i a_precision b_precision difference", covers="BT-16", sql=with_("boot", "SELECT * FROM boot"))
def date_block_bootstrap(spark, sf):
    return _boot(spark, sf)


@query(
    "samples:i low median high share_positive",
    covers="BT-16",
    sql=with_("boot", "SELECT count(*) AS samples, quantile_cont(difference, 0.025) AS low, median(difference) AS median, quantile_cont(difference, 0.975) AS high, avg(CAST(difference > 0 AS DOUBLE)) AS share_positive FROM boot"),
)
def bootstrap_interval(spark, sf):
    return rs.interval(_boot(spark, sf), "difference")


PLAN = rs.Plan(paths=PATHS)
_HIT = """CASE WHEN o <= 0.9 THEN 'STOP' WHEN o >= 1.15 THEN 'TARGET' WHEN l <= 0.9 THEN 'STOP' WHEN h >= 1.15 THEN 'TARGET' END"""
_PX = "CASE WHEN o <= 0.9 THEN o WHEN o >= 1.15 THEN 1.15 WHEN l <= 0.9 THEN 0.9 WHEN h >= 1.15 THEN 1.15 END"


def _out(src, keys):
    return f"""SELECT {keys}, coalesce(k, 'NEITHER') AS outcome, coalesce(hd, ld) AS exit_day, x - 1 AS gross_return, x * (1 - 0.0005) * (1 - 0.001) / ((1 + 0.0005) * (1 + 0.001)) - 1 AS net_return FROM (
  SELECT {keys}, arg_min(k, day) FILTER (k IS NOT NULL) AS k, min(day) FILTER (k IS NOT NULL) AS hd, max(day) AS ld, coalesce(arg_min(x, day) FILTER (k IS NOT NULL), arg_max(c, day)) AS x FROM (SELECT *, {_HIT} AS k, {_PX} AS x FROM ({src})) GROUP BY {keys})"""


define_cte("rat", f"SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rw, open / pc AS ro, high / pc AS rh, low / pc AS rl, close / pc AS rc, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT *, {lag('close')} AS pc FROM bars)", "bars")


def _sim_sql(origins: str, keys: str, paths: int) -> str:
    """Resampled paths of ``origins`` (keys, symbol, blocks): keys, path, day, o, h, l, c."""
    return f"""SELECT {keys}, path, day, ro * base AS o, rh * base AS h, rl * base AS l, rc * base AS c FROM (SELECT *, exp(coalesce(sum(ln(rc)) OVER (PARTITION BY {keys}, path ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS base FROM (
  SELECT g.* EXCLUDE (rw), CASE WHEN day = 1 THEN 1 ELSE ro END AS ro, CASE WHEN day = 1 THEN rh / ro ELSE rh END AS rh, CASE WHEN day = 1 THEN rl / ro ELSE rl END AS rl, CASE WHEN day = 1 THEN rc / ro ELSE rc END AS rc FROM (
   SELECT {keys}, path, blk * 5 + off + 1 AS day, 1 + {pick_sql('blocks', 11, 'path', 'blk')} + off AS rw FROM ({origins}) o, range(1, {paths + 1}) a(path), range(0, 2) b(blk), range(0, 5) c(off) WHERE blocks >= 20) g JOIN rat r ON r.symbol = g.symbol AND r.rw = g.rw))"""


define_cte("simp", _sim_sql("SELECT DISTINCT symbol, n - 5 AS blocks FROM rat", "symbol", PATHS), "rat")
define_cte("simo", _out("SELECT * FROM simp", "symbol, path"), "simp")


def _segmented(spark, sf):
    return sh.bars(spark, sf).withColumn("segment", F.lit(0))


@query("symbol:s path:i outcome:s exit_day:i gross_return net_return", covers="BT-17", sql=with_("simo", "SELECT * FROM simo"))
def simulated_plan_outcomes(spark, sf):
    return rs.simulate_plan(_segmented(spark, sf), PLAN)


@query(
    "symbol:s target_share stop_share neither_share net_mean net_median",
    covers="BT-17",
    sql=with_(
        "simo",
        "SELECT symbol, " + ", ".join(f"avg(CAST(outcome = '{k}' AS DOUBLE)) AS {k.lower()}_share" for k in ("TARGET", "STOP", "NEITHER"))
        + ", avg(net_return) AS net_mean, median(net_return) AS net_median FROM simo GROUP BY symbol",
    ),
)
def simulated_plan_frequencies(spark, sf):
    return rs.plan_frequencies(rs.outcome_arrays(_segmented(spark, sf), PLAN))


@query(
    "symbol:s day:i p10 median p90",
    covers="BT-17",
    sql=with_("simp", "SELECT symbol, day, quantile_cont(c, 0.1) AS p10, median(c) AS median, quantile_cont(c, 0.9) AS p90 FROM simp GROUP BY symbol, day"),
)
def simulated_plan_bands(spark, sf):
    return rs.plan_bands(rs.path_arrays(_segmented(spark, sf), PLAN, columns=("c",)))


define_cte("ix", f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i, {lead('open', 1)} AS entry, {roll('avg', 'close', 200)} AS s200, {lead('close', 10)} AS fl FROM bars", "bars")
define_cte(
    "replay",
    _out("SELECT o.symbol, o.origin, o.regime, b.i - o.i AS day, b.open / o.entry AS o, b.high / o.entry AS h, b.low / o.entry AS l, b.close / o.entry AS c FROM (SELECT symbol, date AS origin, i, entry, CASE WHEN close > s200 THEN 'Above SMA200' ELSE 'Below SMA200' END AS regime FROM ix WHERE i >= 252 AND (i - 252) % 10 = 0 AND fl IS NOT NULL) o JOIN ix b ON b.symbol = o.symbol AND b.i BETWEEN o.i + 1 AND o.i + 10", "symbol, origin, regime"),
    "ix",
)


@query("symbol:s origin:d regime:s outcome:s exit_day:i gross_return net_return", covers="BT-18", sql=with_("replay", "SELECT * FROM replay"))
def replayed_plan_outcomes(spark, sf):
    return rs.replay_plan(sh.bars(spark, sf), PLAN)


define_cte("org", "SELECT symbol, origin, i + 1 AS train_rows, i - 4 AS blocks FROM replay JOIN (SELECT symbol, date AS origin, i FROM ix) USING (symbol, origin)", "replay ix")


@query(
    "symbol:s origin:d regime:s train_rows:i target_frequency target_hit:i outcome:s net_return",
    covers="BT-18 BT-17",
    sql=with_(
        "org rat",
        f"""SELECT r.*, g.train_rows, f.target_frequency, CAST(r.outcome = 'TARGET' AS INTEGER) AS target_hit FROM replay r JOIN org g USING (symbol, origin)
 JOIN (SELECT symbol, origin, avg(CAST(outcome = 'TARGET' AS DOUBLE)) AS target_frequency FROM ({_out(_sim_sql('SELECT symbol, origin, blocks FROM org', 'symbol, origin', ORIGIN_PATHS), 'symbol, origin, path')}) GROUP BY symbol, origin) f USING (symbol, origin)""",
    ),
)
def replayed_plan_calibration(spark, sf):
    return rs.replay_calibration(_segmented(spark, sf), rs.Plan(paths=ORIGIN_PATHS))


CFG14 = bt.Strategy(top_n=10, stop_loss=0.25, min_traded_value=1000.0, circuit=3.0)


def _matched(spark, sf):
    """Bars, eligible names, the strategy's schedule and portfolios of its turnover."""
    bench = sh.benchmark(spark, sf)
    sched = bt.schedule(bench)
    data = stage(bt.prepare(sh.sector_bars(spark, sf), sg.get_signal("momentum_weekly")), "scored-bars")
    elig = data.join(sched.select(C("signal_date").alias("date")), "date", "left_semi").where(
        C("is_tradable") & (C("avg_traded_value_20d") >= CFG14.min_traded_value)
    ).select(C("date").alias("signal_date"), "symbol", "sector", "volatility", F.substring("symbol", 2, 12).cast("bigint").alias("key"))
    turnover = stage(bp._staged(spark, sf)[1].select("signal_date", "turnover"), "turnover")
    return data, elig, sched, bench, rs.matched_picks(elig, turnover, PORTFOLIOS, CFG14.top_n)


_STEP = f"""SELECT v, t, list_concat(kept, list_slice(list_filter(cands, lambda c: NOT list_contains(list_transform(kept, lambda k: k.symbol), c.symbol)), 1, size - len(kept))) AS names, len(kept) AS kept FROM (
   SELECT c.v, p.t, p.size, d.cands, list_transform(list_slice(list_sort(list_transform(list_filter(c.names, lambda x: x.until >= p.t), lambda x: {{'u': {mixed_sql('d.salt', 'x.k')}, 'symbol': x.symbol, 'k': x.k, 'until': x.until}})), 1, greatest(0, p.size - p.rep)),
    lambda x: {{'symbol': x.symbol, 'k': x.k, 'until': x.until}}) AS kept FROM chain c JOIN dts p ON p.t = c.t + 1 JOIN cand d ON d.v = c.v AND d.t = p.t)"""


@query(
    "variant:i signal_date:d size:i replace:i kept:i turnover symbols:s",
    covers="BT-14",
    sql=with_(
        "bdata sched per",
        f"""SELECT v AS variant, signal_date, size, rep AS replace, kept, (len(a) + len(b) - 2 * len(list_intersect(a, b))) / greatest(1, 2 * (len(a) + len(b) - len(list_intersect(a, b)))) AS turnover, array_to_string(list_sort(a), ' ') AS symbols FROM (
 SELECT v, t, kept, list_transform(names, lambda x: x.symbol) AS a, coalesce(lag(list_transform(names, lambda x: x.symbol)) OVER (PARTITION BY v ORDER BY t), []) AS b FROM chain) JOIN dts USING (t) WHERE t > 0""",
        elig="SELECT d.date AS signal_date, d.symbol, CAST(substr(d.symbol, 2) AS BIGINT) AS k FROM bdata d JOIN sched s ON s.signal_date = d.date WHERE volume > 0 AND atv >= 1000",
        dts="""SELECT *, least(size, CAST(round_even(tt * size / greatest(1e-9, 1 - tt), 0) AS INTEGER)) AS rep FROM (SELECT signal_date, row_number() OVER (ORDER BY signal_date) AS t, least(c, 10) AS size, least(greatest(coalesce(turnover, 0.5), 0), 0.5) AS tt
 FROM (SELECT signal_date, count(*) AS c FROM elig GROUP BY signal_date) LEFT JOIN per USING (signal_date))""",
        rung="SELECT *, max(t) OVER (PARTITION BY symbol, t - rn) AS until FROM (SELECT e.symbol, e.k, d.t, row_number() OVER (PARTITION BY symbol ORDER BY t) AS rn FROM elig e JOIN dts d USING (signal_date))",
        cand=f"""SELECT v, t, list({{'symbol': symbol, 'k': k, 'until': until}} ORDER BY u, symbol) AS cands, {draw_sql(43, 'v', 't')} AS salt FROM (SELECT *, row_number() OVER (PARTITION BY v, t ORDER BY u, symbol) AS rk FROM (
 SELECT v, t, symbol, k, until, {draw_sql(42, 'v', 't', 'k')} AS u FROM rung, range(1, {PORTFOLIOS + 1}) a(v))) WHERE rk <= 20 GROUP BY v, t""",
        chain=f"""/*recursive*/ SELECT v, CAST(0 AS BIGINT) AS t, CAST([] AS STRUCT(symbol VARCHAR, k BIGINT, until BIGINT)[]) AS names, CAST(0 AS BIGINT) AS kept FROM range(1, {PORTFOLIOS + 1}) a(v) UNION ALL {_STEP}""",
    ).replace("chain AS MATERIALIZED", "chain AS"),
)
def turnover_matched_portfolios(spark, sf):
    from pyspark.sql.window import Window

    picks = _matched(spark, sf)[-1]
    p = picks.groupBy("variant", "signal_date", "size", "replace", "kept").agg(F.sort_array(F.collect_list("symbol")).alias("_a"))
    p = p.withColumn("_b", F.coalesce(F.lag("_a").over(Window.partitionBy("variant").orderBy("signal_date")), F.array().cast("array<string>")))
    both, all_ = F.size(F.array_intersect("_a", "_b")), F.size(F.array_union("_a", "_b"))
    return p.withColumns({"turnover": (all_ - both) / F.greatest(F.lit(1), 2 * all_), "symbols": F.array_join("_a", " ")})


@query("variant:i periods:i trades:i sharpe max_drawdown average_turnover", covers="BT-14")
def random_portfolio_baseline(spark, sf):
    data, elig, sched, bench, picks = _matched(spark, sf)
    held = picks.select("variant", "signal_date", "symbol", "rank").join(elig, ["signal_date", "symbol"]).withColumn("side", F.lit(1))
    w = bt.weights(held, CFG14, ["signal_date", "variant"])
    trades = stage(bt.simulate(w, data, bt.period_sessions(sched, bench), CFG14, ["variant"]), "random-trades")
    return pf.performance(stage(bt.periods(trades, sched, bench, ["variant"]), "random-periods"), trades, ["variant"])


def _rows(spark, sf):
    d = lambda t: F.lit(t).cast("date")
    return ln.time_split(scored(spark, sf), d("1999-01-01"), d("2000-07-01"))


@query("model:s split:s rows:i positives:i pr_auc:f4 roc_auc:f4", covers="BT-21 BT-11")
def model_family_comparison(spark, sf):
    return ln.compare_models(stage(_rows(spark, sf), "model-rows"), FEATURES)


@query("symbol:s date:d p p_platt p_isotonic", covers="BT-22")
def calibrated_probabilities(spark, sf):
    df = _rows(spark, sf).drop("p")
    m = ln.fit(df.where(C("split") == "train"), FEATURES, ln.models()["logistic"])
    sc = stage(ln.score(m, df.where(C("split") != "train")), "calibration-rows")
    return ln.apply_calibration(sc, *ln.calibrate(sc))


@query(
    "symbol:s date:d blended",
    covers="BT-23 JOIN-11",
    sql=with_("pp", "SELECT symbol, date, CASE WHEN yr % 2 = 0 THEN (pa * 0.6 + pb * 0.4) ELSE pa END AS blended FROM pp"),
)
def ensemble_scores(spark, sf):
    df = scored(spark, sf).withColumn("pb", F.when(C("yr") % 2 == 0, C("pb")))
    return ln.ensemble(df, {"pa": 0.6, "pb": 0.4}, "blended")


@query("feature:s base_auc:f4 roc_auc:f4 importance:f4 label:s", covers="BT-24 RUL-18")
def permutation_importance(spark, sf):
    df = _rows(spark, sf).drop("p")
    m = ln.fit(df.where(C("split") == "train"), FEATURES, ln.models()["forest"])
    test = stage(df.where(C("split") == "final_test"), "importance-rows")
    return ln.feature_labels(stage(ln.permutation_importance(m, test, FEATURES, ["symbol", "date"]), "importance"))


@query("trial:s fold:i rows:i pr_auc:f4 roc_auc:f4", covers="BT-25")
def walk_forward_trials(spark, sf):
    df = stage(scored(spark, sf).drop("p"), "trial-rows")
    return ln.walk_forward_grid(df, FEATURES, ln.evaluable_folds(df), {"shallow": {"maxDepth": 3, "numTrees": 10}, "deep": {"maxDepth": 6, "numTrees": 10}})


@query(
    "feature:s max_abs_correlation closest:s",
    covers="AGG-34",
    sql=with_(
        "pp",
        "SELECT f AS feature, max(r) AS max_abs_correlation, arg_max(g, r) AS closest FROM (" + " UNION ALL ".join(
            f"SELECT '{a}' AS f, '{b}' AS g, abs(corr({a}, {b})) AS r FROM pp" for a in FEATURES for b in FEATURES if a != b) + ") GROUP BY f",
    ),
)
def feature_redundancy(spark, sf):
    return ln.redundancy(scored(spark, sf), FEATURES)
