"""Queries evaluating scored, labelled rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.frames import with_row
from barloom.operators import evaluation as ev
from barloom.operators.order_stats import with_percentiles
from barloom.plans import labels as lp
from barloom.plans import shapes as sh
from barloom.plans.registry import query
from barloom.plans.reports import nation_weeks
from barloom.plans.shapes import define_cte, with_
from barloom.plans.sqlkit import chg, lead
from barloom.sources.staging import stage

C = F.col


def _avg_pct(x):
    return f"(rank() OVER (PARTITION BY date ORDER BY {x}) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count(*) OVER (PARTITION BY date)"


define_cte(
    "pp",
    f"SELECT *, {_avg_pct('score')} AS pa, {_avg_pct('score_b')} AS pb, 1 / (1 + exp(-3 * score)) AS p, yr - 1994 AS fold FROM pred",
    "pred",
)


def scored(spark, sf):
    """Predictions with same-date percentiles pa, pb, a probability and a yearly fold."""
    keep = ["symbol", "date", "sector", "yr", "score", "score_b", "y", "label", "excess_return", "future_stock_return"]
    rows = stage(lp.predictions(spark, sf).select(*keep), "predictions")  # read by both ladders and the joins
    df = with_percentiles(rows, ["date"], {"pa": "score", "pb": "score_b"})
    df = df.withColumns({"p": 1 / (1 + F.exp(-3 * C("score"))), "fold": C("yr") - 1994})
    return stage(df, "scored")


def A():
    return C("pa") >= 0.9


def B():
    return C("pb") >= 0.8


_M = """count(*) AS signals, avg(y) AS precision, avg(excess_return) AS average_excess, median(excess_return) AS median_excess,
 avg(future_stock_return) AS average_return, avg(CAST(excess_return > 0 AS DOUBLE)) AS win_rate"""
_MOUT = "signals:i precision average_excess median_excess average_return win_rate"
_BASE = "(SELECT avg(y) FROM pp)"

_TOPS = {"20%": 0.20, "10%": 0.10, "5%": 0.05, "2%": 0.02, "1%": 0.01}


@query(
    "top:s " + _MOUT + " lift",
    covers="AGG-23",
    sql=with_("pp", " UNION ALL ".join(
        f"SELECT '{n}' AS top, {_M}, avg(y) / {_BASE} AS lift FROM (SELECT *, rank() OVER (ORDER BY score DESC) AS r, count(*) OVER () AS n FROM pp) WHERE r <= greatest(1, ceil(n * CAST({f} AS DOUBLE)))"
        for n, f in _TOPS.items())),
)
def top_percentile_selections(spark, sf):
    df = scored(spark, sf)
    return ev.selection_metrics(ev.overall_top(df, "score", _TOPS), ["top"], ev.base_rate(df))


_GRID = {f"a{a}_b{b}": (a, b) for a in (80, 90, 95) for b in (60, 80)}


def grid_rules():
    return {n: (C("pa") >= a / 100) & (C("pb") >= b / 100) for n, (a, b) in _GRID.items()}


_GRIDSQL = " UNION ALL ".join(
    f"SELECT '{n}' AS rule, * FROM pp WHERE pa >= {a / 100} AND pb >= {b / 100}" for n, (a, b) in _GRID.items()
)


@query(
    "rule:s " + _MOUT + " lift",
    covers="AGG-26 AGG-45 FIL-16",
    sql=with_("pp", f"SELECT rule, {_M}, avg(y) / {_BASE} AS lift FROM ({_GRIDSQL}) GROUP BY rule"),
)
def threshold_grid(spark, sf):
    df = scored(spark, sf)
    return ev.selection_metrics(ev.tag(df, grid_rules()), ["rule"], ev.base_rate(df))


@query(
    "rule:s scopes:i worst_precision best_precision precision_std scopes_below_base:i scopes_negative_excess:i",
    covers="AGG-24",
    sql=with_(
        "pp",
        f"""SELECT rule, count(*) AS scopes, min(precision) AS worst_precision, max(precision) AS best_precision, stddev_samp(precision) AS precision_std,
  count_if(precision < {_BASE}) AS scopes_below_base, count_if(average_excess <= 0) AS scopes_negative_excess FROM (SELECT rule, yr, {_M} FROM ({_GRIDSQL}) GROUP BY rule, yr) GROUP BY rule""",
    ),
)
def rule_stability_by_year(spark, sf):
    df = scored(spark, sf)
    per = ev.selection_metrics(ev.tag(df, grid_rules()), ["rule", "yr"], ev.base_rate(df))
    return ev.stability_flags(per)


@query(
    "sector:s yr:i rows:i precision average_excess",
    covers="AGG-49 AGG-24",
    sql=with_("pp", "SELECT coalesce(sector, 'all') AS sector, coalesce(yr, 0) AS yr, count(*) AS rows, avg(y) AS precision, avg(excess_return) AS average_excess FROM pp WHERE pa >= 0.9 GROUP BY GROUPING SETS ((), (sector), (yr), (sector, yr))"),
)
def segment_analysis(spark, sf):
    return (
        scored(spark, sf).where(A())
        .groupingSets([[], ["sector"], ["yr"], ["sector", "yr"]], "sector", "yr")
        .agg(F.count(F.lit(1)).alias("rows"), F.avg(C("y").cast("double")).alias("precision"), F.avg("excess_return").alias("average_excess"))
        .select(F.coalesce("sector", F.lit("all")).alias("sector"), F.coalesce("yr", F.lit(0)).alias("yr"), "rows", "precision", "average_excess")
    )


@query(
    "rule:s signal_dates:i signals_per_date max_signals_one_date:i date_precision date_excess date_win_rate",
    covers="AGG-25",
    sql=with_(
        "pp",
        f"""SELECT rule, count(*) AS signal_dates, avg(n) AS signals_per_date, max(n) AS max_signals_one_date, avg(p) AS date_precision, avg(x) AS date_excess, avg(w) AS date_win_rate
 FROM (SELECT rule, date, count(*) AS n, avg(y) AS p, avg(excess_return) AS x, avg(CAST(excess_return > 0 AS DOUBLE)) AS w FROM ({_GRIDSQL}) GROUP BY rule, date) GROUP BY rule""",
    ),
)
def date_concentration(spark, sf):
    return ev.date_concentration(ev.tag(scored(spark, sf), grid_rules()), ["rule"])


@query(
    "rule:s signals:i distinct_values:i top_share largest_share largest_value:s herfindahl",
    covers="AGG-25 UDF-6",
    sql=with_(
        "pp",
        f"""SELECT rule, any_value(t) AS signals, count(*) AS distinct_values, sum(CASE WHEN r <= 10 THEN c END) / any_value(t) AS top_share, max(c) / any_value(t) AS largest_share,
  max(CASE WHEN r = 1 THEN symbol END) AS largest_value, sum(pow(c / t, 2)) AS herfindahl FROM (SELECT *, sum(c) OVER (PARTITION BY rule) AS t, row_number() OVER (PARTITION BY rule ORDER BY c DESC, symbol) AS r
  FROM (SELECT rule, symbol, count(*) AS c FROM ({_GRIDSQL}) GROUP BY rule, symbol)) GROUP BY rule""",
    ),
)
def symbol_concentration(spark, sf):
    return ev.concentration(ev.tag(scored(spark, sf), grid_rules()), ["rule"], "symbol")


_EDGES = (0.0, 0.1, 0.4, 0.5, 0.6, 0.8, 1.0)
_BIN = " ".join(
    f"WHEN p >= {a} AND p {'<' if i < 5 else '<='} {b} THEN '{int(round(a * 100))}-{int(round(b * 100))}%'" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:]))
)


@query(
    "bucket:s n:i predicted actual average_excess",
    covers="AGG-27",
    sql=with_(
        "pp",
        f"""SELECT b.bucket, coalesce(n, 0) AS n, predicted, actual, average_excess FROM (SELECT unnest({[f'{int(round(a * 100))}-{int(round(b * 100))}%' for a, b in zip(_EDGES, _EDGES[1:])]}) AS bucket) b
 LEFT JOIN (SELECT CASE {_BIN} END AS bucket, count(*) AS n, avg(p) AS predicted, avg(y) AS actual, avg(excess_return) AS average_excess FROM pp GROUP BY 1) m USING (bucket)""",
    ),
)
def probability_buckets(spark, sf):
    return ev.probability_buckets(scored(spark, sf), "p", _EDGES)


define_cte(
    "calib",
    "SELECT bin, count(*) AS rows, avg(p) AS predicted, avg(y) AS observed FROM (SELECT p, y, len(list_filter(e, lambda x: x < p)) AS bin FROM pp, "
    "(SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM pp)) GROUP BY bin",
    "pp",
)


@query("bin:i rows:i predicted observed mae", covers="AGG-28",
       sql=with_("calib", "SELECT *, (SELECT avg(abs(predicted - observed)) FROM calib) AS mae FROM calib"))
def calibration_curve(spark, sf):
    curve = ev.calibration_curve(scored(spark, sf), "p")
    return with_row(curve, ev.calibration_mae(curve).withColumnRenamed("calibration_mae", "mae"))


@query(
    "fold:i tp:i fp:i fn:i tn:i accuracy precision recall balanced_accuracy f1 log_loss brier",
    covers="AGG-29",
    sql=with_(
        "pp",
        """SELECT *, (recall + spec) / 2 AS balanced_accuracy, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM (
 SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tn / nullif(tn + fp, 0), 0) AS spec FROM (
 SELECT fold, count_if(y = 1 AND h) AS tp, count_if(y = 0 AND h) AS fp, count_if(y = 1 AND NOT h) AS fn, count_if(y = 0 AND NOT h) AS tn,
  avg(-CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END) AS log_loss, avg(pow(p - y, 2)) AS brier FROM (SELECT *, p >= 0.3 AS h, least(greatest(p, 1e-15), 1 - 1e-15) AS q FROM pp) GROUP BY fold))""",
    ),
)
def classification_metrics_by_fold(spark, sf):
    df = scored(spark, sf).withColumn("yhat", (C("p") >= 0.3).cast("int"))
    return ev.classification_metrics(df, "y", "yhat", "p", ["fold"])


@query(
    "actual:i predicted_m1:i predicted_0:i predicted_1:i",
    covers="AGG-29",
    sql=with_("pp", "SELECT label AS actual, count_if(h = -1) AS predicted_m1, count_if(h = 0) AS predicted_0, count_if(h = 1) AS predicted_1 FROM (SELECT *, CASE WHEN pa >= 0.8 THEN 1 WHEN pa <= 0.2 THEN -1 ELSE 0 END AS h FROM pp) GROUP BY label"),
)
def three_class_confusion(spark, sf):
    h = F.when(C("pa") >= 0.8, 1).when(C("pa") <= 0.2, -1).otherwise(0)
    return ev.confusion_matrix(scored(spark, sf).withColumn("h", h), "label", "h", (-1, 0, 1))


@query(
    "fold:i rows:i positives:i pr_auc roc_auc",
    covers="AGG-30",
    sql=with_(
        "pp",
        """SELECT fold, any_value(n) AS rows, any_value(tp) AS positives, sum(pos * hits / done) / any_value(tp) AS pr_auc, sum(pos * (n - tp - (done - hits) + (c - pos) / 2.0)) / (any_value(tp) * (any_value(n) - any_value(tp))) AS roc_auc FROM (
 SELECT *, sum(c) OVER w AS done, sum(pos) OVER w AS hits, sum(c) OVER (PARTITION BY fold) AS n, sum(pos) OVER (PARTITION BY fold) AS tp FROM (SELECT fold, score, count(*) AS c, sum(y) AS pos FROM pp GROUP BY fold, score) WINDOW w AS (PARTITION BY fold ORDER BY score DESC)) GROUP BY fold""",
    ),
)
def ranking_quality_by_fold(spark, sf):
    return ev.ranking_quality(scored(spark, sf), "score", ["fold"])


_LV = (0.2, 0.25, 0.3, 0.4)


@query(
    "level signals:i precision recall",
    covers="WIN-54 AGG-46",
    sql=with_(
        "pp",
        " UNION ALL ".join(
            f"SELECT CAST({x} AS DOUBLE) AS level, coalesce(max(done) FILTER (hits / done >= {x}), 0) AS signals, arg_max(hits / done, done) FILTER (hits / done >= {x}) AS precision, arg_max(hits / tp, done) FILTER (hits / done >= {x}) AS recall FROM lad"
            for x in _LV
        ),
        lad="SELECT sum(c) OVER (ORDER BY score DESC) AS done, sum(pos) OVER (ORDER BY score DESC) AS hits, sum(pos) OVER () AS tp FROM (SELECT score, count(*) AS c, sum(y) AS pos FROM pp GROUP BY score)",
    ),
)
def precision_recall_frontier(spark, sf):
    return ev.prefix_frontier(scored(spark, sf), "score", _LV)


@query(
    "model:s " + _MOUT,
    covers="AGG-46",
    sql=with_(
        "pp",
        f"""SELECT 'baseline' AS model, {_M} FROM pp WHERE pa >= 0.9 UNION ALL SELECT 'candidate', {_M} FROM (SELECT *, row_number() OVER (ORDER BY score_b DESC, symbol, date) AS rn FROM pp) WHERE rn <= (SELECT count(*) FROM pp WHERE pa >= 0.9)""",
    ),
)
def equal_signal_comparison(spark, sf):
    df = scored(spark, sf)
    a = df.where(A()).withColumn("model", F.lit("baseline"))
    b = ev.equal_signal_rows(df, A(), "score_b").drop("position", "group_rows").withColumn("model", F.lit("candidate"))
    return ev.selection_metrics(a.unionByName(b), ["model"])


_SL = {"top10": (0.0, 0.10), "10-25": (0.10, 0.25), "25-50": (0.25, 0.5), "50-75": (0.5, 0.75), "bottom25": (0.75, 1.0)}


@query(
    "slice:s " + _MOUT,
    covers="WIN-55 AGG-42",
    sql=with_("pp", " UNION ALL ".join(
        f"SELECT '{n}' AS slice, {_M} FROM (SELECT *, row_number() OVER (ORDER BY score_b DESC, symbol, date) AS rn, count(*) OVER () AS n FROM pp WHERE pa >= 0.8) WHERE rn > floor(n * CAST({a} AS DOUBLE)) AND rn <= floor(n * CAST({b} AS DOUBLE))"
        for n, (a, b) in _SL.items())),
)
def rank_slices(spark, sf):
    df = scored(spark, sf).where(C("pa") >= 0.8)
    return ev.selection_metrics(ev.rank_slices(df, "score_b", _SL), ["slice"])


@query(
    "bucket:i " + _MOUT + " monotonic_precision:b monotonic_excess:b",
    covers="AGG-42 WIN-43",
    sql=with_(
        "pp",
        """SELECT *, bool_and(ok1) OVER () AS monotonic_precision, bool_and(ok2) OVER () AS monotonic_excess FROM (SELECT *, coalesce(precision >= lag(precision) OVER (ORDER BY bucket), TRUE) AS ok1, coalesce(average_excess >= lag(average_excess) OVER (ORDER BY bucket), TRUE) AS ok2 FROM t)""",
        t=f"SELECT bucket, {_M} FROM (SELECT *, greatest(1, CAST(ceil((rn - 1) * 3.0 / nullif(n - 1, 0)) AS INTEGER)) AS bucket FROM (SELECT *, row_number() OVER (ORDER BY score, symbol, date) AS rn, count(*) OVER () AS n FROM pp)) GROUP BY bucket",
    ),
)
def score_terciles(spark, sf):
    m = ev.selection_metrics(ev.quantile_groups(scored(spark, sf), "score", 3), ["bucket"])
    mono = ev.monotonic(m, "bucket", ["precision", "average_excess"]).select(
        C("precision").alias("monotonic_precision"), C("average_excess").alias("monotonic_excess")
    )
    return with_row(m, mono)


@query(
    "membership:s yr:i rows:i",
    covers="JOIN-10 SET-2",
    sql=with_("pp", "SELECT CASE WHEN pa >= 0.9 AND pb >= 0.8 THEN 'BOTH' WHEN pa >= 0.9 THEN 'A_ONLY' ELSE 'B_ONLY' END AS membership, yr, count(*) AS rows FROM pp WHERE pa >= 0.9 OR pb >= 0.8 GROUP BY ALL"),
)
def selection_membership(spark, sf):
    df = scored(spark, sf)
    m = ev.membership(df.where(A()), df.where(B()), ["date", "symbol"])
    return m.groupBy("membership", F.year("date").alias("yr")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "rows:i pearson spearman top_a:i top_b:i overlap:i jaccard",
    covers="AGG-33 SET-2 JOIN-11",
    sql=with_(
        "pp",
        """SELECT count(*) AS rows, corr(score, score_b) AS pearson, corr(ra, rb) AS spearman, count_if(pa >= 0.9) AS top_a, count_if(pb >= 0.8) AS top_b, count_if(pa >= 0.9 AND pb >= 0.8) AS overlap,
  count_if(pa >= 0.9 AND pb >= 0.8) / count_if(pa >= 0.9 OR pb >= 0.8) AS jaccard FROM (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS ra, rank() OVER (ORDER BY score_b) + (count(*) OVER (PARTITION BY score_b) - 1) / 2.0 AS rb FROM pp)""",
    ),
)
def score_diversity(spark, sf):
    df = scored(spark, sf)
    keys = ["date", "symbol", "fold"]
    wide = df.select(*keys, "score", "pa").join(df.select(*keys, "score_b", "pb"), keys)
    return ev.diversity(wide, "score", "score_b", A(), B())


@query(
    "date:d a_signals:i b_signals:i overlap:i a_precision b_precision result:s",
    covers="AGG-50 AGG-35",
    sql=with_(
        "pp",
        """SELECT *, CASE WHEN a_precision IS NULL AND b_precision IS NULL THEN 'EQUAL' WHEN a_precision IS NULL THEN 'B_BEATS' WHEN b_precision IS NULL THEN 'B_LOSES' WHEN b_precision > a_precision THEN 'B_BEATS' WHEN b_precision < a_precision THEN 'B_LOSES' ELSE 'EQUAL' END AS result
 FROM (SELECT date, count_if(pa >= 0.9) AS a_signals, count_if(pb >= 0.8) AS b_signals, count_if(pa >= 0.9 AND pb >= 0.8) AS overlap, avg(y) FILTER (pa >= 0.9) AS a_precision, avg(y) FILTER (pb >= 0.8) AS b_precision FROM pp GROUP BY date)""",
    ),
)
def per_date_rule_winner(spark, sf):
    return ev.date_winner(scored(spark, sf), A(), B())


@query(
    "a:s b:s rows:i precision average_excess",
    covers="AGG-32",
    sql=with_("pp", "SELECT coalesce(a, 'all') AS a, coalesce(b, 'all') AS b, count(*) AS rows, avg(y) AS precision, avg(excess_return) AS average_excess FROM (SELECT *, CASE WHEN pa >= 0.9 THEN 'high' ELSE 'low' END AS a, CASE WHEN pb >= 0.8 THEN 'high' ELSE 'low' END AS b FROM pp) GROUP BY CUBE (a, b)"),
)
def bucket_interaction(spark, sf):
    return ev.interaction(scored(spark, sf), A(), B())


@query(
    "fold:i rows:i pass_a:i pass_b:i pass_both:i cause:s",
    covers="AGG-47",
    sql=with_(
        "pp",
        """SELECT f.fold, coalesce(rows, 0) AS rows, coalesce(a, 0) AS pass_a, coalesce(b, 0) AS pass_b, coalesce(ab, 0) AS pass_both, CASE WHEN ab > 0 THEN 'OK' WHEN rows IS NULL THEN 'NO_ROWS' WHEN a = 0 THEN 'A_EMPTY' WHEN b = 0 THEN 'B_EMPTY' ELSE 'NO_OVERLAP' END AS cause
 FROM (SELECT DISTINCT year(l_shipdate) - 1994 AS fold FROM lineitem) f LEFT JOIN (SELECT fold, count(*) AS rows, count_if(pa >= 0.97) AS a, count_if(pb >= 0.97) AS b, count_if(pa >= 0.97 AND pb >= 0.97) AS ab FROM pp GROUP BY fold) USING (fold)""",
    ),
)
def fold_selection_funnel(spark, sf):
    folds = sh.bars(spark, sf).select((F.year("date") - 1994).alias("fold")).distinct()
    return ev.fold_funnel(scored(spark, sf), folds, C("pa") >= 0.97, C("pb") >= 0.97)


@query(
    "folds:i precision_improved:i average_excess_improved:i win_rate_improved:i",
    covers="AGG-48",
    sql=with_(
        "pp",
        f"""SELECT count(*) AS folds, count_if(b.precision > a.precision) AS precision_improved, count_if(b.average_excess > a.average_excess) AS average_excess_improved, count_if(b.win_rate > a.win_rate) AS win_rate_improved
 FROM (SELECT fold, {_M} FROM pp WHERE pa >= 0.9 GROUP BY fold) a JOIN (SELECT fold, {_M} FROM pp WHERE pb >= 0.8 GROUP BY fold) b USING (fold)""",
    ),
)
def fold_improvement_counts(spark, sf):
    df = scored(spark, sf)
    a, b = (ev.selection_metrics(df.where(c), ["fold"]) for c in (A(), B()))
    return ev.fold_improvements(b, a, ["precision", "average_excess", "win_rate"])


@query(
    "fold:i " + _MOUT,
    covers="AGG-40",
    sql=with_(
        "pp",
        f"""SELECT fold, {_M} FROM pp JOIN (SELECT fold, date FROM (SELECT fold, date, row_number() OVER (PARTITION BY fold ORDER BY date) AS r FROM (SELECT DISTINCT fold, date FROM pp)) WHERE (r - 1) % 20 = 0) USING (fold, date) WHERE pa >= 0.8 GROUP BY fold""",
    ),
)
def non_overlapping_metrics(spark, sf):
    df = scored(spark, sf)
    sel = ev.non_overlapping(df.where(C("pa") >= 0.8), df.select("fold", "date"), 20)
    return ev.selection_metrics(sel, ["fold"])


@query(
    "rule:s pareto_rank:i",
    covers="TOP-8",
    sql=with_(
        "pp",
        """SELECT a.rule, 1 + count_if(b.rule <> a.rule AND b.precision >= a.precision AND b.signals >= a.signals AND b.average_excess >= a.average_excess AND (b.precision > a.precision OR b.signals > a.signals OR b.average_excess > a.average_excess)) AS pareto_rank
 FROM t a, t b GROUP BY a.rule""",
        t=f"SELECT rule, count(*) AS signals, round(avg(y), 9) AS precision, round(avg(excess_return), 9) AS average_excess FROM ({_GRIDSQL}) GROUP BY rule",
    ),
)
def pareto_ranked_rules(spark, sf):
    m = ev.tag(scored(spark, sf), grid_rules()).groupBy("rule").agg(
        F.count(F.lit(1)).alias("signals"), F.round(F.avg(C("y").cast("double")), 9).alias("precision"),
        F.round(F.avg("excess_return"), 9).alias("average_excess"),
    )
    return ev.pareto_rank(m, "rule", ["precision", "signals", "average_excess"])


define_cte(
    "fc",
    "SELECT symbol, date, 1 AS sample_count, 0 AS seed, score * 10 AS pr, future_stock_return * 100 AS ar FROM pp UNION ALL SELECT symbol, date, 1, 1, score_b * 10, future_stock_return * 100 FROM pp UNION ALL "
    "SELECT symbol, date, 3, 0, (score + score_b) * 5, future_stock_return * 100 FROM pp",
    "pp",
)


@query(
    "sample_count:i forecasts:i unique_dates:i stocks:i seeds:i direction_accuracy_pct balanced_accuracy_pct up_down_calls:i up_down_accuracy_pct return_mae_pp unchanged_mae_pp return_rmse_pp always_up_pct always_down_pct same_direction_pct",
    covers="AGG-36 BT-19 UDF-4",
    sql=with_(
        "fc",
        """SELECT m.*, b.balanced_accuracy_pct, g.same_direction_pct FROM (SELECT sample_count, count(*) AS forecasts, count(DISTINCT date) AS unique_dates, count(DISTINCT symbol) AS stocks, count(DISTINCT seed) AS seeds, avg(CAST(pd = ad AS DOUBLE)) * 100 AS direction_accuracy_pct,
  count_if(pd <> 'SIDEWAYS') AS up_down_calls, avg(CAST(pd = ad AS DOUBLE)) FILTER (pd <> 'SIDEWAYS') * 100 AS up_down_accuracy_pct, avg(abs(pr - ar)) AS return_mae_pp, avg(abs(ar)) AS unchanged_mae_pp, sqrt(avg((pr - ar) * (pr - ar))) AS return_rmse_pp,
  avg(CAST(ad = 'UP' AS DOUBLE)) * 100 AS always_up_pct, avg(CAST(ad = 'DOWN' AS DOUBLE)) * 100 AS always_down_pct FROM d GROUP BY sample_count) m
 JOIN (SELECT sample_count, avg(r) * 100 AS balanced_accuracy_pct FROM (SELECT sample_count, ad, avg(CAST(pd = ad AS DOUBLE)) AS r FROM d GROUP BY ALL) GROUP BY sample_count) b USING (sample_count)
 JOIN (SELECT sample_count, avg(CAST(n = 1 AS DOUBLE)) * 100 AS same_direction_pct FROM (SELECT sample_count, symbol, date, count(DISTINCT pd) AS n FROM d GROUP BY ALL) GROUP BY sample_count) g USING (sample_count)""",
        d="SELECT *, CASE WHEN pr > 5 THEN 'UP' WHEN pr < -5 THEN 'DOWN' ELSE 'SIDEWAYS' END AS pd, CASE WHEN ar > 5 THEN 'UP' WHEN ar < -5 THEN 'DOWN' ELSE 'SIDEWAYS' END AS ad FROM fc",
    ),
)
def forecast_evaluation(spark, sf):
    df = scored(spark, sf)
    runs = F.array(
        F.struct(F.lit(1).alias("sample_count"), F.lit(0).alias("seed"), (C("score") * 10).alias("r")),
        F.struct(F.lit(1).alias("sample_count"), F.lit(1).alias("seed"), (C("score_b") * 10).alias("r")),
        F.struct(F.lit(3).alias("sample_count"), F.lit(0).alias("seed"), ((C("score") + C("score_b")) * 5).alias("r")),
    )
    f = df.select("symbol", "date", (C("future_stock_return") * 100).alias("actual_return_pct"), F.explode(runs).alias("o"))
    f = f.select("symbol", "date", "actual_return_pct", "o.sample_count", "o.seed", C("o.r").alias("predicted_return_pct"))
    return ev.forecast_summary(f.withColumns({
        "predicted_direction": ev.direction(C("predicted_return_pct"), 5.0),
        "actual_direction": ev.direction(C("actual_return_pct"), 5.0),
    }))


_SIG = {"momentum": "score > 0", "reversal": "score_b > 0", "both": "score > 0 AND score_b > 0"}


@query(
    "sector:s experiment:s sample_size:i mean_net median_net win_rate sharpe_proxy z_score q_value",
    covers="AGG-39 RUL-27",
    sql=with_(
        "pp",
        """SELECT *, least(min(pv * m / rk) OVER (ORDER BY rk DESC), 1.0) AS q_value FROM (SELECT *, row_number() OVER (ORDER BY pv, experiment, sector) AS rk, count(*) OVER () AS m FROM (SELECT *, round(exp(-abs(z_score)), 12) AS pv FROM t))""",
        t="SELECT sector, experiment, count(*) AS sample_size, avg(net) AS mean_net, median(net) AS median_net, avg(CAST(net > 0 AS DOUBLE)) AS win_rate, avg(net) / nullif(stddev_samp(net), 0) AS sharpe_proxy, avg(net) * sqrt(count(*)) / nullif(stddev_samp(net), 0) AS z_score FROM ("
        + " UNION ALL ".join(f"SELECT sector, '{n}' AS experiment, future_stock_return - 0.0015 AS net FROM pp WHERE {c}" for n, c in _SIG.items()) + ") GROUP BY sector, experiment",
    ),
)
def signal_sample_evaluation(spark, sf):
    sig = {n: F.expr(c) for n, c in _SIG.items()}
    m = ev.signal_samples(scored(spark, sf), sig, 0.0015, ["sector"])
    # a pseudo p-value both engines can compute; the normal one is add_p_values
    m = m.withColumns({"pv": F.round(F.exp(-F.abs("z_score")), 12), "key": F.concat_ws("|", "experiment", "sector")})
    return ev.benjamini_hochberg(m, "pv", "key")


@query("experiment:s sample_size:i p_value q_value", covers="AGG-39")
def signal_p_values(spark, sf):
    m = ev.signal_samples(scored(spark, sf), {n: F.expr(c) for n, c in _SIG.items()}, 0.0015)
    return ev.benjamini_hochberg(ev.add_p_values(m))


@query(
    "feature:s winner_mean loser_mean difference",
    covers="AGG-43",
    sql=with_("pp", " UNION ALL ".join(
        f"SELECT '{f}' AS feature, avg({f}) FILTER (y = 1) AS winner_mean, avg({f}) FILTER (y = 0) AS loser_mean, avg({f}) FILTER (y = 1) - avg({f}) FILTER (y = 0) AS difference FROM pp WHERE pa >= 0.9"
        for f in ("score", "score_b", "p", "pb"))),
)
def false_positive_profile(spark, sf):
    return ev.winner_profile(scored(spark, sf).where(A()), ["score", "score_b", "p", "pb"])


@query(
    "symbol:s date:d outcome_date:d stock_return bench_return excess",
    covers="JOIN-17 AGG-35",
    sql=with_(
        "pp bars bench",
        f"""SELECT p.symbol, p.date, o.outcome_date, stock_return, bench_return, stock_return - bench_return AS excess FROM (SELECT symbol, date FROM pp WHERE pa >= 0.95) p
 JOIN (SELECT symbol, date, {lead('close', 20)} / close - 1 AS stock_return, {lead('date', 20)} AS outcome_date FROM bars) o USING (symbol, date)
 JOIN (SELECT date, {lead('close', 20, '')} / close - 1 AS bench_return FROM bench) b USING (date) WHERE stock_return - bench_return IS NOT NULL""",
    ),
)
def realised_signal_outcomes(spark, sf):
    sig = scored(spark, sf).where(C("pa") >= 0.95).select("symbol", "date")
    return ev.realised_outcomes(sig, sh.bars(spark, sf), sh.benchmark(spark, sf))


@query(
    "symbol:s date:d steps:i first_ret last_ret total",
    covers="WIN-53 UDF-5",
    sql=with_(
        "bars",
        f"""SELECT symbol, date, 30 AS steps, list_extract(l, 1) AS first_ret, list_extract(l, 30) AS last_ret, list_sum(l) AS total FROM (SELECT symbol, date, list(r) OVER (PARTITION BY symbol ORDER BY date ROWS 29 PRECEDING) AS l, count(r) OVER (PARTITION BY symbol ORDER BY date ROWS 29 PRECEDING) AS c FROM (SELECT symbol, date, {chg('close')} AS r FROM bars)) WHERE c = 30""",
    ),
)
def feature_sequences(spark, sf):
    from barloom.operators.labels import S

    df = sh.bars(spark, sf).withColumns({"r": S.change("close"), "v": C("volume")})
    q = ev.sequences(df.select("symbol", "date", "r", "v"), ["r", "v"], 30)
    at = lambda i: F.element_at(F.element_at("sequence", i), 1)
    return q.select(
        "symbol", "date", F.size("sequence").alias("steps"), at(1).alias("first_ret"), at(30).alias("last_ret"),
        F.aggregate("sequence", F.lit(0.0), lambda acc, x: acc + x[0]).alias("total"),
    )


@query(
    "date:d symbols:i",
    covers="SET-4",
    sql=with_("nbars", "SELECT date, count(DISTINCT symbol) AS symbols FROM nbars GROUP BY date HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM nbars)"),
)
def shared_dates(spark, sf):
    b = nation_weeks(spark, sf)
    per = b.groupBy("date").agg(F.countDistinct("symbol").alias("symbols"))
    return with_row(per, b.agg(F.countDistinct("symbol").alias("_n"))).where(C("symbols") == C("_n"))
