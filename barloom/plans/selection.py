"""Queries over feature selection, two-stage models and the trial log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.operators import features as ft
from barloom.operators import selection as sl
from barloom.operators import trials as tr
from barloom.operators.evaluation import ranking_quality
from barloom.operators.order_stats import with_percentiles
from barloom.plans import features as fp
from barloom.plans import labels as lp
from barloom.plans import shapes as sh
from barloom.plans.registry import REGISTRY, query
from barloom.plans.shapes import with_
from barloom.sources.staging import stage, staging_root

C = F.col
COLUMNS = ft.VARIANTS["advanced"]
CANDIDATES = 0.8


def _groups() -> dict[str, list[str]]:
    """Families of the matrix columns that are ablated as one."""
    start = lambda *p: [f for f in COLUMNS if f.startswith(p)]
    return {
        "averages": start("sma_", "ema_", "price_to_sma_"),
        "beta_and_correlation": start("beta_", "corr_bench_"),
        "breakouts": start("breakout_prev_", "distance_prev_"),
        "market_breadth": start("market_breadth_"),
        "market_regime": start("market_regime_", "bench_"),
        "sector_context": start("sector_"),
        "stock_vs_sector": start("stock_"),
        "volatility": start("volatility_", "atr_", "bb_"),
        "volume": start("volume_", "up_down_volume", "price_return_x", "positive_price_volume"),
    }


def _rows(spark, sf):
    """All columns of the feature matrix with the target; folds are quarters, as the longest window leaves two years."""
    stored = sh.stored_bars(spark, sf)
    labels = lp.predictions(spark, sf, stored).groupBy("symbol", "date").agg(F.collect_list("y").alias("_ys"))
    panel = sh.sector_bars(spark, sf, stored[0])
    # the target joins the narrow bars, so that the wide rows of the matrix meet no join of their size
    matrix = ft.feature_matrix(panel.join(labels, ["symbol", "date"], "left"), stored[1], carry=["_ys"])
    return matrix.withColumn("y", F.explode("_ys")).drop("_ys").withColumn("fold", (F.year("date") - 1994) * 4 + F.quarter("date"))


_SQL_ROWS = f"(SELECT * FROM ({REGISTRY['full_feature_matrix'].sql}) m JOIN ({with_('pp', 'SELECT symbol, date, y, (yr - 1994) * 4 + quarter(date) AS fold FROM pp')}) l USING (symbol, date))"


@query(
    "fold:i feature:s observed:i mean deviation correlation",
    covers="BT-25",
    sql=f"WITH r AS MATERIALIZED {_SQL_ROWS} SELECT fold, feature, count(v) AS observed, avg(v) AS mean, stddev_samp(v) AS deviation, CASE WHEN count(v) = count(*) AND stddev_samp(v) > 1e-6 * sqrt(avg(v * v)) AND stddev_pop(y) > 0 THEN corr(v, y) END AS correlation FROM ("
    + " UNION ALL ".join(f"SELECT fold, y, '{f}' AS feature, {f} AS v FROM r" for f in fp._MATRIX)
    + ") GROUP BY fold, feature",
)
def fold_feature_moments(spark, sf):
    rows = _rows(spark, sf)
    return sl.moment_report(sl.fold_moments(rows, fp._MATRIX, "y"), fp._MATRIX)


def _selected(rows):
    folds = sl.Folds(sl.fold_moments(rows, COLUMNS, "y"), COLUMNS)
    return folds, *sl.select_features(folds, _groups(), ["ret_20d", "ret_60d"])


@query("stage:s step:i feature:s features:i skill:f4 delta:f4 accepted:b", covers="BT-25")
def feature_selection_steps(spark, sf):
    """Group ablation, backward and forward steps over all columns of the matrix and all folds."""
    _, steps, _ = _selected(_rows(spark, sf))
    return spark.createDataFrame([tuple(s.values()) for s in steps], "stage string, step int, feature string, features int, skill double, delta double, accepted boolean")


def _two_stages(spark, sf):
    """Candidates of the first stage with both out-of-fold scores and their mean percentile."""
    rows = stage(_rows(spark, sf), "selection-rows")
    folds, _, chosen = _selected(rows)
    first = folds.score(rows, chosen, "stage1").where("stage1 IS NOT NULL")
    first = stage(with_percentiles(first, ["date"], {"percentile1": "stage1"}), "stage-one")
    candidates = first.where(C("percentile1") >= CANDIDATES)
    inputs = ["stage1", "percentile1", *chosen]
    again = sl.Folds(sl.fold_moments(candidates, inputs, "y"), inputs)
    second = again.score(candidates, inputs, "stage2").where("stage2 IS NOT NULL").select("symbol", "date", "fold", "y", "stage1", "stage2", "percentile1")
    second = with_percentiles(second, ["date"], {"percentile2": "stage2"})
    return stage(second.withColumn("meta", (C("percentile1") + C("percentile2")) / 2), "stage-two")


@query("fold:i score:s candidates:i positives:i pr_auc:f4 roc_auc:f4", covers="BT-25")
def two_stage_quality(spark, sf):
    """How the first stage, the second and their blend order the first stage's candidates, per later fold."""
    rows, out = _two_stages(spark, sf), None
    for name in ("stage1", "stage2", "meta"):
        q = ranking_quality(rows, name, ["fold"]).select("fold", F.lit(name).alias("score"), C("rows").alias("candidates"), "positives", "pr_auc", "roc_auc")
        out = q if out is None else out.unionByName(q)
    return out


GRID = [(k, s) for k in (8, 10, 12) for s in (0.2, 0.25, 0.3)]


@query(
    "trial_hash:s experiment:s payload:s trials:i",
    covers="BT-26 SCA-20",
    sql=with_(
        "folds",
        """SELECT *, sha256(payload) AS trial_hash, count(*) OVER () AS trials FROM (SELECT 'sensitivity' AS experiment, to_json({'config': {'embargo_end': embargo_end, 'fold': CAST(fold AS INTEGER), 'stop_loss': s, 'test_start': test_start, 'top_n': k, 'trailing_stop': CAST(NULL AS DOUBLE)}, 'experiment': 'sensitivity'}) AS payload
 FROM folds, (VALUES (8), (10), (12)) a(k), (VALUES (CAST(0.2 AS DOUBLE)), (CAST(0.25 AS DOUBLE)), (CAST(0.3 AS DOUBLE))) b(s))""",
    ),
)
def logged_trials(spark, sf):
    """Parameter sets of every walk-forward fold, logged in overlapping batches: each stands in the log once."""
    from barloom.functions.frames import with_row
    from barloom.operators import backtest as bt

    folds = bt.walk_forward_folds(sh.benchmark(spark, sf), 2, 6, 20).select("fold", "test_start", "embargo_end")
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("top_n"), F.lit(s).alias("stop_loss")) for k, s in GRID]))
    trials = folds.withColumn("g", grid).select(
        F.lit("sensitivity").alias("experiment"), C("fold").cast("int").alias("fold"), "test_start", "embargo_end", "g.*", F.lit(None).cast("double").alias("trailing_stop"))
    path = f"{staging_root(spark)}/trial-log-{uuid.uuid4().hex}"
    for part in (trials.where("top_n <= 10"), trials.where("top_n >= 10"), trials.union(trials)):
        tr.log_trials(part, path)
    log = tr.trial_log(spark, path)
    return with_row(log, tr.count_trials(log))
