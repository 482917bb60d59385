"""Queries over labels and same-date comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import cross_section as xs
from barloom.operators import features as ft
from barloom.operators import labels as lb
from barloom.operators.order_stats import with_percentiles
from barloom.plans import shapes as sh
from barloom.plans.registry import query
from barloom.plans.shapes import define_cte, with_
from barloom.plans.sqlkit import chg, lag, lead, roll

C = F.col


@query(
    "symbol:s date:d forward_return_5d forward_return_10d forward_return_20d forward_return_60d",
    covers="WIN-38",
    sql=with_(
        "bars",
        "SELECT symbol, date, " + ", ".join(
            f"{lead('open', h + 1)} / {lead('open', 1)} - 1 AS forward_return_{h}d" for h in (5, 10, 20, 60)
        ) + " FROM bars",
    ),
)
def forward_returns(spark, sf):
    return lb.forward_open_returns(sh.bars(spark, sf))


define_cte(
    "fbench",
    f"SELECT date, {lead('close', 20, '')} / close - 1 AS future_bench_return FROM bench",
    "bench",
)
define_cte(
    "lab",
    f"""SELECT *, future_stock_return - future_bench_return AS excess_return,
  CASE WHEN future_stock_return - future_bench_return > 0.05 THEN 1
       WHEN future_stock_return - future_bench_return < -0.05 THEN -1 ELSE 0 END AS label
 FROM (SELECT s.*, {lead('close', 20)} / close - 1 AS future_stock_return FROM sbars s)
 JOIN fbench USING (date) WHERE future_stock_return - future_bench_return IS NOT NULL""",
    "sbars fbench",
)
# Rows with a label and a deterministic score built from past bars only.
define_cte(
    "pred",
    f"""SELECT l.*, CAST(label = 1 AS INTEGER) AS y, m1.score, m1.score_b, year(l.date) AS yr FROM lab l JOIN (
  SELECT symbol, date, {lag('close', 4)} / nullif({lag('close', 26)}, 0) - 1 AS score,
   -({chg('close', 3)}) AS score_b FROM bars) m1 USING (symbol, date)
 WHERE m1.score IS NOT NULL AND m1.score_b IS NOT NULL""",
    "lab bars",
)


def labelled(spark, sf):
    panel, bench = sh.stored_bars(spark, sf)
    return lb.excess_labels(sh.sector_bars(spark, sf, panel), bench)


def predictions(spark, sf, stored=None):
    """Labelled rows with two deterministic scores: 26-4 week momentum and 3-week reversal; from ``stored`` bars, if given."""
    s = lb.S
    panel, bench = stored or sh.stored_bars(spark, sf)
    panel = sh.sector_bars(spark, sf, panel).withColumns(
        {
            "score": lb.ratio(s.lag("close", 4), s.lag("close", 26)) - 1.0,
            "score_b": -s.change("close", 3),
        }
    )
    df = lb.excess_labels(panel, bench)
    return df.where(C("score").isNotNull() & C("score_b").isNotNull()).withColumns(
        {"y": (C("label") == 1).cast("int"), "yr": F.year("date")}
    )


@query(
    "symbol:s date:d future_stock_return future_bench_return excess_return label:i",
    covers="WIN-39 WIN-59",
    sql=with_("lab", "SELECT * FROM lab"),
)
def excess_return_labels(spark, sf):
    return labelled(spark, sf)


@query(
    "symbol:s date:d target_benchmark:s future_peer_return future_peer_excess peer_label:i",
    covers="WIN-40",
    sql=with_(
        "lab sbars",
        """SELECT *, CASE WHEN future_peer_excess > 0.05 THEN 1 WHEN future_peer_excess < -0.05 THEN -1 ELSE 0 END AS peer_label
 FROM (SELECT l.symbol, l.date, CASE WHEN region = 'ASIA' THEN 'ASIA_INDEX' ELSE 'MARKET' END AS target_benchmark,
  CASE WHEN region = 'ASIA' THEN p.r ELSE future_bench_return END AS future_peer_return,
  future_stock_return - CASE WHEN region = 'ASIA' THEN p.r ELSE future_bench_return END AS future_peer_excess
  FROM lab l LEFT JOIN peer p USING (date)) WHERE future_peer_excess IS NOT NULL""",
        peer=f"SELECT date, {lead('close', 20, '')} / close - 1 AS r FROM (SELECT date, avg(close) AS close FROM sbars WHERE region = 'ASIA' GROUP BY date)",
    ),
)
def peer_benchmark_labels(spark, sf):
    asia = sh.sector_bars(spark, sf).where(C("region") == "ASIA")
    peer = asia.groupBy("date").agg(F.avg("close").alias("close"))
    return lb.peer_labels(labelled(spark, sf), peer, "region", "ASIA", "ASIA_INDEX", "MARKET")


@query(
    "symbol:s date:d excess_return quintile_label:i",
    covers="WIN-41",
    sql=with_(
        "lab",
        """SELECT symbol, date, excess_return, CASE WHEN excess_return >= quantile_cont(excess_return, 0.8) OVER w THEN 1
  WHEN excess_return <= quantile_cont(excess_return, 0.2) OVER w THEN -1 ELSE 0 END AS quintile_label
 FROM lab WINDOW w AS (PARTITION BY date)""",
    ),
)
def same_date_quintile_labels(spark, sf):
    return lb.quintile_labels(labelled(spark, sf))


@query(
    "symbol:s date:d future_max_drawdown sell_target_a:i sell_target_b:i sell_target_c:i sell_target_combined:i",
    covers="WIN-42",
    sql=with_(
        "sbars fbench",
        """SELECT *, CASE WHEN (sell_target_a = 1 AND sell_target_b = 1) OR sell_target_c = 1 THEN 1 ELSE 0 END AS sell_target_combined
 FROM (SELECT symbol, date, worst / close - 1 AS future_max_drawdown,
  CASE WHEN fut < -0.05 THEN 1 ELSE 0 END AS sell_target_a,
  CASE WHEN fut < -0.05 AND fut - future_bench_return < 0 THEN 1 ELSE 0 END AS sell_target_b,
  CASE WHEN worst / close - 1 < -0.08 THEN 1 ELSE 0 END AS sell_target_c FROM x JOIN fbench USING (date)
  WHERE fut - future_bench_return IS NOT NULL AND worst IS NOT NULL)""",
        x=f"SELECT symbol, date, close, {lead('close', 20)} / close - 1 AS fut, {roll('min', 'close', 20, 20)} AS worst FROM sbars",
    ),
)
def downside_targets(spark, sf):
    panel = sh.sector_bars(spark, sf)
    s = lb.S
    ahead = s.w.rowsBetween(1, lb.HORIZON)
    panel = panel.withColumn(
        "_worst", F.when(F.count("close").over(ahead) >= lb.HORIZON, F.min("close").over(ahead))
    )
    df = lb.excess_labels(panel, sh.benchmark(spark, sf))
    return lb.downside_flags(df, C("_worst"))


@query(
    "label:i rows:i mean_excess",
    covers="FIL-11",
    sql=with_(
        "lab",
        "SELECT label, count(*) AS rows, avg(excess_return) AS mean_excess FROM lab "
        "WHERE excess_return <= 0.02 OR excess_return > 0.05 GROUP BY label",
    ),
)
def clear_label_cases(spark, sf):
    return lb.clear_cases(labelled(spark, sf)).groupBy("label").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("excess_return").alias("mean_excess")
    )


@query(
    "date:d weight:f8 rows:i",
    covers="WIN-52",
    sql=with_(
        "lab",
        "SELECT date, any_value(w / m) AS weight, count(*) AS rows FROM (SELECT *, avg(w) OVER () AS m FROM ("
        "SELECT date, pow(0.5, date_diff('day', date, max(date) OVER ()) / 365.0) AS w FROM lab)) GROUP BY date",
    ),
)
def time_decay_sample_weights(spark, sf):
    w = lb.time_decay_weights(labelled(spark, sf), 365.0)
    return w.groupBy("date").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("rows"))


@query(
    "symbol:s date:d score_pct excess_pct",
    covers="WIN-26",
    sql=with_(
        "pred",
        """SELECT symbol, date, (rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS score_pct,
 (rank() OVER (PARTITION BY date ORDER BY excess_return) + (count(*) OVER (PARTITION BY date, excess_return) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS excess_pct FROM pred""",
    ),
)
def same_date_percentiles(spark, sf):
    return with_percentiles(
        predictions(spark, sf), ["date"], {"score_pct": "score", "excess_pct": "excess_return"}
    )


_Q = """CASE WHEN count(DISTINCT score) OVER (PARTITION BY date) >= 5 THEN
  greatest(1, coalesce(CAST(ceil((rn - 1) * 5.0 / nullif(n - 1, 0)) AS INTEGER), 1)) END"""
define_cte(
    "rebal",
    "SELECT max(date) AS date FROM (SELECT DISTINCT date FROM bars) GROUP BY date_trunc('month', date)",
    "bars",
)
define_cte(
    "qsample",
    f"""SELECT *, {_Q} AS quantile FROM (SELECT x.*, row_number() OVER (PARTITION BY date ORDER BY score, symbol) AS rn,
  count(*) OVER (PARTITION BY date) AS n FROM (
   SELECT b.symbol, b.date, {", ".join(f"{lead('open', h + 1)} / {lead('open', 1)} - 1 AS forward_return_{h}d" for h in (5, 20))},
   {lag('close', 4)} / nullif({lag('close', 26)}, 0) - 1 AS score FROM bars b) x
  WHERE date IN (SELECT date FROM rebal) AND score IS NOT NULL)""",
    "bars rebal",
)


def research_sample(spark, sf):
    s = lb.S
    panel = lb.forward_open_returns(sh.bars(spark, sf), (5, 20)).withColumn(
        "score", lb.ratio(s.lag("close", 4), s.lag("close", 26)) - 1.0
    )
    dates = xs.rebalance_dates(sh.bars(spark, sf).select("date"))
    return xs.date_buckets(panel.join(dates, "date", "left_semi"), "score", 5)


@query(
    "symbol:s date:d quantile:i",
    covers="WIN-43 BT-1",
    sql=with_("qsample", "SELECT * FROM qsample"),
)
def rebalance_quantile_buckets(spark, sf):
    return research_sample(spark, sf)


@query(
    "horizon:i quantile:s mean_forward_return median_forward_return observations:i",
    covers="AGG-9 BT-8 SET-1",
    sql=with_(
        "qsample",
        """SELECT * FROM t UNION ALL SELECT horizon, 'top_minus_bottom', max(CASE WHEN quantile = '5' THEN mean_forward_return END) - max(CASE WHEN quantile = '1' THEN mean_forward_return END),
  NULL, sum(observations) FROM t GROUP BY horizon""",
        t="""SELECT horizon, CAST(quantile AS VARCHAR) AS quantile, avg(r) AS mean_forward_return, median(r) AS median_forward_return, count(*) AS observations FROM (
  SELECT 5 AS horizon, quantile, forward_return_5d AS r FROM qsample UNION ALL SELECT 20, quantile, forward_return_20d FROM qsample)
 WHERE r IS NOT NULL AND quantile IS NOT NULL GROUP BY ALL""",
    ),
)
def quantile_bucket_returns(spark, sf):
    return xs.bucket_returns(research_sample(spark, sf), (5, 20), 5)


define_cte(
    "ics",
    """SELECT date, corr(rs, ro) AS ic, count(*) AS stocks, year(date) AS year FROM (
  SELECT date, score, rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0 AS rs,
   rank() OVER (PARTITION BY date ORDER BY excess_return) + (count(*) OVER (PARTITION BY date, excess_return) - 1) / 2.0 AS ro
  FROM pred) GROUP BY date HAVING count(*) >= 5 AND count(DISTINCT score) >= 2""",
    "pred",
)


@query("date:d ic stocks:i", covers="BT-9", sql=with_("ics", "SELECT * FROM ics"))
def rank_information_coefficient(spark, sf):
    return xs.rank_ic(predictions(spark, sf), "score", "excess_return")


@query(
    "regime:s year:i mean_ic ic_std periods:i positive_ic_pct ic_ir verdict:s",
    covers="AGG-8 BT-8 WIN-30",
    sql=with_(
        "ics bench",
        """SELECT *, mean_ic / nullif(ic_std, 0) AS ic_ir, CASE WHEN mean_ic >= 0.02 AND positive_ic_pct >= 0.55 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (
 SELECT regime, year, avg(ic) AS mean_ic, stddev_samp(ic) AS ic_std, count(*) AS periods, avg(CAST(ic > 0 AS DOUBLE)) AS positive_ic_pct
 FROM ics JOIN reg USING (date) GROUP BY regime, year)""",
        reg=f"SELECT date, CASE WHEN close > s * 1.02 THEN 'bull' WHEN close < s * 0.98 THEN 'bear' ELSE 'sideways' END AS regime FROM (SELECT *, {roll('avg', 'close', 200, part='')} AS s FROM bench)",
    ),
)
def ic_summary_by_regime_year(spark, sf):
    ic = xs.rank_ic(predictions(spark, sf), "score", "excess_return")
    ic = ic.join(xs.benchmark_regime(sh.benchmark(spark, sf)), "date").withColumn("year", F.year("date"))
    return xs.ic_verdict(xs.summarize_ic(ic, ["regime", "year"]))


@query(
    "k:i dates:i zero_winner_dates:i total_selections:i precision_at_k recall_at_k winner_coverage "
    "average_excess median_excess win_rate actual_winners:i",
    covers="AGG-31 TOP-1",
    sql=with_(
        "pred",
        """SELECT k, count(*) AS dates, sum(CAST(winners = 0 AS INTEGER)) AS zero_winner_dates, sum(sel) AS total_selections,
  avg(hits / k) AS precision_at_k, avg(hits / nullif(winners, 0)) AS recall_at_k, avg(CAST(hits > 0 AS DOUBLE)) AS winner_coverage,
  avg(ae) AS average_excess, median(me) AS median_excess, avg(wr) AS win_rate, sum(winners) AS actual_winners
 FROM (SELECT date, k, any_value(winners) AS winners, sum(y) AS hits, count(*) AS sel, avg(excess_return) AS ae,
   median(excess_return) AS me, avg(CAST(excess_return > 0 AS DOUBLE)) AS wr FROM (
   SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rk, sum(y) OVER (PARTITION BY date) AS winners FROM pred)
  JOIN (SELECT unnest([1, 3, 5, 10]) AS k) ON rk <= k GROUP BY date, k) GROUP BY k""",
    ),
)
def daily_top_k_report(spark, sf):
    return xs.summarize_top_k(
        xs.daily_top_k(predictions(spark, sf), "score", "y", "excess_return", (1, 3, 5, 10))
    )


@query(
    "date:d symbol:s score:f8 kept:s",
    covers="TOP-2 TOP-3",
    sql=with_(
        "pred",
        """SELECT date, symbol, score, 'fraction' AS kept FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rn,
  count(*) OVER (PARTITION BY date) AS n FROM pred) WHERE rn <= greatest(1, ceil(n * 0.05))
 UNION ALL SELECT date, symbol, score, 'percentile' FROM (SELECT *, (rank() OVER (PARTITION BY date ORDER BY score)
  + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS pct FROM pred) WHERE pct >= 1 - 0.03""",
    ),
)
def top_fraction_and_percentile(spark, sf):
    p = predictions(spark, sf)
    a = xs.top_fraction(p, ["date"], "score", 0.05).withColumn("kept", F.lit("fraction"))
    b = xs.top_percentile(p, "score", 0.03).withColumn("kept", F.lit("percentile"))
    cols = ["date", "symbol", "score", "kept"]
    return a.select(*cols).unionByName(b.select(*cols))
