"""Queries over feed normalisation, flags and quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import features as ft
from barloom.operators import quality as ql
from barloom.plans import labels as lp
from barloom.plans import shapes as sh
from barloom.plans.registry import query
from barloom.plans.shapes import define_cte, with_
from barloom.plans.sqlkit import chg, div, lag, roll, rsi
from barloom.sources.staging import stage

C = F.col
DOY = lambda: F.dayofyear("date")


def raw_feed(spark, sf):
    """A feed with duplicates, zero volume, stale and invalid rows, derived from the bars."""
    b = sh.bars(spark, sf).withColumns({"_pc": ql.S.lag("close"), "_d": DOY()})
    stale = (C("_d") % 22 == 0) & C("_pc").isNotNull()
    b = b.withColumns({c: F.when(stale, C("_pc")).otherwise(C(c)) for c in ql.PRICES})
    b = b.withColumns(
        {
            "volume": F.when(C("_d") % 11 == 0, 0.0).otherwise(C("volume")),
            "high": F.when(C("_d") % 29 == 0, C("low") * 0.9).otherwise(C("high")),
            "seq": F.lit(0),
        }
    )
    again = b.where(C("_d") % 5 == 0).withColumns(
        {"close": C("close") * 1.01, "high": C("high") * 1.02, "seq": F.lit(1)}
    )
    return b.unionByName(again).drop("_pc", "_d")


define_cte(
    "rawf0",
    f"""SELECT symbol, date, 0 AS seq, CASE WHEN st THEN pc ELSE open END AS open, CASE WHEN d % 29 = 0 THEN (CASE WHEN st THEN pc ELSE low END) * 0.9
  ELSE CASE WHEN st THEN pc ELSE high END END AS high, CASE WHEN st THEN pc ELSE low END AS low, CASE WHEN st THEN pc ELSE close END AS close,
  CASE WHEN d % 11 = 0 THEN 0 ELSE volume END AS volume, d FROM (SELECT *, d % 22 = 0 AND pc IS NOT NULL AS st FROM (
  SELECT *, {lag('close')} AS pc, dayofyear(date) AS d FROM bars))""",
    "bars",
)
define_cte(
    "rawf",
    """SELECT symbol, date, seq, open, high, low, close, volume FROM rawf0
 UNION ALL SELECT symbol, date, 1, open, high * 1.02, low, close * 1.01, volume FROM rawf0 WHERE d % 5 = 0""",
    "rawf0",
)
define_cte("rlast", "SELECT * FROM rawf r WHERE seq = (SELECT max(seq) FROM rawf q WHERE q.symbol = r.symbol AND q.date = r.date)", "rawf")


@query(
    "symbol:s date:d open:f8 high:f8 low:f8 close:f8 volume seq:i",
    covers="SRC-3 SET-6",
    sql=with_("rlast", "SELECT * FROM rlast"),
)
def normalized_last_bars(spark, sf):
    feed = raw_feed(spark, sf).withColumnsRenamed({"open": "Open", "close": "adj_close", "high": "High"})
    return ql.keep_last(ql.normalize_bars(feed), ["symbol", "date"], "seq")


@query(
    "symbol:s date:d adj_open:f8 adj_high:f8 adj_low:f8 adjustment_factor:f8",
    covers="SRC-4",
    sql=with_("bars", "SELECT symbol, date, open * f AS adj_open, high * f AS adj_high, low * f AS adj_low, f AS adjustment_factor "
              "FROM (SELECT *, CASE WHEN date < DATE '1998-06-01' THEN 0.5 ELSE 1.0 END AS f FROM bars)"),
)
def adjusted_prices(spark, sf):
    b = sh.bars(spark, sf).withColumn(
        "adj_close", C("close") * F.when(C("date") < F.lit("1998-06-01").cast("date"), 0.5).otherwise(1.0)
    )
    return ql.adjust_prices(b)


@query(
    "symbol:s date:d raw_close:f8 adj_close:f8 volume",
    covers="SRC-5",
    sql=with_(
        "bars",
        """SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.date, b.date) AS date, a.close AS raw_close, b.close AS adj_close, coalesce(a.volume, b.volume) AS volume
 FROM (SELECT * FROM bars WHERE dayofyear(date) % 7 <> 0) a FULL JOIN (SELECT symbol, date, close * 0.5 AS close, volume FROM bars WHERE dayofyear(date) % 6 <> 0) b ON a.symbol = b.symbol AND a.date = b.date""",
    ),
)
def combined_raw_adjusted(spark, sf):
    b = sh.bars(spark, sf)
    adjusted = b.where(DOY() % 6 != 0).withColumns({c: C(c) * 0.5 for c in ql.PRICES})
    return ql.combine_feeds(b.where(DOY() % 7 != 0), adjusted)


@query(
    "symbol:s date:d close:f8",
    covers="SRC-6 ST-1",
    sql=with_("bars", "SELECT symbol, date, CASE WHEN date >= DATE '2000-12-27' THEN close * 1.001 ELSE close END AS close FROM bars"),
)
def incremental_append(spark, sf):
    b = sh.bars(spark, sf)
    cut = F.lit("2001-01-01").cast("date")
    cached = b.where(C("date") <= cut)
    fresh = b.where(C("date") >= F.date_sub(cut, 5)).withColumn("close", C("close") * 1.001)
    return ql.append_incremental(cached, fresh)


_BAD = "(high < low OR open > high OR open < low OR close > high OR close < low OR least(open, high, low, close) <= 0)"
define_cte(
    "flagd",
    f"""SELECT *, zv AND coalesce(open = pc AND high = pc AND low = pc AND close = pc, FALSE) AS stale,
  NOT (dup OR bad OR zv OR (zv AND coalesce(open = pc AND high = pc AND low = pc AND close = pc, FALSE))) AS tradable
 FROM (SELECT *, coalesce(lead(date) OVER w = date, FALSE) AS dup, volume = 0 AS zv, {_BAD} AS bad, lag(close) OVER w AS pc FROM rawf WINDOW w AS (PARTITION BY symbol ORDER BY date, seq))""",
    "rawf",
)


@query(
    "symbol:s date:d seq:i is_duplicate_date:b is_zero_volume:b is_invalid_ohlc:b is_stale_row:b is_tradable_row:b",
    covers="FIL-2 FIL-3 FIL-4",
    sql=with_("flagd", "SELECT symbol, date, seq, dup AS is_duplicate_date, zv AS is_zero_volume, bad AS is_invalid_ohlc, stale AS is_stale_row, tradable AS is_tradable_row FROM flagd"),
)
def row_flags(spark, sf):
    return ql.flag_rows(raw_feed(spark, sf))


@query(
    "symbol:s date:d traded_value avg_traded_value_20d is_zero_volume:b is_stale:b is_tradable:b",
    covers="FIL-1",
    sql=with_(
        "rlast",
        f"""SELECT *, ok AND NOT is_stale AND NOT is_zero_volume AS is_tradable FROM (SELECT symbol, date, tv AS traded_value, {roll('avg', 'tv', 20)} AS avg_traded_value_20d,
  volume <= 0 AS is_zero_volume, volume <= 0 AND coalesce(close - {lag('close')} = 0, FALSE) AS is_stale,
  least(open, high, low, close) > 0 AND high >= greatest(open, close, low) AND low <= least(open, close, high) AS ok FROM (SELECT *, close * volume AS tv FROM rlast))""",
    ),
)
def tradability_flags(spark, sf):
    feed = ql.keep_last(raw_feed(spark, sf), ["symbol", "date"], "seq")
    return ql.tradability(feed)


@query(
    "symbol:s date:d reasons:s segment:i",
    covers="FIL-5 FIL-15",
    sql=with_(
        "rlast",
        """SELECT symbol, date, reasons, sum(CAST(reasons <> '' AS INTEGER)) OVER (PARTITION BY symbol ORDER BY date) AS segment FROM (
  SELECT *, concat_ws('; ', CASE WHEN volume <= 0 THEN 'Zero/negative volume' END, CASE WHEN least(open, high, low, close) <= 0 THEN 'Nonpositive price' END,
   CASE WHEN high < greatest(open, close) OR low > least(open, close) THEN 'Invalid OHLC relationships' END) AS reasons FROM rlast)""",
    ),
)
def validity_segments(spark, sf):
    return ql.segments(ql.keep_last(raw_feed(spark, sf), ["symbol", "date"], "seq"))


@query(
    "symbol:s first_date:d last_date:d raw_rows:i clean_rows:i rows_removed:i zero_volumes:i stale_rows:i duplicate_dates:i invalid_ohlcs:i "
    "max_return min_return moves_gt_20:i moves_gt_30:i moves_gt_50:i median_turnover p10_turnover status:s",
    covers="AGG-16 FIL-17",
    sql=with_(
        "flagd",
        f"""SELECT *, raw_rows - clean_rows AS rows_removed, CASE WHEN clean_rows < 252 THEN 'FAIL' WHEN moves_gt_50 > 0 OR moves_gt_20 > 0 OR raw_rows - clean_rows > 10 OR invalid_ohlcs > 2 THEN 'REVIEW' ELSE 'PASS' END AS status
 FROM (SELECT symbol, min(date) AS first_date, max(date) AS last_date, count(*) AS raw_rows, count_if(zv) AS zero_volumes, count_if(stale) AS stale_rows, count_if(dup) AS duplicate_dates, count_if(bad) AS invalid_ohlcs FROM flagd GROUP BY symbol)
 JOIN (SELECT symbol, count(*) AS clean_rows, max(r) AS max_return, min(r) AS min_return, count_if(abs(r) > 0.2) AS moves_gt_20, count_if(abs(r) > 0.3) AS moves_gt_30, count_if(abs(r) > 0.5) AS moves_gt_50,
  median(close * volume) AS median_turnover, quantile_cont(close * volume, 0.1) AS p10_turnover FROM (SELECT *, {chg('close')} AS r FROM flagd WHERE tradable) GROUP BY symbol) USING (symbol)""",
    ),
)
def symbol_quality_report(spark, sf):
    return ql.quality_report(ql.flag_rows(raw_feed(spark, sf)))


@query(
    "symbol:s date:d daily_return bucket:s classification:s",
    covers="AGG-21",
    sql=with_(
        "bars",
        f"""SELECT symbol, date, r AS daily_return, CASE WHEN abs(r) > 0.5 THEN '>50%' WHEN abs(r) > 0.3 THEN '>30%' ELSE '>20%' END AS bucket,
  CASE WHEN abs(r) > 0.5 OR coalesce(v > 0 AND abs(r) > 8 * v, FALSE) THEN 'suspicious/bad data' WHEN volume = 0 THEN 'likely corporate-action artifact' ELSE 'plausible real market move' END AS classification
 FROM (SELECT *, {roll('stddev_samp', 'r', 60)} AS v FROM (SELECT *, {chg('close')} AS r FROM bars)) WHERE abs(r) > 0.2""",
    ),
)
def extreme_moves(spark, sf):
    return ql.extreme_moves(sh.bars(spark, sf))


@query(
    "symbol:s rows:i missing_dates:i extra_dates:i coverage",
    covers="AGG-20 SET-3",
    sql=with_(
        "bars",
        """SELECT symbol, count(*) AS rows, (SELECT count(*) FROM cal) - count(c.date) AS missing_dates, count(*) - count(c.date) AS extra_dates, count(c.date) / (SELECT count(*) FROM cal) AS coverage
 FROM bars b LEFT JOIN cal c USING (date) GROUP BY symbol""",
        cal="SELECT DISTINCT date FROM bars WHERE dayofyear(date) % 13 <> 0",
    ),
)
def calendar_alignment(spark, sf):
    b = sh.bars(spark, sf)
    return ql.calendar_alignment(b, b.where(DOY() % 13 != 0))


_FEATS = ("ret_20d", "volatility_20d", "rsi_14", "volume_to_avg20")
define_cte("flong", "UNPIVOT INCLUDE NULLS (SELECT symbol, date, ret_20d, volatility_20d, rsi_14, volume_to_avg20 FROM feat) ON ret_20d, volatility_20d, rsi_14, volume_to_avg20 INTO NAME feature VALUE value", "feat")
sh._CTES["flong"] = (sh._CTES["flong"][0].replace("UNPIVOT INCLUDE NULLS (SELECT", "SELECT symbol, date, feature, value FROM (SELECT").replace(
    "FROM feat) ON ret_20d, volatility_20d, rsi_14, volume_to_avg20 INTO NAME feature VALUE value",
    "FROM feat) UNPIVOT INCLUDE NULLS (value FOR feature IN (ret_20d, volatility_20d, rsi_14, volume_to_avg20))"), ("feat",))


def feature_rows(spark, sf):
    df = ft.add_returns(sh.bars(spark, sf))
    df = ft.add_volume(ft.add_volatility(ft.add_rsi(df)))
    # moments, quantiles and outliers read the rows: the windows run once
    return ql.unpivot(stage(df.select("symbol", "date", *_FEATS), "features"), ["symbol", "date"], _FEATS)


@query(
    "feature:s rows:i missing_pct mean std p01 p05 median p95 p99 iqr_outliers:i z_outliers:i",
    covers="AGG-17",
    sql=with_(
        "flong",
        """SELECT s.*, o.iqr_outliers, o.z_outliers FROM s JOIN (SELECT feature, count_if(q3 > q1 AND (value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1))) AS iqr_outliers,
  count_if(std > 0 AND abs(value - mean) > 5 * std) AS z_outliers FROM flong JOIN s USING (feature) GROUP BY feature) o USING (feature)""",
        s="SELECT feature, count(*) AS rows, avg(CAST(value IS NULL AS DOUBLE)) AS missing_pct, avg(value) AS mean, stddev_samp(value) AS std, "
        + ", ".join(f"quantile_cont(value, {p}) AS {n}" for n, p in (("p01", 0.01), ("p05", 0.05), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("p95", 0.95), ("p99", 0.99)))
        + " FROM flong GROUP BY feature",
    ),
)
def feature_quality(spark, sf):
    return ql.feature_quality(feature_rows(spark, sf))


_SPLIT = "CASE WHEN date < DATE '1999-01-01' THEN 'train' WHEN date < DATE '2000-07-01' THEN 'validation' ELSE 'final_test' END"


def split_name():
    d = lambda t: F.lit(t).cast("date")
    return F.when(C("date") < d("1999-01-01"), "train").when(
        C("date") < d("2000-07-01"), "validation").otherwise("final_test")


@query(
    "feature:s train_mean validation_mean final_test_mean train_median validation_median final_test_median train_missing validation_missing "
    "final_test_missing validation_shift final_test_shift max_abs_shift",
    covers="AGG-19",
    sql=with_(
        "flong",
        """SELECT *, (validation_mean - train_mean) / sd AS validation_shift, (final_test_mean - train_mean) / sd AS final_test_shift,
  greatest(abs((validation_mean - train_mean) / sd), abs((final_test_mean - train_mean) / sd)) AS max_abs_shift
 FROM (SELECT feature, stddev_samp(value) AS sd, """ + ", ".join(
            f"avg(value) FILTER (split = '{s}') AS {s}_mean, median(value) FILTER (split = '{s}') AS {s}_median, avg(CAST(value IS NULL AS DOUBLE)) FILTER (split = '{s}') AS {s}_missing"
            for s in ("train", "validation", "final_test")
        ) + f" FROM (SELECT *, {_SPLIT} AS split FROM flong) GROUP BY feature)",
    ),
)
def feature_drift(spark, sf):
    return ql.drift_report(feature_rows(spark, sf).withColumn("split", split_name()))


@query(
    "scope:s scope_value:s rows:i outperform_pct neutral_pct underperform_pct mean_excess median_excess",
    covers="AGG-18",
    sql=with_(
        "lab",
        """SELECT CASE WHEN grouping(yr) = 0 THEN 'by_year' WHEN grouping(sector) = 0 THEN 'by_sector' WHEN grouping(split) = 0 THEN 'by_split' ELSE 'overall' END AS scope,
  coalesce(CAST(yr AS VARCHAR), sector, split, 'all') AS scope_value, count(*) AS rows, avg(CAST(label = 1 AS DOUBLE)) AS outperform_pct, avg(CAST(label = 0 AS DOUBLE)) AS neutral_pct,
  avg(CAST(label = -1 AS DOUBLE)) AS underperform_pct, avg(excess_return) AS mean_excess, median(excess_return) AS median_excess
 FROM (SELECT *, year(date) AS yr, """ + _SPLIT + """ AS split FROM lab) GROUP BY GROUPING SETS ((), (yr), (sector), (split))""",
    ),
)
def label_distribution(spark, sf):
    rows = lp.labelled(spark, sf).select("date", "sector", "label", "excess_return")
    return ql.label_distribution(
        stage(rows, "labels"),
        {"overall": None, "by_year": F.year("date"), "by_sector": C("sector"), "by_split": split_name()},
    )


@query(
    "symbol:s flagged_rows:i stale_rows:i retained_rows:i status:s",
    covers="AGG-52",
    sql=with_(
        "flagd",
        """SELECT *, CASE WHEN retained_rows > 0 THEN 'REVIEW_RETAINED' WHEN stale_rows > 0 THEN 'EXCLUDED_STALE' ELSE 'EXCLUDED' END AS status FROM (
  SELECT symbol, count(*) AS flagged_rows, count_if(stale) AS stale_rows, count_if(dayofyear(date) % 29 = 0) AS retained_rows FROM flagd WHERE (stale OR bad OR zv) AND seq = 0 GROUP BY symbol)""",
    ),
)
def retained_anomalies(spark, sf):
    feed = raw_feed(spark, sf).where(C("seq") == 0)
    dataset = sh.bars(spark, sf).where(DOY() % 29 == 0)
    return ql.retained_anomalies(ql.flag_rows(raw_feed(spark, sf)).where(C("seq") == 0), dataset)


@query(
    "rows:i symbols:i mean_close",
    covers="FIL-6",
    sql=with_(
        "bars",
        """SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, avg(close) AS mean_close FROM bars b WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE e.symbol = b.symbol AND b.date BETWEEN e.s AND e.e)""",
        ev="SELECT symbol, max(date) - 30 AS s, max(date) + 10 AS e FROM bars WHERE close = high AND volume >= 100 GROUP BY symbol",
    ),
)
def event_window_exclusion(spark, sf):
    b = sh.bars(spark, sf)
    ev = b.where((C("close") == C("high")) & (C("volume") >= 100)).groupBy("symbol").agg(
        F.date_sub(F.max("date"), 30).alias("start"), F.date_add(F.max("date"), 10).alias("end")
    )
    return ql.exclude_event_windows(b, ev).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("symbol").alias("symbols"), F.avg("close").alias("mean_close")
    )


@query(
    "feature:s mean_variance varying_dates_pct is_flat:b",
    covers="AGG-41",
    sql=with_(
        "bars bench",
        """SELECT feature, avg(v) AS mean_variance, avg(CAST(hi > lo AS DOUBLE)) AS varying_dates_pct, avg(CAST(hi > lo AS DOUBLE)) = 0 AS is_flat FROM (
  SELECT date, feature, var_samp(value) AS v, min(value) AS lo, max(value) AS hi FROM (SELECT date, 'close' AS feature, close AS value FROM bars UNION ALL SELECT b.date, 'bench_close', n.close FROM bars b JOIN bench n USING (date)) GROUP BY date, feature) GROUP BY feature""",
    ),
)
def within_date_variance(spark, sf):
    b = sh.bars(spark, sf).join(
        sh.benchmark(spark, sf).select("date", C("close").alias("bench_close")), "date"
    )
    return ql.within_date_variance(ql.unpivot(b, ["symbol", "date"], ["close", "bench_close"]))
