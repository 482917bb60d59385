"""Queries over window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import features as ft
from barloom.plans import shapes as sh
from barloom.plans.registry import query
from barloom.plans.shapes import define_cte, with_
from barloom.plans.sqlkit import chg, div, flag, lag, over, roll, rsi

C = F.col

_rets = ", ".join(f"{chg('close', n)} AS ret_{n}d" for n in ft.RETURN_ROWS)
_smas = ", ".join(f"{roll('avg', 'close', n)} AS sma_{n}" for n in ft.SMA_ROWS)

define_cte(
    "f1",
    f"""SELECT *, {_rets}, {_smas}, {lag('close')} AS prev_close,
  close - {lag('close')} AS delta, high - {lag('high')} AS upm, {lag('low')} - low AS dnm,
  {roll('avg', 'close', 20)} AS mid, {roll('stddev_samp', 'close', 20)} AS sd,
  {div('volume', roll('avg', 'volume', 20))} AS volume_to_avg20,
  {div(roll('avg', 'volume', 5), roll('avg', 'volume', 20))} - 1 AS volume_trend_20d,
  {roll('max', 'high', 20, -1)} AS ph20, {roll('max', 'high', 50, -1)} AS ph50,
  {roll('max', 'high', 100, -1)} AS ph100,
  {roll('max', 'high', 252)} AS hi52, {roll('min', 'low', 252)} AS lo52
 FROM sbars""",
    "sbars",
)
define_cte(
    "f2",
    f"""SELECT *, greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS tr,
  CASE WHEN delta IS NOT NULL THEN greatest(delta, 0) END AS gain,
  CASE WHEN delta IS NOT NULL THEN greatest(-delta, 0) END AS loss,
  CASE WHEN upm > dnm AND upm > 0 THEN upm ELSE 0 END AS pdm,
  CASE WHEN dnm > upm AND dnm > 0 THEN dnm ELSE 0 END AS mdm,
  {roll('stddev_samp', 'ret_1d', 20)} AS volatility_20d,
  {roll('stddev_samp', 'ret_1d', 60)} AS volatility_60d,
  {roll('stddev_samp', 'ret_1d', 120)} AS volatility_120d,
  {div('4 * sd', 'mid')} AS bb_width_20, {div('close - (mid - 2 * sd)', '4 * sd')} AS bb_percent_b_20,
  CASE WHEN ret_1d > 0 THEN volume ELSE 0 END AS upv, CASE WHEN ret_1d < 0 THEN volume ELSE 0 END AS dnv
 FROM f1""",
    "f1",
)
define_cte(
    "f3",
    f"""SELECT *, {roll('avg', 'gain', 14)} AS ag, {roll('avg', 'loss', 14)} AS al,
  {roll('avg', 'tr', 14)} AS atr_14, {roll('avg', 'tr', 50)} AS atr_50,
  {roll('sum', 'pdm', 14)} AS spdm, {roll('sum', 'mdm', 14)} AS smdm,
  {div(roll('sum', 'upv', 20), roll('sum', 'dnv', 20))} AS up_down_volume_ratio_20d,
  {div('bb_width_20', roll('avg', 'bb_width_20', 120))} AS bb_width_to_avg_120d
 FROM f2""",
    "f2",
)
define_cte(
    "f4",
    f"""SELECT *, {rsi('ag', 'al')} AS rsi_14, 100 * {div('spdm', 'atr_14')} AS plus_di_14,
  100 * {div('smdm', 'atr_14')} AS minus_di_14 FROM f3""",
    "f3",
)
define_cte(
    "f5",
    """SELECT *, 100 * abs(plus_di_14 - minus_di_14) / nullif(plus_di_14 + minus_di_14, 0) AS dx FROM f4""",
    "f4",
)
define_cte(
    "feat",
    f"""SELECT *, {roll('avg', 'dx', 14)} AS adx_14,
  {", ".join(f"close / nullif(sma_{n}, 0) - 1 AS price_to_sma_{n}" for n in ft.SMA_ROWS)},
  ret_20d * volume_to_avg20 AS price_return_x_volume_ratio,
  {flag('ret_20d > 0 AND volume_to_avg20 > 1')} AS positive_price_volume_confirmation,
  ret_20d - ret_60d AS momentum_20d_vs_60d, ret_60d - ret_120d AS momentum_60d_vs_120d,
  ret_20d - {lag('ret_20d', 20)} AS momentum_20d_change,
  volatility_20d / nullif(volatility_60d, 0) AS volatility_20d_to_60d,
  atr_14 / nullif(atr_50, 0) AS atr_14_to_atr_50,
  volatility_20d - {lag('volatility_20d', 20)} AS volatility_20d_change,
  close / ph20 - 1 AS distance_prev_20d_high, close / ph50 - 1 AS distance_prev_50d_high,
  close / ph100 - 1 AS distance_prev_100d_high,
  {flag('close > ph20')} AS breakout_prev_20d_high, {flag('close > ph50')} AS breakout_prev_50d_high,
  {flag('close > ph100')} AS breakout_prev_100d_high,
  close / hi52 - 1 AS distance_52w_high, close / lo52 - 1 AS distance_52w_low
 FROM f5""",
    "f5",
)

_bret = ", ".join(f"{chg('bench_close', n)} AS bret_{n}" for n in (1, 20, 60, 120, 252))
define_cte(
    "relb0",
    f"SELECT *, {_bret} FROM (SELECT feat.*, bench.close AS bench_close FROM feat LEFT JOIN bench USING (date))",
    "feat bench",
)


def _pair(fn: str, n: int) -> str:
    f = over(n)
    ok = "CASE WHEN ret_1d IS NOT NULL AND bret_1 IS NOT NULL THEN 1 END"
    return f"CASE WHEN count({ok}) OVER {f} >= {n} THEN {fn}(ret_1d, bret_1) OVER {f} END"


define_cte(
    "relb",
    f"""SELECT *, rs_vs_bench_20d - {lag('rs_vs_bench_20d', 20)} AS relative_momentum_20d_change FROM (
  SELECT *, {", ".join(f"ret_{n}d - bret_{n} AS rs_vs_bench_{n}d" for n in (20, 60, 120, 252))},
  ret_20d - bret_20 - (ret_60d - bret_60) AS relative_momentum_20d_vs_60d,
  {", ".join(f"({_pair('covar_samp', n)}) / nullif({roll('var_samp', 'bret_1', n)}, 0) AS beta_{n}d" for n in (60, 120, 252))},
  {", ".join(f"{_pair('corr', n)} AS corr_bench_{n}d" for n in (20, 60, 120))}
  FROM relb0)""",
    "relb0",
)


@query(
    "date:d market_breadth_above_sma50 market_breadth_above_sma200 "
    "market_breadth_positive_20d_return market_breadth_advance_decline_ratio",
    covers="AGG-3 SRC-3 WIN-1 WIN-2",
    sql=with_(
        "bars",
        f"""SELECT date, avg({flag('close > s50')}) AS market_breadth_above_sma50,
  avg({flag('close > s200')}) AS market_breadth_above_sma200,
  avg({flag('r20 > 0')}) AS market_breadth_positive_20d_return,
  sum({flag('r1 > 0')}) / nullif(sum({flag('r1 < 0')}), 0) AS market_breadth_advance_decline_ratio
 FROM x GROUP BY date""",
        x=f"SELECT date, close, {roll('avg', 'close', 50)} AS s50, {roll('avg', 'close', 200)} AS s200, "
        f"{chg('close', 20)} AS r20, {chg('close', 1)} AS r1 FROM bars",
    ),
)
def market_breadth_by_date(spark, sf):
    return ft.breadth_by_date(sh.bars(spark, sf))


@query(
    "symbol:s date:d open:f8 high:f8 low:f8 close:f8 volume",
    covers="SRC-3 SRC-2",
    sql=with_("bars", "SELECT * FROM bars"),
)
def weekly_bars(spark, sf):
    return sh.bars(spark, sf)


_TECH = [
    *[f"ret_{n}d" for n in ft.RETURN_ROWS], *[f"sma_{n}" for n in ft.SMA_ROWS],
    *[f"price_to_sma_{n}" for n in ft.SMA_ROWS], "rsi_14", "atr_14", "atr_50",
]


@query(
    "symbol:s date:d " + " ".join(_TECH),
    covers="WIN-1 WIN-2 WIN-5 WIN-7",
    sql=with_("feat", "SELECT * FROM feat"),
)
def price_trend_features(spark, sf):
    df = ft.add_trend(ft.add_returns(sh.bars(spark, sf)))
    return ft.add_atr(ft.add_rsi(df))


_DISP = (
    "plus_di_14 minus_di_14 adx_14 volatility_20d volatility_60d volatility_120d bb_width_20 "
    "bb_percent_b_20 volume_to_avg20 volume_trend_20d up_down_volume_ratio_20d "
    "price_return_x_volume_ratio positive_price_volume_confirmation momentum_20d_vs_60d "
    "momentum_60d_vs_120d momentum_20d_change volatility_20d_to_60d atr_14_to_atr_50 "
    "bb_width_to_avg_120d volatility_20d_change distance_prev_20d_high distance_prev_50d_high "
    "distance_prev_100d_high breakout_prev_20d_high breakout_prev_50d_high breakout_prev_100d_high "
    "distance_52w_high distance_52w_low"
)


@query(
    "symbol:s date:d " + _DISP,
    covers="WIN-9 WIN-11 WIN-12 WIN-13 WIN-14 WIN-15 WIN-16",
    sql=with_("feat", "SELECT * FROM feat"),
)
def dispersion_volume_features(spark, sf):
    return ft.technical_features(sh.bars(spark, sf))


@query(
    "symbol:s date:d " + " ".join(
        [f"rs_vs_bench_{n}d" for n in (20, 60, 120, 252)]
        + ["relative_momentum_20d_change", "relative_momentum_20d_vs_60d"]
        + [f"beta_{n}d" for n in (60, 120, 252)] + [f"corr_bench_{n}d" for n in (20, 60, 120)]
    ),
    covers="WIN-17 WIN-18 JOIN-1",
    sql=with_("relb", "SELECT * FROM relb"),
)
def benchmark_relative_features(spark, sf):
    return ft.add_benchmark(ft.add_returns(sh.bars(spark, sf)), sh.benchmark(spark, sf))


define_cte(
    "sect",
    f"""SELECT date, sector, avg(close / first_close) AS close FROM (
  SELECT *, first_value(close) OVER (PARTITION BY symbol ORDER BY date) AS first_close FROM sbars)
 GROUP BY date, sector""",
    "sbars",
)


def _sect(fn, n, x="close"):
    return roll(fn, x, n, part="sector")


define_cte(
    "secf",
    f"""SELECT date, sector, {", ".join(f"sector_ret_{n}d" for n in (20, 60, 120, 252))},
  {", ".join(f"{_sect('stddev_samp', n, 'r')} AS sector_volatility_{n}d" for n in (20, 60, 120))},
  close / hi - 1 AS sector_distance_52w_high, {flag('close > s50')} AS sector_above_sma50,
  {flag('close > s200')} AS sector_above_sma200,
  {rsi('ag', 'al')} AS sector_rsi_14,
  {flag('close > s50 AND s50 > s200 AND sector_ret_60d > 0')} AS sector_regime_bull,
  {flag('close < s50 AND s50 < s200 AND sector_ret_60d < 0')} AS sector_regime_bear,
  {flag('NOT coalesce(close > s50 AND s50 > s200 AND sector_ret_60d > 0, FALSE) AND NOT coalesce(close < s50 AND s50 < s200 AND sector_ret_60d < 0, FALSE)')} AS sector_regime_sideways
 FROM (SELECT *, {_sect('avg', 14, 'gain')} AS ag, {_sect('avg', 14, 'loss')} AS al FROM (
  SELECT *, CASE WHEN delta IS NOT NULL THEN greatest(delta, 0) END AS gain,
   CASE WHEN delta IS NOT NULL THEN greatest(-delta, 0) END AS loss FROM (
   SELECT *, {chg('close', 1, 'sector')} AS r, close - {lag('close', 1, 'sector')} AS delta,
   {", ".join(f"{chg('close', n, 'sector')} AS sector_ret_{n}d" for n in (20, 60, 120, 252))},
   {_sect('avg', 50)} AS s50, {_sect('avg', 200)} AS s200, {_sect('max', 252)} AS hi FROM sect)))""",
    "sect",
)


@query(
    "sector:s date:d sector_ret_20d sector_ret_60d sector_ret_120d sector_ret_252d "
    "sector_volatility_20d sector_volatility_60d sector_volatility_120d sector_distance_52w_high "
    "sector_above_sma50 sector_above_sma200 sector_rsi_14 sector_regime_bull sector_regime_bear "
    "sector_regime_sideways",
    covers="AGG-1 WIN-20 JOIN-2",
    sql=with_("secf", "SELECT * FROM secf"),
)
def sector_series(spark, sf):
    return ft.sector_series_features(ft.equal_weight_sectors(sh.sector_bars(spark, sf)))


define_cte(
    "secrel",
    f"""SELECT r.*, {", ".join(f"sector_ret_{n}d" for n in (20, 60, 120, 252))},
  sector_volatility_20d, sector_volatility_60d,
  {", ".join(f"ret_{n}d - sector_ret_{n}d AS stock_vs_sector_ret_{n}d" for n in (20, 60, 120, 252))},
  volatility_20d / nullif(sector_volatility_20d, 0) - 1 AS stock_volatility_relative_sector_20d,
  volatility_60d / nullif(sector_volatility_60d, 0) - 1 AS stock_volatility_relative_sector_60d,
  distance_52w_high - sector_distance_52w_high AS stock_distance_52w_high_relative_sector,
  {", ".join(f"sector_ret_{n}d AS sector_momentum_{n}d, sector_ret_{n}d - (ret_{n}d - rs_vs_bench_{n}d) AS sector_strength_vs_bench_{n}d" for n in (20, 60, 120))}
 FROM relb r LEFT JOIN secf USING (date, sector)""",
    "relb secf",
)


@query(
    "symbol:s date:d " + " ".join(ft.SECTOR_FEATURES),
    covers="WIN-19 JOIN-2",
    sql=with_("secrel", "SELECT * FROM secrel"),
)
def sector_relative_features(spark, sf):
    panel = sh.sector_bars(spark, sf)
    df = ft.technical_features(panel, sh.benchmark(spark, sf))
    return ft.add_sector_relative(df, ft.sector_series_features(ft.equal_weight_sectors(panel)))


def _b(fn, x, n):
    return roll(fn, x, n, part="")


define_cte(
    "regime",
    f"""SELECT *, {flag('bull')} AS market_regime_bull_trend, {flag('bear')} AS market_regime_bear_trend,
  {flag('bench_volatility_60d > cut')} AS market_regime_high_volatility,
  {flag('NOT coalesce(bull, FALSE) AND NOT coalesce(bear, FALSE) AND NOT coalesce(bench_volatility_60d > cut, FALSE)')} AS market_regime_sideways
 FROM (SELECT *, {_b('quantile_cont({}, 0.75)', 'bench_volatility_60d', 252)} AS cut,
  close > s50 AND s50 > s200 AND bench_ret_60d > 0 AS bull,
  close < s50 AND s50 < s200 AND bench_ret_60d < 0 AS bear
 FROM (SELECT *, {_b('stddev_samp', 'r', 20)} AS bench_volatility_20d,
  {_b('stddev_samp', 'r', 60)} AS bench_volatility_60d,
  {flag('close > s20')} AS bench_above_sma20, {flag('close > s50')} AS bench_above_sma50,
  {flag('close > s200')} AS bench_above_sma200, s50 / s200 - 1 AS bench_sma50_sma200_trend
 FROM (SELECT *, {chg('close', 1, '')} AS r,
  {", ".join(f"{_b('avg', 'close', n)} AS s{n}" for n in (20, 50, 200))},
  {", ".join(f"{chg('close', n, '')} AS bench_ret_{n}d" for n in (20, 60, 120))},
  close / ({_b('max', 'high', 252)}) - 1 AS bench_distance_52w_high FROM bench)))""",
    "bench",
)


@query(
    "date:d bench_above_sma20 bench_above_sma50 bench_above_sma200 bench_sma50_sma200_trend "
    "bench_ret_20d bench_ret_60d bench_ret_120d bench_volatility_20d bench_volatility_60d "
    "bench_distance_52w_high market_regime_bull_trend market_regime_bear_trend "
    "market_regime_high_volatility market_regime_sideways",
    covers="WIN-21",
    sql=with_("regime", "SELECT * FROM regime"),
)
def market_regime(spark, sf):
    return ft.market_regime_features(sh.benchmark(spark, sf), ft.breadth_by_date(sh.bars(spark, sf)))


define_cte(
    "ewm",
    """/*recursive*/ SELECT symbol, rn, date, close, close AS e10, close AS e12, close AS e20, close AS e26,
  close AS e50, close AS e200, CAST(0 AS DOUBLE) AS sig, CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS l,
  high - low AS atr, high, low FROM ewm_in WHERE rn = 1
 UNION ALL
 SELECT b.symbol, b.rn, b.date, b.close, e.e10 + (b.close - e.e10) * 2.0 / 11, e.e12 + (b.close - e.e12) * 2.0 / 13,
  e.e20 + (b.close - e.e20) * 2.0 / 21, e.e26 + (b.close - e.e26) * 2.0 / 27,
  e.e50 + (b.close - e.e50) * 2.0 / 51, e.e200 + (b.close - e.e200) * 2.0 / 201,
  e.sig + (e.e12 + (b.close - e.e12) * 2.0 / 13 - e.e26 - (b.close - e.e26) * 2.0 / 27 - e.sig) * 2.0 / 10,
  CASE WHEN e.g IS NULL THEN greatest(b.close - e.close, 0) ELSE e.g + (greatest(b.close - e.close, 0) - e.g) / 14 END,
  CASE WHEN e.l IS NULL THEN greatest(e.close - b.close, 0) ELSE e.l + (greatest(e.close - b.close, 0) - e.l) / 14 END,
  e.atr + (greatest(b.high - b.low, abs(b.high - e.close), abs(b.low - e.close)) - e.atr) / 14, b.high, b.low
 FROM ewm e JOIN ewm_in b ON b.symbol = e.symbol AND b.rn = e.rn + 1""",
    "ewm_in",
)
sh._CTES["ewm"] = (sh._CTES["ewm"][0].replace("ewm AS MATERIALIZED", "ewm AS"), ("ewm_in",))
define_cte(
    "ewm_in",
    "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM bars",
    "bars",
)


@query(
    "symbol:s date:d ema_10:f4 ema_20:f4 ema_50:f4 ema_200:f4 macd:f4 macd_signal:f4 rsi_wilder_14:f4 atr_wilder_14:f4",
    covers="WIN-3 WIN-4 WIN-6 WIN-8 UDF-2",
    sql=with_(
        "ewm",
        """SELECT symbol, date, e10 AS ema_10, e20 AS ema_20, e50 AS ema_50, e200 AS ema_200,
  e12 - e26 AS macd, sig AS macd_signal,
  CASE WHEN rn >= 15 THEN CASE WHEN l = 0 AND g > 0 THEN 100.0 ELSE 100 - 100 / (1 + g / nullif(l, 0)) END END AS rsi_wilder_14,
  CASE WHEN rn >= 14 THEN atr END AS atr_wilder_14 FROM ewm""",
    ),
)
def recursive_indicators(spark, sf):
    return ft.recursive_features(sh.bars(spark, sf))


@query("symbol:s date:d adx_wilder_14", covers="WIN-10")
def wilder_adx(spark, sf):
    return ft.recursive_features(sh.bars(spark, sf)).select("symbol", "date", "adx_wilder_14")


_V3 = (
    "traded_value median_traded_value_20d median_traded_value_60d traded_value_to_avg20 "
    "intraday_range_pct close_location_value gap_pct abnormal_volume volume_volatility_20d "
    "residual_return_20d residual_return_60d"
)


@query(
    "symbol:s date:d " + _V3,
    covers="WIN-23",
    sql=with_(
        "secrel",
        f"""SELECT *, {roll('median', 'traded_value', 20, need=10)} AS median_traded_value_20d,
  {roll('median', 'traded_value', 60, need=30)} AS median_traded_value_60d,
  traded_value / nullif({roll('avg', 'traded_value', 20, need=10)}, 0) AS traded_value_to_avg20,
  (high - low) / close AS intraday_range_pct,
  CASE WHEN high <> low THEN least(greatest((close - low) / (high - low), 0), 1) END AS close_location_value,
  open / prev_close - 1 AS gap_pct, volume / nullif({roll('avg', 'volume', 20, need=10)}, 0) AS abnormal_volume,
  {roll('stddev_samp', 'vchg', 20, need=10)} AS volume_volatility_20d,
  ret_20d - 0.5 * (ret_20d - rs_vs_bench_20d) - 0.5 * sector_ret_20d AS residual_return_20d,
  ret_60d - 0.5 * (ret_60d - rs_vs_bench_60d) - 0.5 * sector_ret_60d AS residual_return_60d
 FROM (SELECT *, close * volume AS traded_value, {chg('volume')} AS vchg FROM secrel)""",
    ),
)
def stock_specific_features(spark, sf):
    panel = sh.sector_bars(spark, sf)
    df = ft.technical_features(panel, sh.benchmark(spark, sf))
    df = ft.add_sector_relative(df, ft.sector_series_features(ft.equal_weight_sectors(panel)))
    return ft.add_stock_specific(df)


_MATRIX = [
    "ret_20d", "sma_200", "ema_50", "macd_signal", "rsi_14", "adx_14", "bb_width_20", "beta_60d",
    "rs_vs_bench_252d", "stock_vs_sector_ret_60d", "bench_volatility_20d", "market_regime_sideways",
    "market_breadth_above_sma50", "sector_rsi_14",
]


@query(
    "symbol:s date:d close " + " ".join(_MATRIX),
    covers="WIN-22 FIL-10",
    sql=with_(
        "secrel regime ewm",
        """SELECT r.symbol, r.date, r.close, ret_20d, sma_200, e50 AS ema_50, sig AS macd_signal, rsi_14, adx_14,
  bb_width_20, beta_60d, rs_vs_bench_252d, stock_vs_sector_ret_60d, g.bench_volatility_20d,
  g.market_regime_sideways, br.market_breadth_above_sma50, s.sector_rsi_14
 FROM secrel r JOIN ewm e ON e.symbol = r.symbol AND e.date = r.date
 LEFT JOIN regime g ON g.date = r.date LEFT JOIN br ON br.date = r.date
 LEFT JOIN secf s ON s.date = r.date AND s.sector = r.sector
 WHERE ret_252d IS NOT NULL AND sma_200 IS NOT NULL AND adx_14 IS NOT NULL AND bb_percent_b_20 IS NOT NULL
  AND rsi_14 IS NOT NULL AND volume_to_avg20 IS NOT NULL AND distance_52w_high IS NOT NULL
  AND rs_vs_bench_252d IS NOT NULL AND volatility_60d IS NOT NULL AND plus_di_14 IS NOT NULL""",
        br=f"SELECT date, avg({flag('close > s50')}) AS market_breadth_above_sma50 FROM (SELECT date, close, "
        f"{roll('avg', 'close', 50)} AS s50 FROM bars) GROUP BY date",
    ),
)
def full_feature_matrix(spark, sf):
    return ft.feature_matrix(sh.sector_bars(spark, sf), sh.benchmark(spark, sf))
