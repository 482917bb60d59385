"""Queries of the portfolio backtest."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import backtest as bt
from barloom.operators import performance as pf
from barloom.operators import signals as sg
from barloom.plans import labels as lp
from barloom.plans import shapes as sh
from barloom.plans.registry import query
from barloom.plans.shapes import define_cte, with_
from barloom.plans.sqlkit import chg, lag, roll
from barloom.sources.staging import stage

C = F.col
CFG = bt.Strategy(trailing_stop=0.30, stop_loss=0.25, min_traded_value=1000.0, circuit=3.0)
LS = bt.Strategy(trailing_stop=0.30, stop_loss=0.25, min_traded_value=1000.0, circuit=3.0, long_short=True, top_n=6, bottom_n=6)

define_cte(
    "bdata",
    f"""SELECT *, {roll('avg', 'tv', 20)} AS atv, {roll('stddev_samp', 'r', 20)} AS vol FROM (SELECT s.*, close * volume AS tv, {chg('close')} AS r, {lag('close')} AS prev_close,
  {lag('close', 4)} / nullif({lag('close', 26)}, 0) - 1 AS score FROM sbars s)""",
    "sbars",
)
define_cte(
    "sched",
    """SELECT signal_date, entry_date, exit_date, period_no FROM (SELECT date AS signal_date, nx AS entry_date, lead(nx) OVER (ORDER BY date) AS exit_date, row_number() OVER (ORDER BY date) AS period_no FROM (
  SELECT date, lead(date) OVER (ORDER BY date) AS nx FROM bench) WHERE date IN (SELECT max(date) FROM bench GROUP BY date_trunc('month', date))) WHERE entry_date IS NOT NULL AND exit_date IS NOT NULL""",
    "bench",
)


def _weights_sql(n, budget, side, asc):
    # equal raw weights: the k-th pick of a sector gets what is left of the sector cap
    v = f"least({budget} / n, 0.15)"
    return f"""SELECT signal_date, symbol, sector, {side} AS side, least({v}, greatest(0, 0.35 - (k - 1) * {v})) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY signal_date, sector ORDER BY rk) AS k, count(*) OVER (PARTITION BY signal_date) AS n FROM (
  SELECT d.date AS signal_date, d.symbol, d.sector, row_number() OVER (PARTITION BY d.date ORDER BY score {asc}, d.symbol) AS rk FROM bdata d JOIN sched s ON s.signal_date = d.date WHERE score IS NOT NULL AND volume > 0 AND atv >= 1000) WHERE rk <= {n})
 WHERE least({v}, greatest(0, 0.35 - (k - 1) * {v})) > 1e-9"""


define_cte("wts", _weights_sql(10, "1.0", 1, "DESC"), "bdata sched")
define_cte("wls", _weights_sql(6, "0.5", 1, "DESC") + " UNION ALL " + _weights_sql(6, "0.5", -1, "ASC"), "bdata sched")

_COST = "({n} * ({tax} / 1e4) + {n} * (0.297 / 1e4) + {n} * (0.01 / 1e4) + ({n} * (0.297 / 1e4) + {n} * (0.01 / 1e4)) * 0.18 + {n} * ({stamp} / 1e4) + {n} * 5.0 / 1e4)"


def _trades_sql(w):
    buy = _COST.format(n="{n}", tax="10.0", stamp="1.5")
    sell = _COST.format(n="{n}", tax="10.0", stamp="0.0")
    n0, n1 = "(weight * 1e6)", "(weight * 1e6 * greatest(0, 1 + gross_return))"
    return f"""SELECT *, gross_return - cost_fraction / weight AS net_return, weight * gross_return AS gross_contribution, weight * gross_return - cost_fraction AS net_contribution, date_diff('day', entry_date, exit_date) AS holding_days FROM (
 SELECT *, CASE WHEN side > 0 THEN {buy.format(n=n0)} + {sell.format(n=n1)} ELSE {sell.format(n=n0)} + {buy.format(n=n1)} END / 1e6 AS cost_fraction FROM (
 SELECT *, side * (exit_price / nullif(entry_price, 0) - 1) AS gross_return FROM (
 SELECT symbol, signal_date, entry_date, period_no, any_value(side) AS side, any_value(weight) AS weight, any_value(sector) AS sector,
  CASE WHEN max(eo) IS NULL THEN 'missing_entry_bar' WHEN bool_or(date = entry_date AND high = low AND abs(coalesce(open / nullif(prev_close, 0) - 1, 0)) >= 3 * 0.95) THEN 'untradable_entry' END AS skip_reason,
  CASE WHEN max(eo) IS NOT NULL THEN max(eo) END AS entry_price,
  coalesce(arg_min(fill, date) FILTER (hit), arg_max(open, date) FILTER (open IS NOT NULL)) AS exit_price, coalesce(min(date) FILTER (hit), max(date) FILTER (open IS NOT NULL)) AS exit_date,
  coalesce(arg_min(why, date) FILTER (hit), 'rebalance') AS exit_reason FROM (
  SELECT *, later AND CASE WHEN side > 0 THEN low <= stop ELSE high >= stop END AS hit, CASE WHEN side > 0 THEN least(open, stop) ELSE greatest(open, stop) END AS fill, CASE WHEN stop = fixed THEN 'stop_loss' ELSE 'trailing_stop' END AS why FROM (
   SELECT *, CASE WHEN side > 0 THEN greatest(fixed, greatest(eo, peak) * (1 - 0.30)) ELSE least(fixed, least(eo, trough) * (1 + 0.30)) END AS stop FROM (
    SELECT *, CASE WHEN side > 0 THEN eo * (1 - 0.25) ELSE eo * (1 + 0.25) END AS fixed, max(CASE WHEN later THEN high END) OVER (PARTITION BY symbol, signal_date ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak,
     min(CASE WHEN later THEN low END) OVER (PARTITION BY symbol, signal_date ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS trough FROM (
     SELECT w.*, s.entry_date, s.period_no, c.date, d.open, d.high, d.low, d.prev_close, max(CASE WHEN c.date = s.entry_date THEN d.open END) OVER (PARTITION BY w.symbol, w.signal_date) AS eo, c.date > s.entry_date AND d.open IS NOT NULL AS later
     FROM {w} w JOIN sched s USING (signal_date) JOIN (SELECT date FROM bench) c ON c.date BETWEEN s.entry_date AND s.exit_date LEFT JOIN bdata d ON d.symbol = w.symbol AND d.date = c.date))))
  GROUP BY symbol, signal_date, entry_date, period_no)))"""


define_cte("trd", _trades_sql("wts"), "wts sched bench bdata")
define_cte("trls", _trades_sql("wls"), "wls sched bench bdata")


def _periods_sql(t):
    return f"""SELECT a.*, s.entry_date, s.exit_date, s.period_no, coalesce(b2.open / b1.open - 1, 0) AS benchmark_return, (u.n - u.both_) / greatest(1, 2 * u.n) AS turnover FROM (
 SELECT signal_date, sum(gross_contribution) AS gross_return, sum(net_contribution) AS net_return, count(*) AS positions, sum(weight) AS gross_exposure, sum(side * weight) AS net_exposure, row_number() OVER (ORDER BY signal_date) AS i FROM {t} WHERE skip_reason IS NULL GROUP BY signal_date) a
 JOIN sched s USING (signal_date) LEFT JOIN bench b1 ON b1.date = s.entry_date LEFT JOIN bench b2 ON b2.date = s.exit_date
 JOIN (SELECT coalesce(x.i, y.i) AS i, count(*) AS n, count_if(x.i IS NOT NULL AND y.i IS NOT NULL) AS both_ FROM h_{t} x FULL JOIN (SELECT symbol, i + 1 AS i FROM h_{t}) y ON x.symbol = y.symbol AND x.i = y.i GROUP BY 1) u ON u.i = a.i"""


for _t in ("trd", "trls"):
    define_cte(f"h_{_t}", f"SELECT symbol, dense_rank() OVER (ORDER BY signal_date) AS i FROM {_t} WHERE skip_reason IS NULL", _t)
define_cte("per", _periods_sql("trd"), "trd h_trd sched bench")
define_cte("perls", _periods_sql("trls"), "trls h_trls sched bench")


def _run(spark, sf, cfg=CFG):
    bench = sh.benchmark(spark, sf)
    sched = bt.schedule(bench, cfg.frequency)
    data = bt.prepare(sh.sector_bars(spark, sf), sg.get_signal("momentum_weekly"))
    w = bt.weights(bt.select(data, sched, cfg), cfg)
    trades = bt.simulate(w, data, bt.period_sessions(sched, bench), cfg)
    return trades, sched, bench


def _staged(spark, sf, cfg=CFG):
    trades, sched, bench = _run(spark, sf, cfg)
    trades = stage(trades, "trades")
    return trades, bt.periods(trades, sched, bench), bench


@query(
    "signal_date:d entry_date:d exit_date:d period_no:i",
    covers="BT-1 JOIN-9",
    sql=with_("sched", "SELECT * FROM sched"),
)
def rebalance_schedule(spark, sf):
    return bt.schedule(sh.benchmark(spark, sf))


@query(
    "week_end:d last_session:d",
    covers="BT-1",
    sql="SELECT max(d) AS last_session, CAST(date_trunc('week', d + 2) AS DATE) + 4 AS week_end FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem) GROUP BY 2",
)
def weekly_rebalance_dates(spark, sf):
    from barloom.operators.cross_section import rebalance_dates
    from barloom.sources.tables import read

    days = read(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return rebalance_dates(days, "weekly").select(
        F.next_day(F.date_sub("date", 1), "FRI").alias("week_end"), C("date").alias("last_session")
    )


@query(
    "signal_date:d symbol:s side:i weight:f8",
    covers="BT-2 UDF-3 TOP-1",
    sql=with_("wls", "SELECT * FROM wls"),
)
def long_short_weights(spark, sf):
    bench = sh.benchmark(spark, sf)
    data = bt.prepare(sh.sector_bars(spark, sf), sg.get_signal("momentum_weekly"))
    return bt.weights(bt.select(data, bt.schedule(bench), LS), LS)


_T = ("symbol:s signal_date:d side:i weight skip_reason:s entry_price:f4 exit_price:f4 exit_date:d exit_reason:s gross_return cost_fraction:f8 "
      "net_return net_contribution holding_days:i")
_TS = "SELECT * REPLACE (CASE WHEN skip_reason IS NULL THEN {0} END AS {0}) FROM {{t}}"
_SKIP = "SELECT symbol, signal_date, side, weight, skip_reason, " + ", ".join(
    f"CASE WHEN skip_reason IS NULL THEN {c} END AS {c}" for c in
    "entry_price exit_price exit_date exit_reason gross_return cost_fraction net_return net_contribution holding_days".split()
) + " FROM {t}"


@query(_T, covers="BT-3 BT-4 BT-5", sql=with_("trd", _SKIP.format(t="trd")))
def backtest_trades(spark, sf):
    return _run(spark, sf)[0]


@query(_T, covers="BT-3 BT-4 BT-5", sql=with_("trls", _SKIP.format(t="trls")))
def backtest_trades_long_short(spark, sf):
    return _run(spark, sf, LS)[0]


_P = "signal_date:d entry_date:d exit_date:d gross_return net_return benchmark_return positions:i turnover gross_exposure net_exposure"


@query(_P, covers="BT-5 BT-6 SET-5", sql=with_("per", "SELECT * FROM per"))
def backtest_periods(spark, sf):
    return _staged(spark, sf)[1]


@query(_P, covers="BT-5 BT-6 SET-5", sql=with_("perls", "SELECT * FROM perls"))
def backtest_periods_long_short(spark, sf):
    return _staged(spark, sf, LS)[1]


define_cte(
    "eqc",
    """SELECT *, round(portfolio_equity / max(portfolio_equity) OVER (ORDER BY signal_date) - 1, 12) AS drawdown FROM (
  SELECT *, exp(sum(ln(1 + net_return)) OVER (ORDER BY signal_date)) AS portfolio_equity, exp(sum(ln(1 + gross_return)) OVER (ORDER BY signal_date)) AS gross_equity, exp(sum(ln(1 + benchmark_return)) OVER (ORDER BY signal_date)) AS benchmark_equity FROM per)""",
    "per",
)


# The derived prices swing so wildly that equity grows beyond 1e12; its logarithm is compared.
@query(
    "signal_date:d log_portfolio_equity log_gross_equity log_benchmark_equity drawdown",
    covers="WIN-44",
    sql=with_("eqc", "SELECT signal_date, ln(portfolio_equity) AS log_portfolio_equity, ln(gross_equity) AS log_gross_equity, ln(benchmark_equity) AS log_benchmark_equity, drawdown FROM eqc"),
)
def equity_and_drawdown(spark, sf):
    e = pf.equity(_staged(spark, sf)[1])
    return e.withColumns({f"log_{c}": F.log(c) for c in ("portfolio_equity", "gross_equity", "benchmark_equity")})


@query(
    "periods:i trades:i log_total_return log_gross_total_return log_benchmark_total_return cagr annualized_volatility sharpe sortino calmar max_drawdown "
    "max_drawdown_periods:i win_rate average_win average_loss profit_factor expectancy average_turnover average_holding_days average_exposure "
    "alpha_annualized beta periods_per_year deflated_statistic",
    covers="AGG-10 AGG-13 AGG-14 AGG-15 WIN-45",
    sql=with_(
        "eqc trd",
        """SELECT *, CASE WHEN max_drawdown < 0 THEN cagr / abs(max_drawdown) ELSE 0 END AS calmar, (m - beta * bm) * periods_per_year AS alpha_annualized,
  (sharpe / sqrt(periods_per_year)) / sqrt((1 - sk * (sharpe / sqrt(periods_per_year)) + (ku + 3 - 1) / 4 * pow(sharpe / sqrt(periods_per_year), 2)) / (periods - 1)) AS deflated_statistic
 FROM (SELECT *, ln(eq) AS log_total_return, ln(geq) AS log_gross_total_return, ln(beq) AS log_benchmark_total_return, pow(eq, 1 / years) - 1 AS cagr, sd * sqrt(periods_per_year) AS annualized_volatility, m / sd * sqrt(periods_per_year) AS sharpe,
  m / dn * sqrt(periods_per_year) AS sortino, geq - eq AS net_cost_drag, cov / var AS beta FROM (
  SELECT count(*) AS periods, avg(net_return) AS m, stddev_samp(net_return) AS sd, stddev_samp(CASE WHEN net_return < 0 THEN net_return END) AS dn, arg_max(portfolio_equity, signal_date) AS eq, arg_max(gross_equity, signal_date) AS geq, arg_max(benchmark_equity, signal_date) AS beq,
   min(drawdown) AS max_drawdown, greatest(date_diff('day', min(exit_date), max(exit_date)) / 365.25, 1 / 252) AS years, 365.25 / greatest(median(gap), 1) AS periods_per_year, avg(turnover) AS average_turnover, avg(gross_exposure) AS average_exposure,
   covar_samp(net_return, benchmark_return) AS cov, var_samp(benchmark_return) AS var, avg(benchmark_return) AS bm, skewness(net_return) AS sk, kurtosis(net_return) AS ku FROM (SELECT *, date_diff('day', lag(exit_date) OVER (ORDER BY signal_date), exit_date) AS gap FROM eqc)),
  (SELECT count(*) AS trades, avg(CAST(net_return > 0 AS DOUBLE)) AS win_rate, avg(net_return) FILTER (net_return > 0) AS average_win, avg(net_return) FILTER (net_return < 0) AS average_loss, sum(net_return) FILTER (net_return > 0) / -sum(net_return) FILTER (net_return < 0) AS profit_factor,
   avg(net_return) AS expectancy, avg(holding_days) AS average_holding_days FROM trd WHERE skip_reason IS NULL),
  (SELECT max(n) AS max_drawdown_periods FROM (SELECT g, count_if(drawdown < 0) AS n FROM (SELECT *, sum(CAST(drawdown >= 0 AS INTEGER)) OVER (ORDER BY signal_date) AS g FROM eqc) GROUP BY g)))""",
    ),
)
def performance_metrics(spark, sf):
    trades, periods, _ = _staged(spark, sf)
    m = pf.performance(stage(periods, "periods"), trades)
    names = ("total_return", "gross_total_return", "benchmark_total_return")
    return m.withColumns({f"log_{c}": F.log1p(c) for c in names})


@query(
    "signal_date:d rolling_sharpe",
    covers="WIN-46",
    sql=with_("per", f"SELECT signal_date, ({roll('avg', 'net_return', 12, part='', order='signal_date')}) / ({roll('stddev_samp', 'net_return', 12, part='', order='signal_date')}) * sqrt(12) AS rolling_sharpe FROM per"),
)
def rolling_sharpe(spark, sf):
    return pf.rolling_sharpe(_staged(spark, sf)[1], 12, 12.0)


@query(
    "year:i " + " ".join(f"m{i:02d}" for i in range(1, 13)),
    covers="AGG-11",
    sql=with_("per", "SELECT year(exit_date) AS year, " + ", ".join(
        f"exp(sum(ln(1 + net_return)) FILTER (month(exit_date) = {i})) - 1 AS m{i:02d}" for i in range(1, 13)) + " FROM per GROUP BY 1"),
)
def monthly_return_table(spark, sf):
    return pf.monthly_table(_staged(spark, sf)[1])


@query(
    "symbol:s trades:i total_net_contribution total_gross_contribution average_net_return median_net_return win_rate profit_factor best_trade_return "
    "worst_trade_return extreme_trade_count:i stop_loss_count:i stop_loss_rate average_holding_days first_entry_date:d last_exit_date:d data_review:s sample_quality:s",
    covers="AGG-12",
    sql=with_(
        "trd",
        """SELECT *, stop_loss_count / trades AS stop_loss_rate, CASE WHEN extreme_trade_count > 0 THEN 'REVIEW_EXTREME_MOVE' ELSE 'PASS' END AS data_review, CASE WHEN trades >= 5 THEN 'SUPPORTED' ELSE 'LOW_SAMPLE' END AS sample_quality FROM (
  SELECT symbol, count(*) AS trades, sum(net_contribution) AS total_net_contribution, sum(gross_contribution) AS total_gross_contribution, avg(net_return) AS average_net_return, median(net_return) AS median_net_return, avg(CAST(net_return > 0 AS DOUBLE)) AS win_rate,
   sum(net_return) FILTER (net_return > 0) / -sum(net_return) FILTER (net_return < 0) AS profit_factor, max(net_return) AS best_trade_return, min(net_return) AS worst_trade_return, count_if(abs(net_return) > 0.5) AS extreme_trade_count,
   count_if(exit_reason = 'stop_loss') AS stop_loss_count, avg(holding_days) AS average_holding_days, min(entry_date) AS first_entry_date, max(exit_date) AS last_exit_date FROM trd WHERE skip_reason IS NULL GROUP BY symbol)""",
    ),
)
def stock_attribution(spark, sf):
    return pf.stock_attribution(_staged(spark, sf)[0])


define_cte(
    "fld",
    """/*recursive*/ SELECT 1 AS fold, (SELECT min(date) FROM bench WHERE date >= (SELECT min(date) FROM bench) + INTERVAL 2 YEAR) AS ts
 UNION ALL SELECT fold + 1, (SELECT min(date) FROM bench WHERE date >= ts + INTERVAL 6 MONTH) FROM fld WHERE (SELECT min(date) FROM bench WHERE date >= ts + INTERVAL 6 MONTH) < (SELECT max(date) FROM bench)""",
    "bench",
)
sh._CTES["fld"] = (sh._CTES["fld"][0].replace("fld AS MATERIALIZED", "fld AS"), ("bench",))
define_cte(
    "folds",
    """SELECT fold, ts AS test_start, (SELECT max(date) FROM bench WHERE date < ts + INTERVAL 6 MONTH) AS test_end, a.date AS train_end, b.date AS embargo_start, c.date AS embargo_end, (SELECT min(date) FROM bench) AS train_start
 FROM fld JOIN n ON n.date = ts JOIN n a ON a.i = n.i - 21 JOIN n b ON b.i = n.i - 20 JOIN n c ON c.i = n.i - 1""".replace(" n ", " (SELECT date, row_number() OVER (ORDER BY date) AS i FROM bench) n ", 1).replace("JOIN n a", "JOIN (SELECT date, row_number() OVER (ORDER BY date) AS i FROM bench) a").replace("JOIN n b", "JOIN (SELECT date, row_number() OVER (ORDER BY date) AS i FROM bench) b").replace("JOIN n c", "JOIN (SELECT date, row_number() OVER (ORDER BY date) AS i FROM bench) c"),
    "fld bench",
)


@query(
    "fold:i train_start:d train_end:d embargo_start:d embargo_end:d test_start:d test_end:d train_rows:i test_rows:i no_overlap:b",
    covers="BT-10 BT-11 AGG-51",
    sql=with_(
        "folds bars",
        "SELECT *, (SELECT count(*) FROM bars WHERE date BETWEEN train_start AND train_end) AS train_rows, (SELECT count(*) FROM bars WHERE date BETWEEN test_start AND test_end) AS test_rows, "
        "train_end < embargo_start AND embargo_start <= embargo_end AND embargo_end < test_start AS no_overlap FROM folds",
    ),
)
def walk_forward_folds(spark, sf):
    return bt.fold_audit(bt.walk_forward_folds(sh.benchmark(spark, sf), 2, 6, 20), sh.bars(spark, sf))


@query(
    "fold:i signal_date:d exit_date:d net_return benchmark_return",
    covers="BT-12",
    sql=with_("per folds", "SELECT f.fold, p.signal_date, p.exit_date, p.net_return, p.benchmark_return FROM per p JOIN folds f ON p.signal_date >= f.test_start AND p.exit_date <= f.test_end"),
)
def walk_forward_periods(spark, sf):
    _, periods, bench = _staged(spark, sf)
    return bt.assign_folds(periods, bt.walk_forward_folds(bench, 2, 6, 20))


@query("variant:s periods:i trades:i total_return sharpe max_drawdown", covers="BT-13")
def parameter_sensitivity(spark, sf):
    grid = [(f"top{k}_stop{s}", k, s) for k in (8, 10, 12) for s in (0.20, 0.25, 0.30)]
    bench = sh.benchmark(spark, sf)
    cfg = bt.Strategy(top_n=12, trailing_stop=0.30, min_traded_value=1000.0, circuit=3.0)
    sched = bt.schedule(bench)
    data = bt.prepare(sh.sector_bars(spark, sf), sg.get_signal("momentum_weekly"))
    sel = bt.variants(bt.select(data, sched, cfg), grid)
    w = bt.weights(sel, cfg, ["signal_date", "variant", "stop_loss"])
    trades = stage(bt.simulate(w, data, bt.period_sessions(sched, bench), cfg, ["variant"]), "grid-trades")
    return pf.performance(stage(bt.periods(trades, sched, bench, ["variant"]), "grid"), trades, ["variant"], trials=len(grid))


define_cte(
    "topn",
    """SELECT p.date, p.i, p.positions, p.g - t.turnover * 10 / 1e4 AS portfolio_return, p.benchmark_return, t.turnover FROM (
  SELECT date, i, count(*) AS positions, avg(future_stock_return) AS g, avg(future_bench_return) AS benchmark_return FROM tsel GROUP BY date, i) p
 JOIN (SELECT coalesce(a.i, b.i) AS i, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) / 2 AS turnover FROM (SELECT symbol, i, w FROM tsel) a FULL JOIN (SELECT symbol, i + 1 AS i, w FROM tsel) b ON a.symbol = b.symbol AND a.i = b.i GROUP BY 1) t USING (i)""",
    "tsel",
)
define_cte(
    "tsel",
    """SELECT *, 1.0 / count(*) OVER (PARTITION BY date) AS w FROM (SELECT p.*, r.i, row_number() OVER (PARTITION BY p.date ORDER BY score DESC, symbol) AS rk FROM pred p
 JOIN (SELECT date, CAST((n - 1) / 20 AS INTEGER) AS i FROM (SELECT date, row_number() OVER (ORDER BY date) AS n FROM (SELECT DISTINCT date FROM pred)) WHERE (n - 1) % 20 = 0) r USING (date)) WHERE rk <= 5""",
    "pred",
)


@query(
    "date:d positions:i portfolio_return benchmark_return turnover",
    covers="BT-7",
    sql=with_("topn", "SELECT * FROM topn"),
)
def top_n_prediction_portfolio(spark, sf):
    return bt.top_n_predictions(lp.predictions(spark, sf))


@query(
    "periods:i cagr benchmark_cagr sharpe sortino max_drawdown volatility win_rate turnover",
    covers="BT-7 AGG-13 WIN-44",
    sql=with_(
        "topn",
        """SELECT count(*) AS periods, exp(sum(ln(1 + portfolio_return)) / (count(*) * 20 / 252)) - 1 AS cagr, exp(sum(ln(1 + benchmark_return)) / (count(*) * 20 / 252)) - 1 AS benchmark_cagr, avg(portfolio_return) / stddev_samp(portfolio_return) * sqrt(252 / 20) AS sharpe,
  avg(portfolio_return) / stddev_samp(CASE WHEN portfolio_return < 0 THEN portfolio_return END) * sqrt(252 / 20) AS sortino, min(e / pk - 1) AS max_drawdown, stddev_samp(portfolio_return) * sqrt(252 / 20) AS volatility, avg(CAST(portfolio_return > benchmark_return AS DOUBLE)) AS win_rate, avg(turnover) AS turnover
 FROM (SELECT *, max(e) OVER (ORDER BY date) AS pk FROM (SELECT *, exp(sum(ln(1 + portfolio_return)) OVER (ORDER BY date)) AS e FROM topn))""",
    ),
)
def top_n_prediction_summary(spark, sf):
    return pf.top_n_summary(bt.top_n_predictions(lp.predictions(spark, sf)))
