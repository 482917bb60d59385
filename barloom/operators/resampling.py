"""Bootstraps with counter-based draws: reproducible, engine independent, no driver loops.

A draw is a function of (seed, sample, position), see ``functions/draws.py``, so every path is built by a join on
the drawn index and windows per sample. The grids hold samples x periods rows, where the
periods (or dates) are already aggregated.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.draws import draw, draw_array, mixed, mixed_array, pick
from barloom.functions.rolling import Series, ratio

C = F.col


def _grid(one_row: DataFrame, samples: int, n: str) -> DataFrame:
    return one_row.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn(
        "pos", F.explode(F.sequence(F.lit(1), C(n).cast("int")))
    )


def monte_carlo(returns: DataFrame, samples: int, seed: int = 42) -> DataFrame:
    """Terminal log return and maximum drawdown of resampled period returns.

    ``returns``: signal_date, net_return (one row per period).
    """
    one = Window.partitionBy(F.lit(0)).orderBy("signal_date")
    r = returns.select("net_return", F.row_number().over(one).alias("idx"))
    n = r.agg(F.count(F.lit(1)).alias("_n"))
    g = _grid(n, samples, "_n").withColumn("idx", pick(C("_n"), seed, C("sample"), C("pos")))
    w = Window.partitionBy("sample").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    p = g.join(r, "idx").withColumn("_e", F.sum(F.log1p("net_return")).over(w))
    p = p.withColumn("_dd", F.exp(C("_e") - F.max("_e").over(w)) - 1)
    return p.groupBy("sample").agg(
        F.max(F.struct("pos", "_e"))["_e"].alias("log_terminal"), F.min("_dd").alias("max_drawdown")
    )


def block_bootstrap(per_date: DataFrame, samples: int, seed: int = 7) -> DataFrame:
    """Precision of two rules and their difference on resampled dates.

    ``per_date``: date, a_hits, a_n, b_hits, b_n; whole dates are drawn together.
    """
    one = Window.partitionBy(F.lit(0)).orderBy("date")
    d = per_date.withColumn("idx", F.row_number().over(one))
    n = d.agg(F.count(F.lit(1)).alias("_n"))
    g = _grid(n, samples, "_n").withColumn("idx", pick(C("_n"), seed, C("sample"), C("pos")))
    s = g.join(d.drop("date"), "idx").groupBy("sample").agg(*[
        F.sum(c).alias(c) for c in ("a_hits", "a_n", "b_hits", "b_n")
    ])
    return s.select(
        "sample", ratio("a_hits", "a_n").alias("a_precision"), ratio("b_hits", "b_n").alias("b_precision"),
        (ratio("b_hits", "b_n") - ratio("a_hits", "a_n")).alias("difference"),
    )


def interval(samples: DataFrame, value: str) -> DataFrame:
    """2.5 / 50 / 97.5 % quantiles and the share above zero (a few thousand samples)."""
    return samples.agg(
        F.count(value).alias("samples"), *[F.percentile(value, p).alias(n) for n, p in (("low", 0.025), ("median", 0.5), ("high", 0.975))],
        F.avg((C(value) > 0).cast("double")).alias("share_positive"),
    )


@dataclass(frozen=True)
class Plan:
    """Long plan in percent of the entry."""

    stop: float = 0.90
    target: float = 1.15
    horizon: int = 10
    block: int = 5
    paths: int = 2000
    cost_bps: float = 10.0
    slippage_bps: float = 5.0


def _outcome(path: DataFrame, keys: list[str], plan: Plan) -> DataFrame:
    """Stop-first daily fills, gaps at the open. ``path``: keys, day, o/h/l/c relative to entry 1.0."""
    hit = (
        F.when(C("o") <= plan.stop, F.struct("day", F.lit("STOP").alias("k"), C("o").alias("x")))
        .when(C("o") >= plan.target, F.struct("day", F.lit("TARGET").alias("k"), F.lit(plan.target).alias("x")))
        .when(C("l") <= plan.stop, F.struct("day", F.lit("STOP").alias("k"), F.lit(plan.stop).alias("x")))
        .when(C("h") >= plan.target, F.struct("day", F.lit("TARGET").alias("k"), F.lit(plan.target).alias("x")))
    )
    g = path.groupBy(*keys).agg(F.min(hit).alias("_h"), F.max(F.struct("day", "c")).alias("_l"))
    exit_ = F.coalesce(C("_h.x"), C("_l.c"))
    fee, slip = plan.cost_bps / 1e4, plan.slippage_bps / 1e4
    return g.select(
        *keys, F.coalesce(C("_h.k"), F.lit("NEITHER")).alias("outcome"),
        F.coalesce(C("_h.day"), C("_l.day")).alias("exit_day"), (exit_ - 1).alias("gross_return"),
        (exit_ * (1 - slip) * (1 - fee) / ((1 + slip) * (1 + fee)) - 1).alias("net_return"),
    )


#: Intact blocks a history needs before it is resampled.
MIN_BLOCKS = 20


def _ratios(panel: DataFrame, plan: Plan) -> DataFrame:
    """Bars relative to the previous close by row number; ``_start`` marks the first rows of intact blocks."""
    s = Series("symbol", "date")
    prev = s.lag("close")
    df = panel.withColumns(
        {f"r{k}": ratio(c, prev) for k, c in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"))}
        | {"_row": s.position(), "_seg0": s.lag("segment")})
    block = s.w.rowsBetween(0, plan.block - 1)
    same = F.coalesce(C("_seg0") == C("segment"), F.lit(False)).cast("int")
    return df.withColumn("_okrow", same).withColumn(
        "_start", (F.sum("_okrow").over(block) == plan.block) & (F.min("segment").over(block) == F.max("segment").over(block)))


#: Simulated paths x days that one batch of a task holds.
BATCH_CELLS = 400_000


def _histories(df: DataFrame) -> DataFrame:
    """One row per symbol: its ratios by row and the marks of block starts, as arrays bounded by the calendar."""
    cols = ("ro", "rh", "rl", "rc", "_start")
    pluck = lambda c: F.transform("_h", lambda x: x[c].cast("double")).alias(c)
    per = df.where(C("symbol").isNotNull()).groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("_row", *cols))).alias("_h"))
    return per.select("symbol", *[pluck(c) for c in cols])


def _one_path_set(ratios: list[np.ndarray], starts: np.ndarray, n: int, drawn: np.ndarray, plan: Plan) -> list[np.ndarray]:
    """Resampled o, h, l, c of all paths (paths x days); unknown values are NaN."""
    first = starts[(drawn.astype(np.int64) * n) >> 32]
    at = (first[:, :, None] + np.arange(plan.block)).reshape(len(drawn), -1)[:, : plan.horizon]
    ro, rh, rl, rc = (r[at] for r in ratios)
    entry = np.where(ro[:, 0] == 0, np.nan, ro[:, 0])
    for r in (rh, rl, rc):
        r[:, 0] /= entry
    ro[:, 0] = 1.0
    known = rc > 0
    logs = np.where(known, np.log(np.where(known, rc, 1.0)), 0.0)
    base = np.exp(np.cumsum(logs, axis=1))
    base = np.column_stack([np.ones(len(base)), base[:, :-1]])
    return [r * base for r in (ro, rh, rl, rc)]


def _path_outcomes(path: list[np.ndarray], plan: Plan) -> list[np.ndarray]:
    """Outcome (place in ``OUTCOMES``), exit day, gross and net return per path, by the rules of ``_outcome``."""
    o, h, low, c = path
    rules = [o <= plan.stop, o >= plan.target, low <= plan.stop, h >= plan.target]
    kind = np.select(rules, [0, 1, 0, 1], 2)
    price = np.select(rules, [o, np.full_like(o, plan.target), np.full_like(o, plan.stop), np.full_like(o, plan.target)], np.nan)
    hit = kind < 2
    some, rows = hit.any(axis=1), np.arange(len(o))
    day = np.where(some, hit.argmax(axis=1), o.shape[1] - 1)
    exit_ = np.where(some, price[rows, day], c[:, -1])
    fee, slip = plan.cost_bps / 1e4, plan.slippage_bps / 1e4
    net = exit_ * (1 - slip) * (1 - fee) / ((1 + slip) * (1 + fee)) - 1
    return [np.where(some, kind[rows, day], 2).astype(np.int32), (day + 1).astype(np.int32), exit_ - 1, net]


OUTCOMES = ("STOP", "TARGET", "NEITHER")


def _lists(parts: list[np.ndarray], width: int) -> pa.Array:
    flat = np.concatenate([np.ravel(p) for p in parts])
    values = pa.array(flat, mask=np.isnan(flat)) if flat.dtype.kind == "f" else pa.array(flat)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width), pa.int32()), values)


def _simulated(origins: DataFrame, keys: list[str], df: DataFrame, plan: Plan, seed: int, columns: Sequence[str] | None) -> DataFrame:
    """Per row of ``origins``, arrays by path: outcome, exit_day, gross_return, net_return, or ``columns`` of the bars per day.

    ``origins``: symbol, other keys, ``_n`` (blocks to draw from, the first ones of the symbol's history). Drawn bars are
    looked up in the arrays of the symbol's row, so paths meet no join, sort or shuffle.
    """
    rows = origins.where(C("_n") >= MIN_BLOCKS).join(_histories(df), "symbol")
    rows = rows.select(*keys, C("_n").cast("int").alias("_n"), "ro", "rh", "rl", "rc", "_start")
    types = dict(rows.dtypes)
    out = [f"{c} array<double>" for c in columns] if columns else [
        "outcome array<int>", "exit_day array<int>", "gross_return array<double>", "net_return array<double>"]
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + (["day int"] if columns else []) + out)
    blocks = -(-plan.horizon // plan.block)
    chosen = [("o", "h", "l", "c").index(c) for c in columns or ()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = draw_array(seed, np.arange(1, plan.paths + 1)[:, None], np.arange(blocks)[None, :])
        step = max(1, BATCH_CELLS // (plan.paths * plan.horizon))
        for b in batches:
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                made = []
                for k in range(part.num_rows):
                    ratios = [part.column(c)[k].values.to_numpy(zero_copy_only=False).astype(float) for c in ("ro", "rh", "rl", "rc")]
                    starts = np.flatnonzero(part.column("_start")[k].values.to_numpy(zero_copy_only=False) == 1)
                    with np.errstate(all="ignore"):
                        path = _one_path_set(ratios, starts, part.column("_n")[k].as_py(), drawn, plan)
                        made.append(path if columns else _path_outcomes(path, plan))
                if columns:
                    days = np.tile(np.arange(1, plan.horizon + 1, dtype=np.int32), part.num_rows)
                    rep = pa.array(np.repeat(np.arange(part.num_rows), plan.horizon))
                    cells = [pa.array(days), *[_lists([m[c].T for m in made], plan.paths) for c in chosen]]
                    head = [part.column(k).take(rep) for k in keys]
                else:
                    cells, head = [_lists([m[c] for m in made], plan.paths) for c in range(4)], [part.column(k) for k in keys]
                yield pa.RecordBatch.from_arrays([*head, *cells], names=[f.split(" ")[0] for f in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def _block_counts(df: DataFrame) -> DataFrame:
    return df.where(C("_start")).groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))


def path_arrays(panel: DataFrame, plan: Plan, seed: int = 11, columns: Sequence[str] = ("o", "h", "l", "c")) -> DataFrame:
    """Block-bootstrapped bars of every symbol relative to the entry: symbol, day and ``columns`` as arrays by path.

    ``panel`` carries ``segment``; a block never crosses a segment border.
    """
    df = _ratios(panel, plan)
    return _simulated(_block_counts(df), ["symbol"], df, plan, seed, columns)


def outcome_arrays(panel: DataFrame, plan: Plan, seed: int = 11) -> DataFrame:
    """Outcome of the plan on every simulated path: one row per symbol with arrays by path."""
    df = _ratios(panel, plan)
    return _simulated(_block_counts(df), ["symbol"], df, plan, seed, None).withColumn("outcome", _named("outcome"))


def _named(codes: str) -> Column:
    return F.transform(codes, lambda k: F.get(F.array(*[F.lit(o) for o in OUTCOMES]), k))


def _by_path(arrays: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per path from arrays by path."""
    rows = arrays.select(*keys, F.posexplode(F.arrays_zip(*values)).alias("_p", "_v"))
    return rows.select(keys[0], (C("_p") + 1).alias("path"), *keys[1:], *[C(f"_v.{v}").alias(v) for v in values])


def simulated_paths(panel: DataFrame, plan: Plan, seed: int = 11) -> DataFrame:
    """Block-bootstrapped bars of every symbol relative to the entry (rows per symbol: paths x horizon)."""
    return _by_path(path_arrays(panel, plan, seed), ["symbol", "day"], ["o", "h", "l", "c"])


def simulate_plan(panel: DataFrame, plan: Plan, seed: int = 11) -> DataFrame:
    """Outcome of the plan on every simulated path."""
    return _by_path(outcome_arrays(panel, plan, seed), ["symbol"], ["outcome", "exit_day", "gross_return", "net_return"])


def _array_percentile(xs: Column, q: float) -> Column:
    """``percentile`` of a sorted array."""
    at = (F.size(xs) - 1) * F.lit(q)
    low, high = F.get(xs, F.floor(at).cast("int")), F.get(xs, F.ceil(at).cast("int"))
    return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


def _packed(df: DataFrame, column: str) -> bool:
    return dict(df.dtypes)[column].startswith("array")


def plan_bands(paths: DataFrame) -> DataFrame:
    """P10, median and P90 of the simulated closes per symbol and day, in units of the entry.

    ``paths``: one row per path (``simulated_paths``) or arrays by path (``path_arrays``).
    """
    names = (("p10", 0.1), ("median", 0.5), ("p90", 0.9))
    if _packed(paths, "c"):
        xs = paths.select("symbol", "day", F.sort_array(F.array_compact("c")).alias("c"))
        return xs.select("symbol", "day", *[_array_percentile(C("c"), q).alias(n) for n, q in names])
    return paths.groupBy("symbol", "day").agg(*[F.percentile("c", q).alias(n) for n, q in names])


def plan_frequencies(outcomes: DataFrame) -> DataFrame:
    """Shares of the outcomes, mean and median net return per symbol, from rows or arrays by path."""
    if _packed(outcomes, "outcome"):
        xs = outcomes.select("symbol", "outcome", F.sort_array(F.array_compact("net_return")).alias("_net"))
        part = lambda k: F.size(F.filter("outcome", lambda x: x == k)) / F.size("outcome")
        total = F.aggregate("_net", F.lit(0.0), lambda a, x: a + x)
        return xs.select(
            "symbol", part("TARGET").alias("target_share"), part("STOP").alias("stop_share"), part("NEITHER").alias("neither_share"),
            F.when(F.size("_net") > 0, total / F.size("_net")).alias("net_mean"), _array_percentile(C("_net"), 0.5).alias("net_median"))
    share = lambda k: F.avg((C("outcome") == k).cast("double"))
    return outcomes.groupBy("symbol").agg(
        share("TARGET").alias("target_share"), share("STOP").alias("stop_share"), share("NEITHER").alias("neither_share"),
        F.avg("net_return").alias("net_mean"), F.percentile("net_return", 0.5).alias("net_median"))


def replay_plan(panel: DataFrame, plan: Plan, warmup: int = 252) -> DataFrame:
    """Outcome of the plan on the actual bars after every ``horizon``-th origin."""
    s = Series("symbol", "date")
    df = panel.withColumns({"_i": s.position() - 1, "entry": s.lead("open"), "_s200": s.mean("close", 200),
                            "_full": s.lead("close", plan.horizon)})
    origins = df.where((C("_i") >= warmup) & ((C("_i") - warmup) % plan.horizon == 0) & C("_full").isNotNull()).select(
        "symbol", C("date").alias("origin"), "_i", "entry", F.when(C("close") > C("_s200"), "Above SMA200").otherwise("Below SMA200").alias("regime"))
    steps = origins.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(plan.horizon)))).withColumn("_j", C("_i") + C("day"))
    bars = df.select("symbol", C("_i").alias("_j"), "open", "high", "low", "close")
    p = steps.join(bars, ["symbol", "_j"]).withColumns({k: ratio(c, "entry") for k, c in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"))})
    return _outcome(p, ["symbol", "origin", "regime"], plan)


def replay_calibration(panel: DataFrame, plan: Plan, warmup: int = 252, seed: int = 11) -> DataFrame:
    """Per replay origin: the target frequency simulated from earlier bars only, beside what happened.

    A block belongs to the past if it ends at the origin or before; the paths of an origin are ``plan.paths``.
    """
    df = _ratios(panel, plan)
    w = Window.partitionBy("symbol").orderBy("_row")
    seen = F.count(F.when(C("_start"), 1)).over(w.rowsBetween(Window.unboundedPreceding, 1 - plan.block))
    known = df.select("symbol", C("date").alias("origin"), C("_row").alias("train_rows"), seen.alias("_n"))
    actual = replay_plan(panel, plan, warmup)
    origins = actual.select("symbol", "origin").join(known, ["symbol", "origin"])
    keys = ["symbol", "origin"]
    simulated = _simulated(origins.select(*keys, "_n"), keys, df, plan, seed, None)
    hits = F.size(F.filter("outcome", lambda k: k == OUTCOMES.index("TARGET")))
    expected = simulated.select(*keys, (hits / F.size("outcome")).alias("target_frequency"))
    out = actual.join(expected, keys).join(origins.drop("_n"), keys)
    return out.withColumn("target_hit", (C("outcome") == "TARGET").cast("int"))


def random_picks(eligible: DataFrame, samples: int, n: int, seed: int = 42) -> DataFrame:
    """``n`` random names per (sample, signal date), independent of each other; the limit prunes before the exchange.

    ``eligible``: signal_date, symbol, key (a number of the symbol), further columns kept.
    """
    from barloom.operators.cross_section import top_n

    g = eligible.withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    g = g.withColumn("_u", draw(seed, C("variant"), F.datediff("signal_date", F.lit("1970-01-01").cast("date")), C("key")))
    picks = top_n(g.drop("rank", "side") if "rank" in g.columns else g, ["variant", "signal_date"], "_u", n, lowest=True)
    return picks.withColumn("side", F.lit(1)).drop("_u")


#: Names of one date that a task draws for at a time, and draws held at once.
CHUNK_NAMES, DRAW_CELLS = 32_768, 1_000_000


def _least_draws(rows: DataFrame, samples: int, count: int, seed: int) -> DataFrame:
    """variant, t, u, symbol, key, until: the ``count`` names of least draw per sample and chunk of a date, ties included.

    Every name is drawn for every sample (t, symbol, key, until, ``names`` of the date); only the least of a chunk become rows.
    """
    chunk = F.pmod(F.xxhash64("symbol"), F.ceil(C("names") / CHUNK_NAMES)).cast("int")
    fields = ("symbol", "key", "until")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        bare = np.asarray(table["key"].is_null())
        keys = table["key"].fill_null(0).to_numpy()
        t = np.array(table["t"][0].as_py())
        out_v, out_u, out_i = [], [], []
        step = max(1, DRAW_CELLS // len(keys))
        for v in range(1, samples + 1, step):
            variants = np.arange(v, min(v + step, samples + 1))
            u = mixed_array(draw_array(seed, variants, t)[:, None], keys[None, :])
            u[:, bare] = 0  # an unknown key has no draw and comes first
            some = u <= np.partition(u, count - 1, axis=1)[:, count - 1 : count] if u.shape[1] > count else np.ones(u.shape, bool)
            at, i = np.nonzero(some)
            out_v.append(variants[at])
            out_u.append(u[at, i])
            out_i.append(i)
        i = np.concatenate(out_i)
        picked = table.select(fields).take(pa.array(i))
        head = [pa.array(np.concatenate(out_v).astype(np.int32)), pa.array(np.full(len(i), t, np.int32)),
                pa.array(np.concatenate(out_u).astype(np.int64), mask=bare[i])]
        return pa.Table.from_arrays([*head, *picked.columns], names=["variant", "t", "u", *fields])

    keyed = rows.select("t", chunk.alias("_chunk"), *fields)
    return keyed.groupBy("t", "_chunk").applyInArrow(run, "variant int, t int, u bigint, symbol string, key bigint, until int")


def matched_picks(eligible: DataFrame, turnover: DataFrame, samples: int, n: int, seed: int = 42) -> DataFrame:
    """Random portfolios that turn over as the strategy does: variant, signal_date, rank, symbol, kept, size, replace.

    ``eligible``: signal_date, symbol, key (a number of the symbol); ``turnover``: signal_date, turnover (one-way share of the
    strategy). At each date a portfolio of size m = min(n, eligible names) replaces r = m t / (1 - t) names, rounded half to
    even and at most m, t the turnover clipped to 0 .. 0.5 (0.5 where unknown). It keeps m - r of its earlier names, drawn
    from those still eligible, or all of them if fewer are; the rest is drawn from the names that were not kept.

    The ``2 n`` names of least draw per sample and date always hold enough new ones, and each carries up to which date it
    stays eligible without a break. So a sample is a fold over dates with the portfolio as state, in the JVM; an array of it
    has calendar x 2 n entries, whatever the number of symbols.
    """
    one = Window.partitionBy(F.lit(0)).orderBy("signal_date")
    dates = eligible.groupBy("signal_date").agg(F.count(F.lit(1)).alias("names"))
    dates = dates.join(turnover.select("signal_date", "turnover"), "signal_date", "left").withColumn("t", F.row_number().over(one))
    share = F.least(F.greatest(F.coalesce(C("turnover"), F.lit(0.5)), F.lit(0.0)), F.lit(0.5))
    size = F.least(C("names"), F.lit(n)).cast("int")
    dates = dates.withColumn("size", size).withColumn(
        "replace", F.least(C("size"), F.rint(share * C("size") / F.greatest(F.lit(1e-9), 1 - share)).cast("int")))
    rows = eligible.select("signal_date", "symbol", C("key").cast("bigint").alias("key")).join(
        dates.select("signal_date", "t", "names"), "signal_date")
    island = C("t") - F.row_number().over(Window.partitionBy("symbol").orderBy("t"))
    rows = rows.withColumn("_island", island).withColumn("until", F.max("t").over(Window.partitionBy("symbol", "_island")))
    least = _least_draws(rows.select("t", "symbol", "key", "until", "names"), samples, 2 * n, seed)
    order = Window.partitionBy("variant", "t").orderBy("u", "symbol")
    g = least.withColumn("_k", F.row_number().over(order)).where(C("_k") <= 2 * n).join(
        F.broadcast(dates.select("t", "signal_date", "size", "replace")), "t")
    per = g.groupBy("variant", "t", "signal_date", "size", "replace").agg(
        F.sort_array(F.collect_list(F.struct("u", "symbol", "key", "until"))).alias("_c"))
    bare = lambda x: F.struct(x["symbol"].alias("symbol"), x["key"].alias("key"), x["until"].alias("until"))
    per = per.withColumn("_c", F.transform("_c", bare)).withColumn("salt", draw(seed + 1, C("variant"), C("t")))
    steps = per.groupBy("variant").agg(F.sort_array(F.collect_list(F.struct("t", "signal_date", "size", "replace", "salt", "_c"))).alias("_s"))
    names = "array<struct<symbol:string,key:bigint,until:int>>"
    made = f"array<struct<signal_date:date,size:int,replace:int,kept:int,names:{names}>>"

    def by_draw(xs, salt):
        drawn = lambda x: F.struct(mixed(salt, x["key"]).alias("u"), x["symbol"].alias("symbol"), x["key"].alias("key"), x["until"].alias("until"))
        return F.transform(F.array_sort(F.transform(xs, drawn)), bare)

    def step(acc, p):
        alive = F.filter(acc["held"], lambda x: x["until"] >= p["t"])
        kept = F.slice(by_draw(alive, p["salt"]), 1, F.greatest(F.lit(0), p["size"] - p["replace"]))
        return F.transform(F.array(kept), lambda k: portfolio(acc, p, k))[0]

    def portfolio(acc, p, kept):
        fresh = F.filter(p["_c"], lambda x: ~F.exists(kept, lambda k: k["symbol"] == x["symbol"]))
        now = F.concat(kept, F.slice(fresh, 1, p["size"] - F.size(kept)))
        entry = F.struct(p["signal_date"].alias("signal_date"), p["size"].alias("size"), p["replace"].alias("replace"), F.size(kept).alias("kept"), now.alias("names"))
        return F.struct(now.cast(names).alias("held"), F.concat(acc["made"], F.array(entry)).cast(made).alias("made"))

    start = F.struct(F.array().cast(names).alias("held"), F.array().cast(made).alias("made"))
    out = steps.select("variant", F.explode(F.aggregate("_s", start, step, lambda a: a["made"])).alias("p"))
    out = out.select("variant", "p.*", F.posexplode("p.names").alias("rank", "name"))
    return out.select("variant", "signal_date", (C("rank") + 1).alias("rank"), "name.symbol", "kept", "size", "replace")
