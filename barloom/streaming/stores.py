"""Tables that micro-batches keep up to date in the shared folder, in place of state in executors.

Every job below gives the same rows for any split of its input into batches and any order of rows. A batch writes folders
of its own and a replayed batch writes the same ones again, so a lost executor or a restarted query changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.streaming.jobs import bar_parts

C = F.col
Write = Callable[[DataFrame, int], None]


def run_store(df: DataFrame, write: Write, checkpoint: str) -> None:
    """Process everything available with a foreachBatch body."""
    df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


# Keyed merge by month ---------------------------------------------------------


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, table: str) -> list[tuple[int, str]]:
    """Finished versions of a table in order, each with the name of the batch that made it."""
    fs, p = _hadoop(spark, f"{table}/current")
    names = [s.getPath().getName().split("-", 1) for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted((int(n), batch) for n, batch in names)


def _months(spark: SparkSession, table: str, version: int) -> dict[str, int]:
    """Which version holds each month: one entry per calendar month."""
    return {r["month"]: r["version"] for r in spark.read.parquet(f"{table}/manifest/{version}").collect()}


def _read_months(spark: SparkSession, table: str, held: dict[str, int], schema) -> DataFrame:
    paths = [f"{table}/data/{v}/month={m}" for m, v in sorted(held.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_merged(spark: SparkSession, table: str, schema) -> DataFrame:
    """The last finished version of a table that :func:`merge_by_month` keeps; empty before the first one."""
    done = _versions(spark, table)
    return _read_months(spark, table, _months(spark, table, done[-1][0]) if done else {}, schema)


def merge_by_month(table: str, keys: list[str], newest: list[str], run: str, day: str = "date") -> Write:
    """foreachBatch body: last write wins per ``keys``, by the columns ``newest`` and not by arrival.

    Only the months that a batch touches are written again; the manifest of the new version points to the old folders
    of all others. An empty pointer file named after version and batch is made last: readers see whole versions only, and
    a batch that is replayed after its pointer exists does nothing. ``run`` names the streaming query, so that batch
    numbers of later queries over the same table are told apart. Rows with a null key are left out; rows equal in
    ``newest`` are decided by their other columns. Old versions stay for readers that began with them.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, done = batch.sparkSession, _versions(batch.sparkSession, table)
        name = f"{run}-{batch_id}"
        if any(b == name for _, b in done):
            return
        version = done[-1][0] + 1 if done else 0
        held = _months(spark, table, done[-1][0]) if done else {}
        rest = [c for c in batch.columns if c not in keys and c not in newest]
        fresh = batch.dropna(subset=keys)
        # one row per key before anything is stored, so a refetched batch costs its keys
        best = lambda df: df.groupBy(*keys).agg(F.max(F.struct(*newest, *rest)).alias("_r")).select(*keys, "_r.*").select(*batch.columns)
        month = F.date_format(day, "yyyy-MM").alias("month")
        best(fresh).write.mode("overwrite").parquet(f"{table}/fresh/{version}")
        fresh = spark.read.schema(batch.schema).parquet(f"{table}/fresh/{version}")
        touched = [r["month"] for r in fresh.select(month).distinct().collect()]
        old = _read_months(spark, table, {m: v for m, v in held.items() if m in touched}, batch.schema)
        merged = best(fresh.unionByName(old)).select("*", month).hint("rebalance", "month")
        merged.write.mode("overwrite").partitionBy("month").parquet(f"{table}/data/{version}")
        held |= {m: version for m in touched}
        spark.createDataFrame(sorted(held.items()), "month string, version int").coalesce(1).write.mode("overwrite").parquet(f"{table}/manifest/{version}")
        fs, p = _hadoop(spark, f"{table}/current/{version:012d}-{name}")
        fs.create(p, True).close()

    return write


# Interval join ----------------------------------------------------------------

SIDES = "side string, symbol bigint, at timestamp, reference bigint"
PAIRS = "symbol bigint, period_ts timestamp, filed_ts timestamp, reference bigint"


def _pairs(left: DataFrame, right: DataFrame, days: int) -> DataFrame:
    """Equal symbols, right 0..days after left: an equi-join on symbol and slot, since a left row reaches two slots."""
    left = left.select("symbol", C("at").alias("period_ts"), F.explode(F.array(C("slot"), C("slot") + 1)).alias("slot"))
    right = right.select("symbol", "slot", C("at").alias("filed_ts"), "reference")
    near = (C("filed_ts") >= C("period_ts")) & (C("filed_ts") <= C("period_ts") + F.expr(f"INTERVAL {days} DAYS"))
    return left.join(right, ["symbol", "slot"]).where(near).select("symbol", "period_ts", "filed_ts", "reference")


def interval_matches(out: str, days: int) -> Write:
    """foreachBatch body: ``side`` left or right rows of :data:`SIDES`, matched 0..days apart however late they come.

    Rows are kept in folders by batch and by time slot of ``days`` days. A batch meets itself and the earlier batches'
    rows in the slots beside its own, so no pair is lost or made twice, nothing is held in a state store, and a symbol
    with very many rows is spread over its slots. Rows with a null symbol or time match nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        slot = F.floor(F.unix_micros("at") / F.lit(days * 86_400_000_000)).cast("int")
        rows = batch.dropna(subset=["symbol", "at"]).select("side", "symbol", "at", "reference", slot.alias("slot"))
        rows.write.mode("overwrite").partitionBy("slot").parquet(f"{out}/rows/batch={batch_id}")
        every = spark.read.schema(f"{SIDES}, batch bigint, slot int").parquet(f"{out}/rows")
        new = every.where(C("batch") == batch_id)
        lo, hi = new.agg(F.min("slot"), F.max("slot")).first()
        if lo is None:
            return
        old = every.where((C("batch") < batch_id) & C("slot").between(lo - 1, hi + 1))
        of = lambda df, side: df.where(C("side") == side)
        found = _pairs(of(new, "left"), of(new.unionByName(old), "right"), days).unionByName(_pairs(of(old, "left"), of(new, "right"), days))
        found.write.mode("overwrite").parquet(f"{out}/matches/batch={batch_id}")

    return write


def read_matches(spark: SparkSession, out: str) -> DataFrame:
    fs, p = _hadoop(spark, f"{out}/matches")
    return spark.read.schema(PAIRS).parquet(f"{out}/matches") if fs.exists(p) else spark.createDataFrame([], PAIRS)


# Indicators carried across batches --------------------------------------------

_PART = "symbol bigint, bar_start timestamp, high double, low double, last struct<at:struct<ts:timestamp,event_id:bigint>,price:double>"
_BAR = "symbol bigint, bar_start timestamp, high double, low double, close double"
_CARRIED = "bars bigint, ema double, peak double, stop double, exits bigint, side int, extreme double, swings bigint, last_swing double"
CARRIED = f"{_BAR}, {_CARRIED}"
_STATE = [c.split()[0] for c in _CARRIED.split(", ")]


def _carry(span: int, trail: float, reversal: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    alpha = 2.0 / (span + 1)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        """Bars of one symbol after its carried row (the one that has ``bars``), which comes first in time."""
        pdf = pdf.sort_values("bar_start")
        n, ema, peak, exits, side, extreme, swings, last = 0, None, None, 0, 0, None, 0, None
        rows, keep = [], []
        for r in pdf.itertuples(index=False):
            if not pd.isna(r.bars):
                n, ema, peak, exits, side, extreme, swings = int(r.bars), r.ema, r.peak, int(r.exits), int(r.side), r.extreme, int(r.swings)
                last = None if pd.isna(r.last_swing) else r.last_swing
                keep.append(False)
                continue
            x = r.close
            n += 1
            if n == 1:
                ema = peak = extreme = x
            else:
                ema = ema + alpha * (x - ema)
                if r.low <= peak * (1 - trail):
                    exits, peak = exits + 1, x
                else:
                    peak = max(peak, x)
                need = extreme * reversal
                if side == 0:
                    if abs(x - extreme) >= need:
                        side, extreme = (1 if x > extreme else -1), x
                elif (x - extreme) * side >= 0:
                    extreme = x
                elif (extreme - x) * side >= need:
                    swings, last, side, extreme = swings + 1, extreme, -side, x
            keep.append(True)
            rows.append((n, ema, peak, peak * (1 - trail), exits, side, extreme, swings, last))
        bars = pdf.loc[keep, ["symbol", "bar_start", "high", "low", "close"]].reset_index(drop=True)
        state = pd.DataFrame(rows, columns=_STATE)
        state["last_swing"] = state["last_swing"].astype("float64")
        return pd.concat([bars, state], axis=1)

    return fold


def _merged_bars(parts: DataFrame) -> DataFrame:
    return parts.groupBy("symbol", "bar_start").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.max("last").alias("_l")).select(
        "symbol", "bar_start", "high", "low", C("_l.price").alias("close"))


def carry_indicators(out: str, width: str = "6 hours", span: int = 20, trail: float = 0.08, reversal: float = 0.03) -> Write:
    """foreachBatch body: EMA, trailing stop and swings of every symbol's bars, right for ticks in any order.

    A batch is reduced to partial bars, kept by batch and day, so a symbol with a third of all ticks is one row per bar.
    Every bar's row holds the whole recursion after it. Ticks that are late change their bar: the symbol is taken up from
    the row before its earliest changed bar, and the bars from there on are written again under this batch; the row of
    the latest batch counts. Only symbols of the batch are touched.

    A stop is hit by a low at or under ``peak * (1 - trail)``; the next trade's peak starts at that bar's close. Swings
    turn by ``reversal`` of the extreme. Ticks without symbol, time or price are left out.
    """
    partial = bar_parts(width)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        clean = batch.dropna(subset=["user_id", "ts", "value"])
        parts = partial(clean).select("symbol", "bar_start", "high", "low", "last", F.to_date("bar_start").alias("day"))
        parts.write.mode("overwrite").partitionBy("day").parquet(f"{out}/parts/batch={batch_id}")
        every = spark.read.schema(f"{_PART}, batch bigint, day date").parquet(f"{out}/parts")
        new = every.where(C("batch") == batch_id)
        first = new.agg(F.min("day")).first()[0]
        if first is None:
            return
        since = new.groupBy("symbol").agg(F.min("bar_start").alias("since"))
        seen = every.where((C("batch") <= batch_id) & (C("day") >= F.lit(first)))
        bars = _merged_bars(seen.join(since, "symbol").where(C("bar_start") >= C("since")))
        todo = bars.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in _CARRIED.split(", "))])
        fs, p = _hadoop(spark, f"{out}/rows")
        if fs.exists(p):
            before = spark.read.schema(f"{CARRIED}, batch bigint").parquet(f"{out}/rows").where(C("batch") < batch_id)
            before = before.join(since, "symbol").where(C("bar_start") < C("since"))
            last = before.groupBy("symbol").agg(F.max_by(F.struct("bar_start", "high", "low", "close", *_STATE), F.struct("bar_start", "batch")).alias("_r"))
            todo = todo.unionByName(last.select("symbol", "_r.*"))
        done = todo.groupBy("symbol").applyInPandas(_carry(span, trail, reversal), CARRIED)
        done.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")

    return write


def read_carried(spark: SparkSession, out: str) -> DataFrame:
    """The valid row of every bar."""
    fs, p = _hadoop(spark, f"{out}/rows")
    if not fs.exists(p):
        return spark.createDataFrame([], CARRIED)
    rows = spark.read.schema(f"{CARRIED}, batch bigint").parquet(f"{out}/rows")
    rest = [c for c in rows.columns if c not in ("symbol", "bar_start", "batch")]
    return rows.groupBy("symbol", "bar_start").agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select("symbol", "bar_start", "_r.*")
