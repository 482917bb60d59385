"""Structured Streaming jobs: bars from ticks, incremental upserts, carried indicators, alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

C = F.col


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def stream_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """File stream over one table of a data folder, a file or a folder of part files; the schema is read from the files.

    ``files_per_trigger`` only splits the backlog into micro-batches. The jobs below give the same rows for any split
    and any order of files.
    """
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    # event time must carry a zone; stored instants are UTC
    naive = [c for c, k in df.dtypes if k == "timestamp_ntz"]
    return df.withColumns({c: C(c).cast("timestamp") for c in naive})


def run_available(df: DataFrame, out: str, mode: str = "append") -> DataFrame:
    """Process everything available into a Parquet sink (exactly once) and read it back."""
    q = (
        df.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{out}/data")


def run_batches(df: DataFrame, partial: Callable[[DataFrame], DataFrame], out: str) -> DataFrame:
    """Reduce every micro-batch with ``partial`` into a folder of its own and read all of them.

    A replayed batch rewrites its folder. Partial results of any batch split merge to the same rows, so nothing is
    dropped for being late; what is complete is decided where they are merged.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    q = df.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    schema = partial(df.sparkSession.createDataFrame([], df.schema)).schema
    return df.sparkSession.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{out}/data")


def bar_parts(width: str = "30 minutes") -> Callable[[DataFrame], DataFrame]:
    """Partial OHLCV bars of one batch: first and last tick with their places, extremes, count, latest time seen."""
    price, at = C("value"), F.struct("ts", "event_id")

    def partial(ticks: DataFrame) -> DataFrame:
        bars = ticks.groupBy(F.window("ts", width).alias("w"), C("user_id").alias("symbol")).agg(
            F.min(F.struct(at.alias("at"), price.alias("price"))).alias("first"), F.max(price).alias("high"), F.min(price).alias("low"),
            F.max(F.struct(at.alias("at"), price.alias("price"))).alias("last"), F.count(F.lit(1)).alias("volume"), F.max("ts").alias("seen"),
        )
        return bars.select("symbol", C("w.start").alias("bar_start"), C("w.end").alias("bar_end"), "first", "high", "low", "last", "volume", "seen")

    return partial


def completed_bars(parts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Bars whose end lies ``delay`` before the latest tick of all batches (in milliseconds, as a watermark counts)."""
    bars = parts.groupBy("symbol", "bar_start", "bar_end").agg(
        F.min("first").alias("f"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("last").alias("l"), F.sum("volume").alias("volume"),
    )
    seen = F.date_trunc("millisecond", F.max("seen")) - F.expr(f"INTERVAL {delay}")
    bars = bars.where(C("bar_end") <= parts.agg(seen.alias("limit")).scalar())
    return bars.select("symbol", "bar_start", "bar_end", C("f.price").alias("open"), "high", "low", C("l.price").alias("close"), "volume")


def volume_parts(width: str = "2 hours", step: str = "1 hour") -> Callable[[DataFrame], DataFrame]:
    """Partial sliding volumes of one batch."""
    return lambda ticks: ticks.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("ticks"), F.sum("value").alias("volume")
    ).select("event_type", C("w.start").alias("window_start"), "ticks", "volume")


def sliding_volume(parts: DataFrame) -> DataFrame:
    return parts.groupBy("event_type", "window_start").agg(F.sum("ticks").alias("ticks"), F.sum("volume").alias("volume"))


def session_parts(gap: str = "6 hours") -> Callable[[DataFrame], DataFrame]:
    """Sessions as one batch sees them."""
    return lambda ticks: ticks.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(
        F.count(F.lit(1)).alias("ticks"), F.max("ts").alias("seen")
    ).select("user_id", C("w.start").alias("session_start"), C("w.end").alias("session_end"), "ticks", "seen")


def closed_sessions(parts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Sessions of all batches: overlapping parts are one. Only those that ended ``delay`` before the latest tick."""
    order = Window.partitionBy("user_id").orderBy("session_start", "session_end")
    before = F.max("session_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    df = parts.withColumn("_opens", F.coalesce(C("session_start") > before, F.lit(True)).cast("int"))
    df = df.withColumn("_n", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.groupBy("user_id", "_n").agg(F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"), F.sum("ticks").alias("ticks"))
    limit = parts.agg((F.date_trunc("millisecond", F.max("seen")) - F.expr(f"INTERVAL {delay}")).alias("limit")).scalar()
    return df.where(C("session_end") <= limit).select("user_id", "session_start", "session_end", "ticks")


def unique_history(parts: DataFrame, keys: list[str]) -> DataFrame:
    """History of all batches, one row per key however often it was delivered: the least of its rows."""
    rest = [c for c in parts.columns if c not in keys]
    return parts.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*")


def alert_batches(rules: Callable[[DataFrame], DataFrame], watchlist: DataFrame, out: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: alerts of watched symbols, one folder per batch id (replay safe)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        hits = rules(batch.join(watchlist.select("symbol"), "symbol", "left_semi"))
        hits.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return write


def filing_matches(results: DataFrame, filings: DataFrame, max_days: int = 120, lateness: str | None = None) -> DataFrame:
    """Interval join of two streams: filings 0..max_days after the period end of their symbol.

    With ``lateness`` rows later than that are dropped and old state goes; without it every pair is found.
    """
    if lateness:
        results, filings = results.withWatermark("period_ts", lateness), filings.withWatermark("filed_ts", lateness)
    r, f = results.alias("r"), filings.alias("f")
    cond = (
        (C("r.symbol") == C("f.symbol")) & (C("f.filed_ts") >= C("r.period_ts"))
        & (C("f.filed_ts") <= C("r.period_ts") + F.expr(f"INTERVAL {max_days} DAYS"))
    )
    return r.join(f, cond).select(C("r.symbol").alias("symbol"), "period_ts", "filed_ts", "reference")


EMA_OUT = "symbol bigint, ts timestamp, event_id bigint, value double, ema double"


def carried_ema(ticks: DataFrame, span: int = 20) -> DataFrame:
    """EMA per symbol whose last value is kept as state between micro-batches.

    A recursion over arrival: ticks are ordered inside a batch, so batches must arrive in time order.
    """
    alpha = 2.0 / (span + 1)

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ema = state.get[0] if state.exists else None
        rows = pd.concat(list(pdfs)).sort_values(["ts", "event_id"])
        out = []
        for v in rows["value"]:
            ema = v if ema is None else ema + alpha * (v - ema)
            out.append(ema)
        state.update((float(ema),))
        yield pd.DataFrame({"symbol": key[0], "ts": rows["ts"].to_numpy(), "event_id": rows["event_id"].to_numpy(), "value": rows["value"].to_numpy(), "ema": out})

    return ticks.groupBy("user_id").applyInPandasWithState(
        step, EMA_OUT, "ema double", "append", GroupStateTimeout.NoTimeout
    )
