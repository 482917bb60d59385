"""Readers and sinks of the platform's file layouts, as normalising projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import text as tx
from barloom.operators.quality import keep_last, normalize_bars

C = F.col

BAR_SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double"


def read_bars(
    spark: SparkSession, path: str, fmt: str = "parquet", *, start: str | None = None, end: str | None = None,
    symbols: DataFrame | None = None,
) -> DataFrame:
    """Bars of a date range and symbol set; year partitions and date filters reach the scan."""
    reader = spark.read.schema(BAR_SCHEMA + (", year int" if fmt == "parquet" else ""))
    df = reader.option("header", "true").csv(path) if fmt == "csv" else reader.parquet(path)
    if start:
        df = df.where(C("date") >= F.lit(start).cast("date"))
        if "year" in df.columns:
            df = df.where(C("year") >= int(start[:4]))
    if end:
        df = df.where(C("date") <= F.lit(end).cast("date"))
        if "year" in df.columns:
            df = df.where(C("year") <= int(end[:4]))
    df = df.drop("year")
    return df if symbols is None else df.join(symbols.select("symbol"), "symbol", "left_semi")


def write_bars(bars: DataFrame, path: str) -> None:
    """Parquet partitioned by year, rows clustered by symbol inside each file."""
    out = bars.withColumn("year", F.year("date"))
    out.repartition("year", "symbol").sortWithinPartitions("symbol", "date").write.mode("overwrite").partitionBy("year").parquet(path)


def first_available(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Primary cache per symbol, the legacy one for symbols it lacks, with the source named."""
    have = primary.select("symbol").distinct()
    a = primary.withColumn("source", F.lit("primary"))
    b = fallback.join(have, "symbol", "left_anti").withColumn("source", F.lit("legacy"))
    return a.unionByName(b)


def cache_audit(bars: DataFrame, minimum: int = 253) -> DataFrame:
    """PASS / REVIEW / FAIL per symbol from row count and last date."""
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.max("date").alias("last_date"), F.first("source").alias("source")
    ).withColumn("status", F.when(C("rows") < minimum, "FAIL").when(C("source") == "legacy", "REVIEW").otherwise("PASS"))


def normalize_universe(raw: DataFrame, suffix: str = ".NS") -> DataFrame:
    """Clean tickers, suffix them, fill company and sector, one row per ticker."""
    t = tx.normalize_symbol(C("ticker"), suffix)
    u = raw.select(
        t.alias("ticker"), F.coalesce(F.nullif(F.trim("company"), F.lit("")), t).alias("company"),
        F.coalesce(F.nullif(F.trim("sector"), F.lit("")), F.lit("Unknown")).alias("sector"), C("seq"),
    ).where(F.trim("ticker") != "")
    first = F.min(F.struct("seq", "company", "sector"))
    return u.groupBy("ticker").agg(first.alias("_u")).select("ticker", "_u.company", "_u.sector")


def expand_universe(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of universe lists; an earlier list wins for a ticker it already holds."""
    out = None
    for i, p in enumerate(parts):
        q = p.withColumn("priority", F.lit(i))
        out = q if out is None else out.unionByName(q)
    rest = [c for c in out.columns if c not in ("ticker", "priority")]
    return out.groupBy("ticker").agg(F.min(F.struct("priority", *rest)).alias("_u")).select("ticker", "_u.*")


def identifier_map(tickers: DataFrame, sources: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Ticker to identifier by the first source that knows it."""
    out, known = tickers, []
    for i, (src, name) in enumerate(sources):
        out = out.join(src.select("ticker", C("identifier").alias(f"_i{i}")), "ticker", "left")
        known.append((f"_i{i}", name))
    pick = F.coalesce(*[C(c) for c, _ in known])
    origin = F.lit("UNMAPPED")
    for c, name in reversed(known):
        origin = F.when(C(c).isNotNull(), name).otherwise(origin)
    return out.select("ticker", pick.alias("identifier"), origin.alias("mapped_by"))


def html_rows(pages: DataFrame, tag: str = "a") -> DataFrame:
    """(page, position, cell text) of every ``<tag>`` element, over whole pages."""
    cell = F.regexp_extract_all("html", F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(cell).alias("pos", "cell"))
    return rows.withColumn("cell", F.trim(F.regexp_replace("cell", "(?s)<[^>]*>", "")))


def feature_records(spark: SparkSession, path: str, namespace: str, end: Column) -> DataFrame:
    """Append-only JSON-lines feature store filtered by namespace and time."""
    schema = "namespace string, symbol string, timestamp timestamp, values map<string,double>"
    return spark.read.schema(schema).json(path).where((C("namespace") == namespace) & (C("timestamp") <= end))


def search_evidence(records: DataFrame, *, symbol: str | None = None, agent: str | None = None,
                    start: str | None = None, end: str | None = None) -> DataFrame:
    df = records
    if symbol:
        df = df.where(C("symbol") == symbol)
    if agent:
        df = df.where(C("agent") == agent)
    if start:
        df = df.where(C("timestamp") >= F.lit(start).cast("timestamp"))
    if end:
        df = df.where(C("timestamp") <= F.lit(end).cast("timestamp"))
    return df.orderBy("timestamp", "id")


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows replace current rows of the same key; duplicates inside incoming collapse."""
    fresh = incoming.dropDuplicates(list(keys))
    return current.join(fresh, list(keys), "left_anti").unionByName(fresh)


def pending(requests: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requests whose key has no finished row yet."""
    return requests.join(done, list(keys), "left_anti")


def write_report(df: DataFrame, path: str, fmt: str = "parquet", partition: str | None = None) -> None:
    w = df.write.mode("overwrite")
    w = w.partitionBy(partition) if partition else w
    if fmt == "csv":
        w.option("header", "true").csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def latest_bars(feed: DataFrame) -> DataFrame:
    return keep_last(normalize_bars(feed), ["symbol", "date"], "seq")


def monthly_prices(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """Monthly wide price table (period ``YYYYMmm``) to long positive prices at month end."""
    long = wide.unpivot(["period"], list(names), "material", "price").where(C("price") > 0)
    d = F.to_date(F.regexp_replace("period", "M", "-"), "yyyy-MM")
    return long.select("material", F.last_day(d).alias("date"), "price")


def completed_session(now: Column, zone: str = "Asia/Kolkata", cutoff_hour: int = 16) -> Column:
    """Latest completed weekday at the exchange's local cutoff."""
    local = F.from_utc_timestamp(now, zone)
    d = F.when(F.hour(local) < cutoff_hour, F.date_sub(F.to_date(local), 1)).otherwise(F.to_date(local))
    dow = F.dayofweek(d)
    return F.when(dow == 1, F.date_sub(d, 2)).when(dow == 7, F.date_sub(d, 1)).otherwise(d)
