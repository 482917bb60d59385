"""Panels derived from the star-schema tables, as Spark plans and as SQL text.

symbol = supplier, session = ship week, price = extended price per unit,
sector = the supplier's nation, group = its region.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.staging import stage
from barloom.sources.tables import read


def _symbol(key: str):
    return F.format_string("S%012d", F.col(key).cast("bigint"))


def trade_order(freq: str):
    """Place of a line inside its session as one decimal: day, order, line number, part.

    A struct key would force sort-based aggregation; a decimal keeps hash aggregation with
    map-side combine. Keys stay below 10^13 up to a scale factor of about a million.
    """
    day = F.datediff(F.to_date("l_shipdate"), F.to_date(F.date_trunc(freq, "l_shipdate"))).cast("bigint")
    head = (day * F.lit(10**13) + F.col("l_orderkey")) * F.lit(100) + F.col("l_linenumber")
    shift = F.lit(10**13).cast("decimal(14,0)")
    return (head.cast("decimal(19,0)") * shift + F.col("l_partkey").cast("decimal(13,0)")).cast("decimal(38,0)")


def bar_aggs(freq: str):
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = trade_order(freq)
    return [
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, order).alias("close"), F.sum("l_quantity").alias("volume"),
    ]


def bars(spark: SparkSession, sf: str, freq: str = "week") -> DataFrame:
    """OHLCV bars per symbol and session; one row per key after map-side combine."""
    li = read(spark, sf, "lineitem").where(F.col("l_quantity") > 0)
    return (
        li.groupBy(
            F.col("l_suppkey"),
            F.date_trunc(freq, "l_shipdate").cast("date").alias("date"),
        )
        .agg(*bar_aggs(freq))
        .select(_symbol("l_suppkey").alias("symbol"), "date", "open", "high", "low", "close", "volume")
    )


def benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """Equal-weight index of all bars."""
    return index_of(bars(spark, sf))


def index_of(panel: DataFrame) -> DataFrame:
    """Equal-weight index: average OHLC of the bars of a session, one row per date."""
    return panel.groupBy("date").agg(
        F.avg("open").alias("open"),
        F.avg("high").alias("high"),
        F.avg("low").alias("low"),
        F.avg("close").alias("close"),
        F.sum("volume").alias("volume"),
    )


def stored_bars(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Bars and their index, each written once, for plans that read them several times."""
    panel = stage(bars(spark, sf), "bars")
    return panel, stage(index_of(panel), "bench")


def universe(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "supplier")
    n = read(spark, sf, "nation")
    r = read(spark, sf, "region")
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            _symbol("s_suppkey").alias("symbol"),
            F.col("s_name").alias("company"),
            F.col("n_name").alias("sector"),
            F.col("r_name").alias("region"),
            F.col("s_acctbal").alias("balance"),
        )
    )


def sector_bars(spark: SparkSession, sf: str, panel: DataFrame | None = None) -> DataFrame:
    """Bars (or ``panel``) with sector and region; a missing dimension row becomes Unknown."""
    u = universe(spark, sf).select("symbol", "sector", "region")
    return (
        (bars(spark, sf) if panel is None else panel)
        .join(u, "symbol", "left")
        .fillna({"sector": "Unknown", "region": "Unknown"})
    )


def region_days(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars per region: a few long, dense series."""
    li = read(spark, sf, "lineitem").where(F.col("l_quantity") > 0)
    s = read(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    n = read(spark, sf, "nation")
    r = read(spark, sf, "region")
    j = (
        li.join(s, li.l_suppkey == s.s_suppkey)
        .join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return j.groupBy(F.col("r_name").alias("symbol"), F.to_date("l_shipdate").alias("date")).agg(*bar_aggs("day"))


_AGGS = """
  arg_min(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS open,
  max(l_extendedprice / l_quantity) AS high,
  min(l_extendedprice / l_quantity) AS low,
  arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS close,
  sum(l_quantity) AS volume"""

SQL_BARS = f"""bars AS MATERIALIZED (
 SELECT printf('S%012d', l_suppkey) AS symbol,
  CAST(date_trunc('week', l_shipdate) AS DATE) AS date,{_AGGS}
 FROM lineitem WHERE l_quantity > 0 GROUP BY ALL)"""

SQL_BENCH = """bench AS MATERIALIZED (
 SELECT date, avg(open) AS open, avg(high) AS high, avg(low) AS low, avg(close) AS close,
  sum(volume) AS volume FROM bars GROUP BY date)"""

SQL_UNI = """uni AS MATERIALIZED (
 SELECT printf('S%012d', s_suppkey) AS symbol, s_name AS company,
  n_name AS sector, r_name AS region, s_acctbal AS balance
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

SQL_SBARS = """sbars AS MATERIALIZED (
 SELECT b.*, coalesce(u.sector, 'Unknown') AS sector, coalesce(u.region, 'Unknown') AS region
 FROM bars b LEFT JOIN uni u USING (symbol))"""

SQL_REGION_DAYS = f"""rdays AS MATERIALIZED (
 SELECT r_name AS symbol, CAST(l_shipdate AS DATE) AS date,{_AGGS}
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
 JOIN region ON n_regionkey = r_regionkey WHERE l_quantity > 0 GROUP BY ALL)"""

_CTES = {
    "bars": (SQL_BARS, ()),
    "bench": (SQL_BENCH, ("bars",)),
    "uni": (SQL_UNI, ()),
    "sbars": (SQL_SBARS, ("bars", "uni")),
    "rdays": (SQL_REGION_DAYS, ()),
}


def define_cte(name: str, body: str, needs: str = "") -> None:
    """Make a named SQL building block available to :func:`with_`."""
    _CTES[name] = (f"{name} AS MATERIALIZED (\n{body}\n)", tuple(needs.split()))


def with_(needs: str, select: str, **local: str) -> str:
    """``WITH`` clause holding the named blocks (and what they need), then ``select``."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in _CTES[name][1]:
            visit(dep)
        order.append(name)

    for name in needs.split():
        visit(name)
    parts = [_CTES[n][0] for n in order]
    parts += [f"{n} AS MATERIALIZED (\n{body}\n)" for n, body in local.items()]
    recursive = "RECURSIVE " if any("/*recursive*/" in p for p in parts) else ""
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + select
