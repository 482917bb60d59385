"""Queries over sources, text and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.plans import shapes as sh
from barloom.plans.registry import query
from barloom.plans.shapes import with_
from barloom.sources import readers as rd
from barloom.sources.staging import staging_root
from barloom.sources.tables import read
from barloom.streaming import jobs, stores

C = F.col


def _out(spark):
    return f"{staging_root(spark)}/stream-{uuid.uuid4().hex}"


_BARSQL = """SELECT user_id AS symbol, CAST(time_bucket(INTERVAL 30 MINUTE, ts) AS VARCHAR) AS bar_start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume
 FROM events GROUP BY user_id, time_bucket(INTERVAL 30 MINUTE, ts)"""


@query(
    "symbol:i bar_start:s open high low close volume:i",
    covers="ST-2 ST-3",
    sql=f"SELECT * FROM ({_BARSQL}) WHERE CAST(bar_start AS TIMESTAMP) + INTERVAL 30 MINUTE <= (SELECT max(date_trunc('millisecond', ts)) FROM events) - INTERVAL 1 HOUR",
)
def streamed_tick_bars(spark, sf):
    return jobs.completed_bars(jobs.run_batches(jobs.stream_table(spark, sf, "events"), jobs.bar_parts(), _out(spark)))


@query(
    "user_id:i session_start:s ticks:i",
    covers="ST-2",
    sql="""SELECT user_id, CAST(min(ts) AS VARCHAR) AS session_start, count(*) AS ticks FROM (SELECT user_id, ts, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n
  FROM (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS o FROM events))
 GROUP BY user_id, n HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(date_trunc('millisecond', ts)) FROM events) - INTERVAL 1 HOUR""",
)
def streamed_sessions(spark, sf):
    return jobs.closed_sessions(jobs.run_batches(jobs.stream_table(spark, sf, "events"), jobs.session_parts(), _out(spark)))


@query(
    "event_type:s window_start:s ticks:i volume:f4",
    covers="ST-3",
    sql="""SELECT event_type, CAST(w AS VARCHAR) AS window_start, count(*) AS ticks, sum(value) AS volume FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1, 2""",
)
def streamed_sliding_volume(spark, sf):
    return jobs.sliding_volume(jobs.run_batches(jobs.stream_table(spark, sf, "events"), jobs.volume_parts(), _out(spark)))


@query(
    "user_id:i event_type:s rows:i",
    covers="ST-6",
    sql="SELECT user_id, event_type, count(DISTINCT event_id) AS rows FROM events GROUP BY ALL",
)
def streamed_unique_history(spark, sf):
    ev = jobs.stream_table(spark, sf, "events")
    twice = ev.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    h = jobs.unique_history(jobs.run_batches(twice, lambda b: b.dropDuplicates(["event_id"]), _out(spark)), ["event_id"])
    return h.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "symbol:i ticks:i last_ema:f4",
    covers="ST-4",
    sql="""WITH RECURSIVE t AS MATERIALIZED (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events),
 e AS (SELECT user_id, rn, n, value AS ema FROM t WHERE rn = 1 UNION ALL SELECT t.user_id, t.rn, t.n, e.ema + 2.0 / 21 * (t.value - e.ema) FROM e JOIN t ON t.user_id = e.user_id AND t.rn = e.rn + 1)
 SELECT user_id AS symbol, n AS ticks, ema AS last_ema FROM e WHERE rn = n""",
)
def streamed_carried_ema(spark, sf):
    ticks = jobs.stream_table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    r = jobs.run_available(jobs.carried_ema(ticks), _out(spark))
    return r.groupBy("symbol").agg(F.count(F.lit(1)).alias("ticks"), F.max_by("ema", F.struct("ts", "event_id")).alias("last_ema"))


@query(
    "symbol:i matches:i",
    covers="ST-7",
    sql="SELECT r.user_id AS symbol, count(*) AS matches FROM (SELECT * FROM events WHERE event_type = 'signup') r JOIN (SELECT * FROM events WHERE event_type = 'error') f ON f.user_id = r.user_id AND f.ts BETWEEN r.ts AND r.ts + INTERVAL 2 DAY GROUP BY 1",
)
def streamed_filing_matches(spark, sf):
    out = _out(spark)
    side = F.when(C("event_type") == "signup", "left").when(C("event_type") == "error", "right")
    ev = jobs.stream_table(spark, sf, "events").where(C("event_type").isin("signup", "error"))
    rows = ev.select(side.alias("side"), C("user_id").alias("symbol"), C("ts").alias("at"), C("event_id").alias("reference"))
    stores.run_store(rows, stores.interval_matches(out, 2), f"{out}/checkpoint")
    return stores.read_matches(spark, out).groupBy("symbol").agg(F.count(F.lit(1)).alias("matches"))


@query(
    "symbol:i date:d close fetched:i",
    covers="ST-1 SRC-6",
    sql="""SELECT user_id AS symbol, d AS date, arg_max(value, (ts, event_id)) AS close, CASE WHEN d >= (SELECT max(CAST(ts AS DATE)) FROM events WHERE CAST(ts AS DATE) <= (SELECT max(CAST(ts AS DATE)) FROM events) - 10) - 5 THEN 2 ELSE 1 END AS fetched
 FROM (SELECT *, CAST(ts AS DATE) AS d FROM events) GROUP BY user_id, d""",
)
def streamed_bar_upsert(spark, sf):
    """Closes up to ten days before the end, then a second query that fetches again from five days before the last close."""
    out, day = _out(spark), F.to_date("ts")
    rows = "symbol bigint, date date, close double, fetched int, ts timestamp, event_id bigint"

    def fetch(number, wanted):
        ticks = jobs.stream_table(spark, sf, "events").where(wanted).select(
            C("user_id").alias("symbol"), day.alias("date"), C("value").alias("close"), F.lit(number).alias("fetched"), "ts", "event_id")
        merge = stores.merge_by_month(f"{out}/bars", ["symbol", "date"], ["fetched", "ts", "event_id"], f"fetch{number}")
        stores.run_store(ticks, merge, f"{out}/checkpoint{number}")
        return stores.read_merged(spark, f"{out}/bars", rows)

    end = read(spark, sf, "events").agg(F.date_sub(F.max(day), 10)).first()[0]
    if end is None:
        return spark.createDataFrame([], rows)
    last = fetch(1, day <= F.lit(end)).agg(F.max("date")).first()[0]
    return fetch(2, F.lit(True) if last is None else day >= F.date_sub(F.lit(last), 5))


@query(
    "symbol:i bar_start:s ema:f4 stop:f4 exits:i swings:i last_swing:f4",
    covers="ST-4",
    sql="""WITH RECURSIVE b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_start) AS rn FROM (SELECT user_id AS symbol, time_bucket(INTERVAL 6 HOUR, ts) AS bar_start, min(value) AS low, arg_max(value, (ts, event_id)) AS x FROM events GROUP BY ALL)),
 e AS (SELECT symbol, rn, bar_start, x AS ema, x AS peak, CAST(0 AS BIGINT) AS exits, 0 AS side, x AS ext, CAST(0 AS BIGINT) AS swings, NULL::DOUBLE AS last_swing FROM b WHERE rn = 1
 UNION ALL SELECT symbol, rn, bar_start, ema + 2.0 / 21 * (x - ema), CASE WHEN hit THEN x ELSE greatest(peak, x) END, exits + CAST(hit AS BIGINT), CASE WHEN opens THEN CASE WHEN x > ext THEN 1 ELSE -1 END WHEN turns THEN -side ELSE side END,
  CASE WHEN opens OR goes OR turns THEN x ELSE ext END, swings + CAST(turns AS BIGINT), CASE WHEN turns THEN ext ELSE last_swing END
 FROM (SELECT *, side <> 0 AND NOT goes AND (ext - x) * side >= ext * 0.03 AS turns FROM (SELECT b.symbol, b.rn, b.bar_start, b.x, e.ema, e.peak, e.exits, e.side, e.ext, e.swings, e.last_swing, b.low <= e.peak * (1 - 0.08::DOUBLE) AS hit,
  e.side = 0 AND abs(b.x - e.ext) >= e.ext * 0.03 AS opens, e.side <> 0 AND (b.x - e.ext) * e.side >= 0 AS goes FROM e JOIN b ON b.symbol = e.symbol AND b.rn = e.rn + 1)))
 SELECT symbol, CAST(bar_start AS VARCHAR) AS bar_start, ema, peak * (1 - 0.08::DOUBLE) AS stop, exits, swings, last_swing FROM e""",
)
def streamed_carried_indicators(spark, sf):
    out = _out(spark)
    ticks = jobs.stream_table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    stores.run_store(ticks, stores.carry_indicators(out), f"{out}/checkpoint")
    return stores.read_carried(spark, out)


@query(
    "page_id:i pos:i cell:s",
    covers="SRC-16",
    sql=r"""SELECT page_id, pos, trim(regexp_replace(cell, '(?s)<[^>]*>', '', 'g')) AS cell FROM (SELECT page_id, unnest(c) AS cell, generate_subscripts(c, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li(?:\s[^>]*)?>(.*?)</li>', 1) AS c FROM pages))""",
)
def html_list_rows(spark, sf):
    return rd.html_rows(read(spark, sf, "pages"), "li")


@query(
    "ticker:s company:s sector:s",
    covers="SRC-7 SCA-5 SRC-22",
    sql="SELECT upper('sup' || s_suppkey) || '.NS' AS ticker, s_name AS company, n_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)
def normalized_universe(spark, sf):
    s, n = read(spark, sf, "supplier"), read(spark, sf, "nation")
    base = s.join(n, s.s_nationkey == n.n_nationkey)
    raw = base.select(F.concat(F.lit(" sup"), C("s_suppkey")).alias("ticker"), C("s_name").alias("company"), C("n_name").alias("sector"), F.lit(0).alias("seq"))
    again = base.select(F.concat(F.lit("SUP"), C("s_suppkey"), F.lit(".NS")).alias("ticker"), F.lit("x").alias("company"), F.lit("y").alias("sector"), F.lit(1).alias("seq"))
    return rd.normalize_universe(raw.unionByName(again))


@query(
    "ticker:s priority:i company:s",
    covers="SRC-8",
    sql="SELECT 'S' || s_suppkey AS ticker, CASE WHEN s_acctbal > 5000 THEN 0 ELSE 1 END AS priority, s_name AS company FROM supplier",
)
def expanded_universe(spark, sf):
    s = read(spark, sf, "supplier").select(F.concat(F.lit("S"), C("s_suppkey")).alias("ticker"), C("s_name").alias("company"), "s_acctbal")
    return rd.expand_universe([s.where(C("s_acctbal") > 5000).drop("s_acctbal"), s.drop("s_acctbal")])


@query(
    "ticker:s identifier:s mapped_by:s",
    covers="SRC-17 SRC-15",
    sql="SELECT 'S' || s_suppkey AS ticker, CASE WHEN s_suppkey % 3 = 0 THEN 'ISIN' || s_suppkey WHEN s_suppkey % 2 = 0 THEN 'CODE' || s_suppkey END AS identifier, CASE WHEN s_suppkey % 3 = 0 THEN 'exchange' WHEN s_suppkey % 2 = 0 THEN 'current' ELSE 'UNMAPPED' END AS mapped_by FROM supplier",
)
def identifier_map(spark, sf):
    s = read(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("S"), C("s_suppkey")).alias("ticker"))
    a = s.where(C("s_suppkey") % 3 == 0).select("ticker", F.concat(F.lit("ISIN"), C("s_suppkey")).alias("identifier"))
    b = s.where(C("s_suppkey") % 2 == 0).select("ticker", F.concat(F.lit("CODE"), C("s_suppkey")).alias("identifier"))
    return rd.identifier_map(s.select("ticker"), [(a, "exchange"), (b, "current")])


@query(
    "symbol:s rows:i last_date:d source:s status:s",
    covers="SRC-1 SRC-2",
    sql=with_("bars", "SELECT symbol, count(*) AS rows, max(date) AS last_date, CASE WHEN CAST(substr(symbol, 2) AS BIGINT) % 4 <> 0 THEN 'primary' ELSE 'legacy' END AS source, CASE WHEN count(*) < 253 THEN 'FAIL' WHEN CAST(substr(symbol, 2) AS BIGINT) % 4 = 0 THEN 'REVIEW' ELSE 'PASS' END AS status FROM bars GROUP BY symbol"),
)
def cache_audit(spark, sf):
    b = sh.bars(spark, sf)
    key = F.substring("symbol", 2, 20).cast("bigint")
    return rd.cache_audit(rd.first_available(b.where(key % 4 != 0), b))


@query(
    "symbol:s date:d close:f8",
    covers="SRC-12 SRC-21",
    sql=with_("bars", "SELECT symbol, date, CASE WHEN year(date) = 2000 THEN close + 1 ELSE close END AS close FROM bars"),
)
def keyed_upsert(spark, sf):
    b = sh.bars(spark, sf).select("symbol", "date", "close")
    fresh = b.where(F.year("date") == 2000).withColumn("close", C("close") + 1)
    return rd.upsert(b, fresh.unionByName(fresh), ["symbol", "date"])


@query(
    "symbol:s rows:i",
    covers="JOIN-22",
    sql=with_("bars", "SELECT symbol, count(*) AS rows FROM bars WHERE year(date) <> 1999 GROUP BY symbol"),
)
def pending_evaluations(spark, sf):
    b = sh.bars(spark, sf)
    done = b.where(F.year("date") == 1999).select("symbol", "date")
    return rd.pending(b, done, ["symbol", "date"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "event_id:i session:d",
    covers="FIL-12",
    sql="""SELECT event_id, d - CASE isodow(d) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS session FROM (SELECT event_id, CASE WHEN hour(l) < 16 THEN CAST(l AS DATE) - 1 ELSE CAST(l AS DATE) END AS d FROM (SELECT event_id, ts + INTERVAL 330 MINUTE AS l FROM events))""",
)
def completed_sessions(spark, sf):
    return read(spark, sf, "events").select("event_id", rd.completed_session(C("ts")).alias("session"))


@query(
    "user_id:i event_id:i k:i",
    covers="FIL-14 SCA-20 SRC-14",
    sql="SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'",
)
def evidence_search(spark, sf):
    rec = read(spark, sf, "events").select(
        C("event_id").alias("id"), C("user_id").cast("string").alias("symbol"), C("event_type").alias("agent"), C("ts").alias("timestamp"),
        F.from_json("props", "k bigint")["k"].alias("k"))
    found = rd.search_evidence(rec, agent="error", start="2024-01-05", end="2024-01-20")
    return found.select(C("symbol").alias("user_id"), C("id").alias("event_id"), "k")
