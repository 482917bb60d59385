"""Stored merges, interval matches and carried indicators: any split, any order, replays."""

import datetime as dt
import random

import pytest

from barloom.streaming import stores

T0 = dt.datetime(2024, 1, 30)
BARS = "symbol string, date date, close double, seq int"


def _day(n):
    return dt.date(2024, 1, 28) + dt.timedelta(days=n)


def _stored(spark, table):
    return {(r["symbol"], r["date"]): (r["close"], r["seq"]) for r in stores.read_merged(spark, table, BARS).collect()}


def test_merge_keeps_the_last_write_per_key(spark, tmp_path):
    table = str(tmp_path / "bars")
    rng = random.Random(2)
    batches = [[(rng.choice("AB"), _day(rng.randrange(8)), float(rng.randrange(99)), seq) for seq in rng.sample(range(1000), 12)] for _ in range(3)]
    want = {}
    for s, d, c, q in sorted((r for b in batches for r in b), key=lambda r: r[3]):
        want[s, d] = (c, q)
    assert _stored(spark, table) == {}
    # the last batch first, a null key, and each batch twice
    write = stores.merge_by_month(table, ["symbol", "date"], ["seq"], "a")
    for n, rows in enumerate(reversed(batches)):
        df = spark.createDataFrame([*rows, (None, _day(0), 1.0, 5000)], BARS)
        write(df, n)
        write(df, n)
    assert _stored(spark, table) == want
    assert [v for v, _ in stores._versions(spark, table)] == [0, 1, 2]


def test_merge_writes_touched_months_and_survives_half_a_batch(spark, tmp_path):
    table = str(tmp_path / "bars")
    one = lambda *rows: spark.createDataFrame(list(rows), BARS)
    stores.merge_by_month(table, ["symbol", "date"], ["seq"], "a")(one(("A", _day(0), 1.0, 1), ("A", _day(9), 2.0, 1)), 0)
    # a batch that was lost before its pointer left folders behind
    spark.createDataFrame([("A", _day(0), 99.0, 9)], BARS).write.parquet(f"{table}/data/1/month=2024-01")
    assert _stored(spark, table) == {("A", _day(0)): (1.0, 1), ("A", _day(9)): (2.0, 1)}
    # a later query starts at batch 0 again
    stores.merge_by_month(table, ["symbol", "date"], ["seq"], "b")(one(("A", _day(9), 3.0, 2), ("B", _day(9), 4.0, 2)), 0)
    assert _stored(spark, table) == {("A", _day(0)): (1.0, 1), ("A", _day(9)): (3.0, 2), ("B", _day(9)): (4.0, 2)}
    assert stores._months(spark, table, 1) == {"2024-01": 0, "2024-02": 1}


def _events(n, seed):
    rng = random.Random(seed)
    return [(rng.choice((1, 1, 1, 2)), T0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 9)), k, float(rng.randrange(80, 121))) for k in range(n)]


@pytest.mark.parametrize("split", [1, 4])
def test_interval_matches_find_every_pair_once(spark, tmp_path, split):
    out = str(tmp_path / f"m{split}")
    rows = [("left" if k % 3 else "right", s, t, k) for s, t, k, _ in _events(90, 7)]
    rows += [("left", 1, T0, 900), ("right", 1, T0, 901), ("right", 1, T0 + dt.timedelta(days=2), 902), ("right", 1, T0 + dt.timedelta(days=2, microseconds=1), 903), ("left", None, T0, 904), ("right", 1, None, 905)]
    random.Random(1).shuffle(rows)
    write = stores.interval_matches(out, 2)
    for n in range(split):
        df = spark.createDataFrame(rows[n::split], stores.SIDES)
        write(df, n)
        if n == 1:
            write(df, n)
    write(spark.createDataFrame([], stores.SIDES), split)
    got = sorted((r["symbol"], r["period_ts"], r["filed_ts"], r["reference"]) for r in stores.read_matches(spark, out).collect())
    full = [r for r in rows if None not in r]
    want = sorted((a[1], a[2], b[2], b[3]) for a in full for b in full
                  if a[0] == "left" and b[0] == "right" and a[1] == b[1] and a[2] <= b[2] <= a[2] + dt.timedelta(days=2))
    assert got == want and want


def test_no_rows_give_no_matches_and_no_indicators(spark, tmp_path):
    stores.interval_matches(str(tmp_path / "m"), 2)(spark.createDataFrame([], stores.SIDES), 0)
    assert stores.read_matches(spark, str(tmp_path / "m")).count() == 0
    stores.carry_indicators(str(tmp_path / "c"))(spark.createDataFrame([], TICKS), 0)
    assert stores.read_carried(spark, str(tmp_path / "c")).count() == 0


TICKS = "user_id bigint, ts timestamp, event_id bigint, value double"


def _plain(ticks):
    """Indicators of six-hour bars over all ticks at once."""
    bars = {}
    for s, t, k, v in sorted(ticks, key=lambda r: (r[0], r[1], r[2])):
        b = bars.setdefault((s, t.replace(hour=t.hour // 6 * 6, minute=0)), [v, v])
        b[0], b[1] = min(b[0], v), v
    out, symbol = {}, None
    for (s, at), (low, x) in sorted(bars.items()):
        if s != symbol:
            symbol, ema, peak, exits, side, ext, swings, last = s, x, x, 0, 0, x, 0, None
        else:
            ema += 2 / 21 * (x - ema)
            exits, peak = (exits + 1, x) if low <= peak * (1 - 0.08) else (exits, max(peak, x))
            if side == 0:
                if abs(x - ext) >= ext * 0.03:
                    side, ext = (1 if x > ext else -1), x
            elif (x - ext) * side >= 0:
                ext = x
            elif (ext - x) * side >= ext * 0.03:
                swings, last, side, ext = swings + 1, ext, -side, x
        out[s, at] = (round(ema, 9), round(peak * 0.92, 9), exits, side, swings, last)
    return out


@pytest.mark.parametrize("order", ["time", "reverse", "shuffled"])
def test_carried_indicators_do_not_depend_on_arrival(spark, tmp_path, order):
    out, ticks = str(tmp_path / order), _events(160, 3)
    rows = sorted(ticks, key=lambda r: r[1], reverse=order == "reverse")
    if order == "shuffled":
        random.Random(4).shuffle(rows)
    write = stores.carry_indicators(out)
    for n in range(4):
        df = spark.createDataFrame([*rows[n * 40:(n + 1) * 40], (None, T0, 1, 1.0), (1, T0, 999, None)], TICKS)
        write(df, n)
        if n == 2:
            write(df, n)
    got = {(r["symbol"], r["bar_start"]): (round(r["ema"], 9), round(r["stop"], 9), r["exits"], r["side"], r["swings"], r["last_swing"])
           for r in stores.read_carried(spark, out).collect()}
    assert got == _plain(ticks)


def test_streams_into_stores_do_not_depend_on_files(spark, tmp_path):
    from barloom.streaming import jobs

    rows = spark.createDataFrame(_events(200, 11), "user_id bigint, ts timestamp, event_id bigint, value double")
    results = []
    for k, files in enumerate((1, 7)):
        folder = tmp_path / f"in{k}"
        rows.orderBy("value").repartition(files).write.parquet(f"{folder}/events.parquet")
        out = str(tmp_path / f"out{k}")
        stores.run_store(jobs.stream_table(spark, str(folder), "events", 2), stores.carry_indicators(out), f"{out}/checkpoint")
        results.append(sorted(map(tuple, stores.read_carried(spark, out).collect())))
    assert results[0] == results[1] and results[0]
