"""Benchmark decontamination with DataFrame functions only.

Words are maximal runs of a-z, 0-9 and characters from U+0080 on, after lower-casing A-Z. A window is ``n`` consecutive
words of a benchmark item; an item of fewer words (but not none) is one window. Each document row carries the 64-bit
hashes of its own windows, built by doubling (pairs, fours, eights ...), so the scan is one pass without a shuffle. The
hash set of benchmark windows travels inside the plan while it has at most ``max_windows`` entries (counted first); a
larger benchmark is joined on the hash instead. Every hash hit is verified against the words themselves.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import ascii_lower

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Size bound of the hash set that is sent with the plan (about 10 MB with its texts).
MAX_WINDOWS = 50_000


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _mixed(df: DataFrame, left: str, right: str, offset: int, length: int, out: str) -> DataFrame:
    """``out[i]`` = hash of ``left[i]`` and ``right[i + offset]`` for each window of ``length`` words."""
    n = F.greatest(F.col("n_words") - (length - 1), F.lit(0))
    pair = F.zip_with(F.slice(left, 1, n), F.slice(right, offset + 1, n), lambda x, y: F.xxhash64(x, y))
    return df.withColumn(out, pair)


def window_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds ``w<length>``: the hash of the window at every position of ``words`` (beside ``n_words``)."""
    df = df.withColumn("p1", F.transform("words", lambda w: F.xxhash64(w)))
    size, temporary = 1, ["p1"]
    while size * 2 <= max(lengths):
        df = _mixed(df, f"p{size}", f"p{size}", size, size * 2, f"p{size * 2}")
        size *= 2
        temporary.append(f"p{size}")
    for length in lengths:
        bits = [1 << b for b in reversed(range(length.bit_length())) if length >> b & 1]
        name, done = f"p{bits[0]}", bits[0]
        for b in bits[1:]:
            done += b
            df = _mixed(df, name, f"p{b}", done - b, done, f"w{length}_{done}")
            name = f"w{length}_{done}"
            temporary.append(name)
        df = df.withColumn(f"w{length}", F.col(name))
    return df.drop(*temporary)


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Distinct windows of all items: hash, len, gram (words joined by blanks), items (ids as sorted strings).

    Items without words or with null text have none. A null item_id still marks words but is not listed.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    items = items.withColumn("n_words", F.size("words")).where("n_words > 0").withColumn("len", F.least("n_words", F.lit(n)))
    grams = items.select(
        "item_id", "len", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("len") + 1)).alias("at"), "words"
    ).select("item_id", "len", F.array_join(F.slice("words", F.col("at"), F.col("len")), " ").alias("gram"))
    grams = grams.groupBy("len", "gram").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    hashed = grams.withColumn("words", F.split("gram", " ")).withColumn("n_words", F.col("len"))
    hashed = window_hashes(hashed, list(range(1, n + 1)))
    own = F.coalesce(*[F.when(F.col("len") == i, F.get(f"w{i}", F.lit(0))) for i in range(1, n + 1)])
    return hashed.select(own.alias("hash"), "len", "gram", "items")


def _hits_by_set(docs: DataFrame, windows: list, lengths: list[int]) -> DataFrame:
    """Adds ``hits``: verified (start, len, items) of each document, from a hash set inside the plan."""
    docs = window_hashes(docs, lengths)
    known: dict[str, list] = {}
    for w in windows:
        known.setdefault(str(w["hash"]), []).append({"gram": w["gram"], "items": list(w["items"])})
    lookup = F.from_json(F.lit(json.dumps(known)), "map<string,array<struct<gram:string,items:array<string>>>>")
    parts = []
    for length in lengths:
        hashes = ",".join(f"{w['hash']}L" for w in windows if w["len"] == length)
        inside = F.expr(f"filter(sequence(0, size(w{length}) - 1), i -> w{length}[i] IN ({hashes}))")
        docs = docs.withColumn(f"at{length}", F.when(F.size(f"w{length}") > 0, inside))
        docs = docs.drop(f"w{length}").withColumnRenamed(f"at{length}", f"w{length}")
        parts.append(length)
    docs = docs.withColumn("any_hit", F.lit(False))
    for length in parts:
        docs = docs.withColumn("any_hit", F.col("any_hit") | F.coalesce(F.size(f"w{length}") > 0, F.lit(False)))

    def verified(length: int) -> Column:
        def one(i: Column) -> Column:
            gram = F.array_join(F.slice("words", i + 1, F.lit(length)), " ")
            same = F.filter(F.try_element_at(lookup, _hash_of_gram(gram, length).cast("string")), lambda w: w["gram"] == gram)
            return F.struct(i.alias("start"), F.lit(length).alias("len"), F.get(same, F.lit(0))["items"].alias("items"))

        return F.filter(F.transform(F.col(f"w{length}"), one), lambda h: h["items"].isNotNull())

    empty = F.array().cast("array<struct<start:int,len:int,items:array<string>>>")
    hits = F.when(F.col("any_hit"), F.concat(*[F.coalesce(verified(x), empty) for x in parts])).otherwise(empty)
    return docs.withColumn("hits", hits).drop("any_hit", *[f"w{x}" for x in lengths])


def _hash_of_gram(gram: Column, length: int) -> Column:
    """The window hash of a gram given as text: the same doubling over its words."""
    level = {1: [F.xxhash64(F.get(F.split(gram, " "), F.lit(i))) for i in range(length)]}
    size = 1
    while size * 2 <= length:
        half = level[size]
        level[size * 2] = [F.xxhash64(half[i], half[i + size]) for i in range(length - size * 2 + 1)]
        size *= 2
    bits = [1 << b for b in reversed(range(length.bit_length())) if length >> b & 1]
    out, done = level[bits[0]][0], bits[0]
    for b in bits[1:]:
        out, done = F.xxhash64(out, level[b][done]), done + b
    return out


def _hits_by_join(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """The same for a benchmark of any size: an equi-join on the window hash, keyed by the digest of the text."""
    docs = docs.withColumn("text_key", F.sha2(F.coalesce("doc_text", F.lit("")), 256))
    each = window_hashes(docs.dropDuplicates(["text_key"]).select("text_key", "words", "n_words"), lengths)
    spots = None
    for length in lengths:
        part = each.select("text_key", F.lit(length).alias("len"), F.posexplode(f"w{length}").alias("start", "hash"))
        spots = part if spots is None else spots.union(part)
    found = spots.join(windows, ["hash", "len"]).groupBy("text_key").agg(
        F.collect_list(F.struct("start", "len", "gram", "items")).alias("found")
    )
    docs = docs.join(found, "text_key", "left")
    same = F.filter("found", lambda h: F.array_join(F.slice("words", h["start"] + 1, h["len"]), " ") == h["gram"])
    hits = F.transform(same, lambda h: F.struct(h["start"].alias("start"), h["len"].alias("len"), h["items"].alias("items")))
    empty = F.array().cast("array<struct<start:int,len:int,items:array<string>>>")
    return docs.withColumn("hits", F.coalesce(hits, empty)).drop("text_key", "found")


def contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_windows: int = MAX_WINDOWS
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, doc_text, words, n_words, n_hit, items, spans, contaminated.

    ``spans`` are the merged (start, end) word intervals inside occurrences of windows, ``items`` the sorted ids of the
    items they come from. Null or empty texts have no words and no hits; repeated rows give equal rows; an empty
    benchmark hits nothing; an empty table gives no rows. Other columns are not read.
    """
    docs = docs.select("doc_id", F.col("text").alias("doc_text"))
    docs = docs.withColumn("words", words_of(F.col("doc_text"))).withColumn("n_words", F.size("words"))
    windows = benchmark_windows(benchmark, n)
    few = windows.limit(max_windows + 1).collect()
    if len(few) > max_windows:
        lengths = sorted(r["len"] for r in windows.select("len").distinct().collect())
        docs = _hits_by_join(docs, windows, lengths)
    elif few:
        docs = _hits_by_set(docs, few, sorted({w["len"] for w in few}))
    else:
        docs = docs.withColumn("hits", F.array().cast("array<struct<start:int,len:int,items:array<string>>>"))
    order = F.array_sort(F.transform("hits", lambda h: F.struct(h["start"].alias("start"), (h["start"] + h["len"]).alias("end"))))
    merged = F.aggregate(
        order,
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, h: F.when(
            (F.size(acc) > 0) & (h["start"] <= F.element_at(acc, -1)["end"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], h["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(h))),
    )
    some = F.size("hits") > 0
    docs = docs.withColumn("spans", F.when(some, merged).otherwise(F.array().cast("array<struct<start:int,end:int>>")))
    docs = docs.withColumn("items", F.array_sort(F.array_distinct(F.flatten(F.col("hits.items")))))
    n_hit = F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    return docs.withColumn("n_hit", n_hit).withColumn("contaminated", F.col("n_hit") > 0).drop("hits")


def without_spans(found: DataFrame) -> DataFrame:
    """``contamination`` rows with ``text``: the document without its hit words; what stands between words stays."""
    gaps, whole = F.split("doc_text", ANY_CASE_WORD), F.regexp_extract_all("doc_text", F.lit(ANY_CASE_WORD), F.lit(0))
    df = found.withColumn("gaps", gaps).withColumn("whole", whole)
    keep = F.transform(
        "gaps",
        lambda g, i: F.concat(
            g, F.when((i >= F.size("whole")) | F.exists("spans", lambda s: (i >= s["start"]) & (i < s["end"])), "").otherwise(F.get("whole", i))
        ),
    )
    text = F.when(F.col("contaminated"), F.array_join(keep, "")).otherwise(F.col("doc_text"))
    return df.withColumn("text", text).drop("gaps", "whole")


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Rows of ``docs``, all columns, without any benchmark window."""
    key = "__decontamination_row"
    rows = docs.select(F.struct(*docs.columns).alias(key), F.col("text"))
    found = contamination(rows.select(F.col(key).alias("doc_id"), "text"), benchmark, n)
    # the row number keeps the filter above the window hashes: pushed below, it would repeat them in its condition
    found = found.select("doc_id", "contaminated", F.monotonically_increasing_id().alias("row"))
    return found.where((F.col("row") >= 0) & ~F.col("contaminated")).select("doc_id.*")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


ORACLE = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}'), '{WORD}') AS ws,
    row_number() OVER () AS rid FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}'), '{WORD}') AS ws
  FROM benchmark
), g AS (
  SELECT DISTINCT item, least(len(ws), {WINDOW}) AS n, array_to_string(ws[i:i + least(len(ws), {WINDOW}) - 1], ' ') AS gram
  FROM (SELECT item, ws, unnest(range(1, len(ws) - least(len(ws), {WINDOW}) + 2)) AS i FROM b WHERE len(ws) > 0)
), d AS (
  SELECT rid, n, i, array_to_string(ws[i:i + n - 1], ' ') AS gram
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM g) WHERE len(ws) >= n)
), hits AS (SELECT rid, i, d.n, item FROM d JOIN g ON d.gram = g.gram AND d.n = g.n
), spots AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid
), items AS (
  SELECT rid, count(DISTINCT item) AS n_items, array_to_string(list_sort(list_distinct(list(item))), ',') AS ids FROM hits GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN spots USING (rid) LEFT JOIN items USING (rid)
"""
