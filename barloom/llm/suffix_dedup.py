"""Removal of every byte covered by a string of ``LENGTH`` bytes that starts anywhere else.

Prefix doubling: the name of 2^k bytes at a position is made from the names of two halves at offset 2^(k-1), for offsets
1, 2, 4 ... up to the widest name that fits (256 bytes for LENGTH, see ``_width``); a longer string is named by those at its
start, at every width inside and at its end. Names are 64-bit hashes of such pairs, so the doubling itself needs no sort;
Spark's aggregates then rank positions by name, and whatever is unique drops out, at growing depth:

1. Every window of LENGTH bytes is owned by the position in it whose gram, a name of half that width, is least (the
   leftmost of equals), so equal windows have owners at equal places. Owners whose gram is unique in the corpus drop out.
2. The windows of an owner are treated in blocks of 64, then 8, then 1. If the bytes that all windows of a block share
   are unique, none of them repeats; if the bytes that any of them touches occur elsewhere, all of them do. Only blocks
   that are neither (they hold the edge of a repeat) are split, together with one block of each string they may meet.

Equal names of unlike strings never drop a repeat; what is taken for a repeat agrees in two 64-bit names: those of the
inner and the outer string of a block, and in the last step two of unlike seeds.

A group of equal names is only ever counted and joined, never gathered, so a passage may stand in any share of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import give_back, in_small_batches, stored

LENGTH = 400
STEPS = (64, 8, 1)
#: Bytes of a text whose names a task holds at once (a memory bound; longer texts go piece by piece).
PIECE = 2_000_000
#: Block rows a task hands on at once.
EMIT_ROWS = 25_000
#: Rows of a table that may be broadcast (at most 64 bytes each); a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000
U = np.uint64


#: Multipliers of the names, and of the second names of the last step.
SEEDS = ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407), (0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25, 0x165667B19E3779F9))


def _pair(a: np.ndarray, b: np.ndarray, seeds: tuple[int, int, int] = SEEDS[0]) -> np.ndarray:
    h = a * U(seeds[1]) + (b ^ (b >> U(29))) * U(seeds[2])
    return h ^ (h >> U(32))


def _width(length: int) -> int:
    """Bytes of the widest names: a power of two that fits into what all windows of the first blocks share."""
    return 1 << (length - STEPS[0] + 1).bit_length() - 1


def _names(data: bytes, width: int, seeds: tuple[int, int, int] = SEEDS[0]) -> tuple[np.ndarray, np.ndarray]:
    """Names of half of ``width`` and of ``width`` bytes at every position."""
    h = np.frombuffer(data, np.uint8).astype(U) * U(seeds[0]) + U(0x1234567)
    offset, gram = 1, h
    while offset < width and len(h) > offset:
        h = _pair(h[:-offset], h[offset:], seeds)
        offset *= 2
        if offset == width // 2:
            gram = h
    return gram, h


def _string(name: np.ndarray, at: np.ndarray, size: int, width: int, seeds: tuple[int, int, int] = SEEDS[0]) -> np.ndarray:
    """Names of the strings of ``size`` bytes, more than ``width``, that start at ``at``."""
    h = name[at]
    for offset in [*range(width, size - width, width), size - width]:
        h = _pair(h, name[at + offset], seeds)
    return h


def _owners(gram: np.ndarray, n: int, length: int) -> np.ndarray:
    """For each of the first ``n`` windows: the position of the leftmost least gram inside it."""
    w = length - _width(length) // 2 + 1
    v = gram * U(0x9FB21C651E98DF25)
    v ^= v >> U(28)
    x = np.concatenate([v, np.full((-len(v)) % w, np.iinfo(U).max, U)]).reshape(-1, w)
    at = np.arange(x.size).reshape(x.shape)
    ahead = np.minimum.accumulate(x, axis=1)
    new = np.ones(x.shape, bool)
    new[:, 1:] = ahead[:, 1:] < ahead[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(new, at, 0), axis=1).ravel()
    back_x = x[:, ::-1]
    back = np.minimum.accumulate(back_x, axis=1)
    new = np.ones(x.shape, bool)
    new[:, 1:] = back_x[:, 1:] <= back[:, :-1]
    back_at = np.minimum.accumulate(np.where(new, at[:, ::-1], x.size), axis=1)[:, ::-1].ravel()
    left, right = back[:, ::-1].ravel()[:n], ahead.ravel()[w - 1 : w - 1 + n]
    return np.where(left <= right, back_at[:n], ahead_at[w - 1 : w - 1 + n])


def _runs(gram: np.ndarray, size: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners in order, and the least and greatest distance of the windows they own to the left of them."""
    n = size - length + 1
    owner = _owners(gram, n, length)
    cut = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    last = np.r_[cut[1:], n] - 1
    return owner[cut], owner[cut] - last, owner[cut] - cut


def _block_rows(data: bytes, key: bytes, step: int, length: int, units: np.ndarray | None) -> Iterator[list[np.ndarray]]:
    """gram, o, jlo, jhi, core, full of all blocks of a text, or of those in ``units`` (rows o, jlo, jhi)."""
    if len(data) < length:
        return
    salt = U(int.from_bytes(key[:8], "little"))
    margin, width = length + step, _width(length)
    for c in range(0, len(data), PIECE):
        lo, hi = max(0, c - margin), min(len(data), c + PIECE + margin)
        if hi - lo < length:
            continue
        gram, name = _names(data[lo:hi], width)
        if units is None:
            o, jlo, jhi = _runs(gram, hi - lo, length)
        else:
            o, jlo, jhi = units[:, 0] - lo, units[:, 1], units[:, 2]
        mine = (o + lo >= c) & (o + lo < c + PIECE)
        o, jlo, jhi = o[mine], jlo[mine], jhi[mine]
        if not len(o):
            continue
        n = jhi // step - jlo // step + 1
        i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(jlo // step, n)
        o, jlo, jhi = (np.repeat(x, n) for x in (o, jlo, jhi))
        jlo, jhi = np.maximum(jlo, i * step), np.minimum(jhi, i * step + step - 1)

        core = _pair(_string(name, o - i * step, length - step + 1, width), i.astype(U))  # blocks at one distance from their owner
        if step == 1:
            _, second = _names(data[lo:hi], width, SEEDS[1])
            full = _pair(_string(second, o - i, length, width, SEEDS[1]), i.astype(U), SEEDS[1])
        else:
            start = o - i * step - (step - 1)
            whole = (start >= 0) & (start + length + step - 1 <= hi - lo)
            full = _pair(core, (salt ^ (o + lo).astype(U)) * U(0x9E3779B97F4A7C15))  # a block at the edge of its text
            full[whole] = _string(name, start[whole], length + step - 1, width)
        yield [gram[o], o + lo, jlo, jhi, core, full]


COLUMNS = "text_key binary, o long, jlo int, jhi int, core long, full long"


def _emit(keys: list[bytes], counts: list[int], parts: list[list[np.ndarray]], with_gram: bool) -> pa.RecordBatch:
    gram, o, jlo, jhi, core, full = (np.concatenate(x) for x in zip(*parts, strict=True))
    key = pa.array(keys, pa.binary()).take(pa.array(np.repeat(np.arange(len(keys)), counts)))
    out = [key, pa.array(o.astype(np.int64)), pa.array(jlo.astype(np.int32)), pa.array(jhi.astype(np.int32))]
    out += [pa.array(core.view(np.int64)), pa.array(full.view(np.int64))]
    names = ["text_key", "o", "jlo", "jhi", "core", "full"]
    if with_gram:
        out.append(pa.array(gram.view(np.int64)))
        names.append("gram")
    return pa.RecordBatch.from_arrays(out, names=names)


def _rows(texts: DataFrame, step: int, length: int) -> DataFrame:
    """Block rows of ``texts`` (text_key, data), with their gram; or, where it has ``units``, of those blocks only."""
    split = "units" in texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, counts, parts, held = [], [], [], 0
            for r in range(b.num_rows):
                key, data = b.column(0)[r].as_py(), b.column(1)[r].as_py()
                units = np.stack([x.to_numpy().astype(np.int64) for x in b.column(2)[r].values.flatten()], axis=1) if split else None
                for part in _block_rows(data, key, step, length, units):
                    keys.append(key)
                    counts.append(len(part[0]))
                    parts.append(part)
                    held += len(part[0])
                    if held > EMIT_ROWS:
                        yield _emit(keys, counts, parts, not split)
                        keys, counts, parts, held = [], [], [], 0
            if held:
                yield _emit(keys, counts, parts, not split)
        give_back()

    return texts.mapInArrow(run, COLUMNS + ("" if split else ", gram long"))


def _grams(texts: DataFrame, length: int) -> DataFrame:
    """The gram of every owner, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                data = b.column(0)[r].as_py()
                for c in range(0, len(data), PIECE):
                    lo, hi = max(0, c - length), min(len(data), c + PIECE + length)
                    if hi - lo >= length:
                        gram, _ = _names(data[lo:hi], _width(length))
                        o, _, _ = _runs(gram, hi - lo, length)
                        o = o[(o + lo >= c) & (o + lo < c + PIECE)]
                        if len(o):
                            yield pa.RecordBatch.from_arrays([pa.array(gram[o].view(np.int64))], names=["gram"])
        give_back()

    return texts.select("data").mapInArrow(run, "gram long")


def _by_size(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def text_key(text: Column) -> Column:
    """128-bit identity of a text (the start of its SHA-256)."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per distinct text of ``docs`` (text) with repeats: text_key, spans array<struct<start, end>> in bytes, in order."""
    if length < 2 * STEPS[0]:
        raise ValueError(f"strings have at least {2 * STEPS[0]} bytes")
    texts = in_small_batches(docs).select(text_key(F.col("text")).alias("text_key"), F.col("text").cast("binary").alias("data"))
    texts = texts.where(F.octet_length("data") >= length)
    grams = stored(_grams(texts, length).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "grams")
    rows = _rows(texts, STEPS[0], length).join(_by_size(grams, grams.count()), "gram", "left_semi").drop("gram")
    repeats = []
    for step, finer in zip(STEPS, [*STEPS[1:], None], strict=True):
        rows = stored(rows, "blocks")
        strings = rows.groupBy("core", "full").agg(F.count(F.lit(1)).alias("c"))
        if finer is None:
            many = strings.where("c > 1").select("core", "full")
            repeats.append(rows.join(many, ["core", "full"], "left_semi"))
            break
        cores = strings.groupBy("core").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("strings")).where("n > 1")
        ranked = rows.join(strings.join(cores, "core").select("core", "full", "c", "strings"), ["core", "full"])
        ranked = stored(ranked, "ranked")
        repeats.append(ranked.where("c > 1"))
        edge = ranked.where("c = 1").select("text_key", "o", "jlo", "jhi")
        one = ranked.where("c > 1 and strings > 1").groupBy("core", "full").agg(F.min(F.struct("text_key", "o", "jlo", "jhi")).alias("u"))
        units = edge.union(one.select("u.*")).distinct().groupBy("text_key").agg(F.collect_list(F.struct("o", "jlo", "jhi")).alias("units"))
        units = stored(units, "units")
        size = units.agg(F.sum(F.size("units"))).first()[0] or 0
        rows = _rows(texts.join(_by_size(units, size), "text_key").select("text_key", "data", "units"), finer, length)
    found = None
    for r in repeats:
        part = r.select("text_key", (F.col("o") - F.col("jhi")).alias("start"), (F.col("o") - F.col("jlo") + length).alias("end"))
        found = part if found is None else found.union(part)
    from pyspark.sql import Window

    order = Window.partitionBy("text_key").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.distinct().withColumn("opens", (F.col("start") > F.coalesce(before, F.lit(-1))).cast("int"))
    islands = islands.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("text_key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _with_spans(docs: DataFrame, length: int, columns: list[str]) -> DataFrame:
    spans = stored(repeated_spans(docs, length), "spans").withColumnRenamed("text_key", "__suffix_key")
    size = spans.agg(F.sum(F.size("spans"))).first()[0] or 0
    rows = docs.select(*columns, F.col("text").cast("binary").alias("__suffix_data"), text_key(F.col("text")).alias("__suffix_key"))
    return rows.join(_by_size(spans, size), "__suffix_key", "left").drop("__suffix_key")


def _cut(data: bytes, spans: list[dict]) -> list[bytes]:
    kept, at = [], 0
    for s in spans:
        kept.append(data[at : s["start"]])
        at = s["end"]
    return [*kept, data[at:]]


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, text.

    ``n_kept`` counts the bytes left and ``text`` is what they spell, without characters of which a part was removed.

    A null text counts as empty: nothing to remove. Texts shorter than ``length`` keep all bytes. Copies and repeated rows
    are different places, so they lose whatever they share. An empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in range(b.num_rows):
                data, spans = b.column(1)[r].as_py() or b"", b.column(2)[r].as_py() or []
                kept = b"".join(_cut(data, spans))
                out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), len(kept), kept.decode(errors="ignore")))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", "text"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_spans(docs, length, ["doc_id"]).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long, text string"
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated spans cut out of ``text``; all columns stay. Null texts stay null.

    Spans are bytes: a character of which only a part is cut goes whole.
    """
    order = docs.columns
    others = [c for c in order if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(others)
            texts = []
            for r in range(b.num_rows):
                data, spans = b.column(n)[r].as_py(), b.column(n + 1)[r].as_py() or []
                texts.append(None if data is None else b"".join(_cut(data, spans)).decode(errors="ignore"))
            columns = dict(zip(others, b.columns[:n], strict=True)) | {"text": pa.array(texts, pa.string())}
            schema = pa.schema([b.schema.field(c) if c != "text" else pa.field("text", pa.string()) for c in order])
            yield pa.RecordBatch.from_arrays([columns[c] for c in order], schema=schema)
        give_back()

    return _with_spans(docs, length, others).mapInArrow(run, docs.schema)
