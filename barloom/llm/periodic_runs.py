"""Maximal periodic runs of words, by a suffix automaton and link-cut accesses to its tree of suffix links.

The automaton's states, with their suffix links, form a tree. Words are appended in order; appending word i *accesses* the
state of the prefix that ends there: its path to the root becomes the preferred path of a link-cut tree and takes the
colour i. Before that the path falls into segments of one colour each. A segment of colour j whose longest string has L
words says: the last L words stood last at an end j before i, and no longer ones did. So if d = i - j <= L, the 2d words up
to i are a square, d is the smallest period of the L + d words up to i, and they begin where the run begins. The run is
extended to the right by comparing words, once: until its end, squares of its period are known. All squares of a
smallest period show up this way, so no run is missed. Accesses cost amortised logarithmic time.

Only stretches that can hold a run go through the automaton: in a run of at least ``LEAST`` words and three periods every
``GRAM`` words stand again within the run, at most a third of it away. Stretches of such places, found by sorting hashes
(equal hashes of unlike words only let a stretch through), are cut until nothing changes; a run lies inside one whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least length of a run in words, and in periods. GRAM fits both: LEAST >= 2 q + GRAM - 1 for q < GRAM, 3 q beyond.
LEAST, TIMES, GRAM = 24, 3, 8
RUN = "struct<start:bigint,length:bigint,period:bigint>"
WORD = r"[^\x20\x09-\x0D]+"


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix automaton of a word sequence: suffix link and longest length of every state, and the state of every prefix."""
    step: list[dict[int, int]] = [{}]
    link, size, ends = [-1], [0], []
    last = 0
    for i, w in enumerate(words):
        now = len(size)
        size.append(i + 1)
        step.append({})
        link.append(0)
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = now
            p = link[p]
        if p >= 0:
            q = step[p][w]
            if size[p] + 1 == size[q]:
                link[now] = q
            else:
                copy = len(size)
                size.append(size[p] + 1)
                step.append(step[q].copy())
                link.append(link[q])
                while p >= 0 and step[p].get(w) == q:
                    step[p][w] = copy
                    p = link[p]
                link[q] = link[now] = copy
        ends.append(now)
        last = now
    return link, size, ends


class LinkCutTree:
    """Preferred paths of a rooted tree as splay trees by depth; a path has one colour, kept at its splay root."""

    def __init__(self, parent: list[int]):
        n = len(parent)
        self.up = list(parent)
        self.left, self.right, self.colour = [-1] * n, [-1] * n, [-1] * n

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if g >= 0 and left[g] == p:
            left[g] = x
        elif g >= 0 and right[g] == p:
            right[g] = x
        else:
            self.colour[x] = self.colour[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b >= 0:
            up[b] = p
        up[p], up[x] = x, g

    def splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        while (p := up[x]) >= 0 and (left[p] == x or right[p] == x):
            g = up[p]
            if g >= 0 and (left[g] == p or right[g] == p):
                self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            self._rotate(x)

    def access(self, v: int, colour: int) -> list[tuple[int, int]]:
        """Recolour the path from ``v`` to the root: (old colour, deepest node) of its segments, from below."""
        segments = []
        x, below = v, -1
        while x >= 0:
            self.splay(x)
            old = self.colour[x]
            if old >= 0:
                segments.append((old, x))
            if (r := self.right[x]) >= 0:
                self.colour[r] = old
            self.right[x] = below
            below, x = x, self.up[x]
        self.splay(v)
        self.colour[v] = colour
        return segments


def runs_in(words: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of the maximal runs of at least ``least`` words and ``times`` (two or more) periods."""
    link, size, ends = automaton(words)
    tree = LinkCutTree(link)
    n, found = len(words), []
    until: dict[int, int] = {}
    for i, state in enumerate(ends):
        for j, node in tree.access(state, i):
            d, long = i - j, size[node]
            if d > long or until.get(d, -1) >= i:
                continue
            start, end = j - long + 1, i
            while end + 1 < n and words[end + 1] == words[end + 1 - d]:
                end += 1
            until[d] = end
            if end - start + 1 >= max(least, times * d):
                found.append((start, end - start + 1, d))
    return found


def _grams(names: np.ndarray) -> np.ndarray:
    """Hash of the GRAM words from every place on."""
    h = names.astype(np.uint64)
    width = 1
    while width < GRAM:
        a, b = h[:-width], h[width:]
        h = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        width *= 2
    return h


def stretches(names: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the word ranges that may hold a run, from word hashes."""
    if len(names) < LEAST:
        return []
    gram = _grams(names)
    todo, out = [(0, len(gram))], []
    while todo:
        lo, hi = todo.pop()
        part = gram[lo:hi]
        sorted_ = np.sort(part)
        if not (sorted_[1:] == sorted_[:-1]).any():
            continue
        order = np.argsort(part, kind="stable")
        sorted_, apart = part[order], np.full(hi - lo, hi - lo + GRAM, np.int64)
        same = np.flatnonzero(sorted_[1:] == sorted_[:-1])
        gap = order[same + 1] - order[same]
        np.minimum.at(apart, order[same], gap)
        np.minimum.at(apart, order[same + 1], gap)
        near = np.r_[False, apart <= (hi - lo + GRAM - 1) // TIMES, False]
        edge = np.flatnonzero(near[1:] != near[:-1])
        begins, ends = edge[::2], edge[1::2]
        wide = ends - begins >= LEAST - GRAM + 1
        for b, e in zip(begins[wide].tolist(), ends[wide].tolist(), strict=True):
            if e - b == hi - lo:
                out.append((lo, hi + GRAM - 1))
            else:
                todo.append((lo + b, lo + e))
    return sorted(out)


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """Maximal runs of a document's words, by start, then period."""
    found: list[tuple[int, int, int]] = []
    if len(words) >= LEAST:
        names = np.fromiter(map(hash, words), np.int64, len(words))
        for lo, hi in stretches(names):
            number: dict[bytes, int] = {}
            part = [number.setdefault(w, len(number)) for w in words[lo:hi]]
            found += [(start + lo, length, period) for start, length, period in runs_in(part)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if runs:
        open_ = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            open_[start + period] += 1
            open_[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(open_[:-1]) == 0).tolist()]
    return b" ".join(words)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, runs array<struct<start, length, period>>, collapsed.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, numbered from 0; runs have at least 24 words and three smallest
    periods and come by start, then period; ``collapsed`` is the text without each run's words after its first period.
    A null or empty text has no words, no runs and the empty collapsed text. Repeated rows give equal rows; an empty table
    gives none; other columns are not read. A task holds one text at a time; memory grows with its longest stretch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                count, runs, texts = [], [], []
                for t in part.column(1):
                    words = (t.as_py() or "").encode().split()
                    found = runs_of(words)
                    count.append(len(words))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    texts.append(collapsed(words, found).decode())
                fields = [pa.field(c, pa.int64()) for c in ("start", "length", "period")]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(count, pa.int64()), pa.array(runs, pa.list_(pa.struct(fields))), pa.array(texts, pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs array<{RUN}>, collapsed string")


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``, with the words of a tenth of the texts repeated in periods.

    With h the CRC-32 of the decimal doc_id and g = h div 10: if h mod 10 is 0 and there are n > 0 words, each word i >= a
    becomes word a + (i - a) mod p of the text, a = g mod n, p = 1 + (n - a) div (3 + g mod 8). Other texts, and those of a
    null doc_id, stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def rewritten(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
        at = lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + F.pmod(i - a, p)).cast("int")))
        return F.when(n > 0, F.array_join(F.transform(words, at), " ")).otherwise(F.lit(""))

    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    # a lambda variable is bound once, an expression would be evaluated again for every word
    text = F.transform(F.array(words), rewritten)[0]
    return docs.select("doc_id", F.when((F.pmod(h, F.lit(10)) == 0) & F.col("text").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest length to period (start, length, period, exponent_milli) and two digests."""
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    top = F.reduce("runs", F.lit(None).cast(RUN), better)
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.withColumn("top", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.floor(F.col("top.length") * 1000 / F.col("top.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
