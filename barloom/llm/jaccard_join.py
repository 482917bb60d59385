"""Exact set-similarity join of documents by word shingles: pigeonhole over a partition of the shingle universe.

A pair that reaches the threshold differs in at most H shingles, H depending on the smaller set's size band. The universe
(64-bit shingle hashes) is cut into m > H segments per band, so the two sets agree on at least m - H segments. A document
indexes one signature per filled segment, under its own band and under the next lower one (the band of a smaller
partner). Costs decide the rest: m is the smallest number of segments whose expected filled ones exceed H; a set that
fills no more than H segments adds the one-deletion neighbourhoods of its larger segments (each covers two differences),
and only where even these do not add up the signatures of its empty segments, which are long lists.

Signatures travel in packed blocks, by bucket. Copies with equal sets count once. Documents of one signature form a
group, which sizes and parity sketches (a lower bound on the difference) divide further. A signature that ``HOT`` sets of a
block share sends on only the least of them; the others stand in rows of their own, spread over all tasks, and meet the
group's least member by a join, so no task sees a whole group of any share of the rows. Each member is first verified
against its group's smallest member, and only pairs that are then still in different components are verified further,
so a large group of near copies costs links, not pairs. Verification compares the whole
shingle sets. Components of verified links give the result. Nothing is capped or sampled.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Forest, connected_components, give_back, partitions, stored

WORDS, NUM, DEN = 5, 80, 100
BLOCK_DOCS = 1000
BLOCK_MEMBERS = 2048
#: From so many sets of one block on, a signature's group is put together by a join.
HOT = 16
#: Sizes from here on are packed as this one, and then do not rule a pair out by its sketch.
WIDE_SIZE = 65535
#: Rows of the table of candidate sets that may be broadcast (24 bytes each); a larger table is joined by shuffle.
BROADCAST_KEYS = 1_000_000
MAX_REMEMBERED = 200_000
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Distinct shingle hashes of a text, sorted. Words are split at ASCII white space after lower-casing A-Z."""

    def __init__(self, words: int = WORDS):
        self.words, self.hashes = words, _WordHash()
        self.factors = [U(int.from_bytes(hashlib.sha256(bytes([j])).digest()[:8], "little") | 1) for j in range(words)]

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.empty(0, U)
        if len(self.hashes) > MAX_REMEMBERED:
            self.hashes.clear()
        h = np.fromiter(map(self.hashes.__getitem__, words), U, len(words))
        if len(h) < self.words:
            whole = xxhash.xxh3_64_intdigest(b"%d " % len(words) + b" ".join(words))
            return np.array([whole], U)
        n = len(h) - self.words + 1
        total = h[:n] * self.factors[0]
        for j in range(1, self.words):
            total += h[j : j + n] * self.factors[j]
        return np.unique(_mix(total))


def set_key(h: np.ndarray) -> bytes:
    """128-bit identity of a set."""
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _short(key: bytes) -> int:
    """The first half of a set key. Sets that share it are compared as if each were meant; verification tells them apart."""
    return int.from_bytes(key[:8], "little", signed=True)


class Bands:
    """Size bands, differences and segment counts for the threshold ``num / den``."""

    def __init__(self, num: int = NUM, den: int = DEN):
        self.num, self.den = num, den
        self.low, self.high = [], []

    def of(self, size: int) -> int:
        while not self.high or self.high[-1] < size:
            lo = self.high[-1] + 1 if self.high else 1
            self.low.append(lo)
            self.high.append(lo * self.den // self.num)
        return int(np.searchsorted(self.high, size))

    @functools.lru_cache(maxsize=None)  # noqa: B019
    def plan(self, band: int) -> tuple[int, int]:
        """(H, m): most differences of a pair whose smaller set is in the band; number of segments."""
        while len(self.high) <= band:
            self.of(self.high[-1] + 1 if self.high else 1)
        s = self.high[band]
        partner = s * self.den // self.num
        h = (s + partner) * (self.den - self.num) // (self.den + self.num)
        m = h + 1
        while m < 4 * h + 4 and m * (1 - math.exp(-self.low[band] / m)) < 1.03 * (h + 1) + 1:
            m += max(1, m // 64)
        return h, m


def signatures(h: np.ndarray, bands: Bands) -> np.ndarray:
    """All signatures of a set (sorted hashes)."""
    if not len(h):
        return np.empty(0, U)
    own = bands.of(len(h))
    inner = _mix(h + U(0x5851F42D4C957F2D))
    out = []
    for band in {own, max(own - 1, 0)}:
        most, m = bands.plan(band)
        seg = ((h >> U(32)) * U(m)) >> U(32)  # ascending, as h is
        first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        sums, filled = np.add.reduceat(inner, first), seg[first]
        salt = _mix(filled + U((band * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF))
        out.append(_mix(sums ^ salt))
        if len(filled) > most:
            continue
        sizes = np.diff(np.r_[first, len(h)])
        larger = np.repeat(sizes >= 2, sizes)
        out.append(_mix((np.repeat(sums, sizes) - inner)[larger] ^ np.repeat(salt, sizes)[larger]))
        if len(filled) + int((sizes >= 2).sum()) <= most:
            empty = np.setdiff1d(np.arange(m, dtype=U), filled)
            out.append(_mix(_mix(empty + U((band * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF))))
    return np.unique(np.concatenate(out))


def sketch(h: np.ndarray) -> np.ndarray:
    """Parities of the shingles by some of their bits, a place for each shingle and 1024 at least (a power of two): two sets
    differ in at least as many shingles as in bits. Longer sketches fold to shorter ones (``_folded``)."""
    places = max(1024, 1 << max(len(h) - 1, 0).bit_length())
    odd = np.bincount(((h >> U(8)) & U(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).view(U)


def _folded(x: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of ``x``) folded to ``width`` bytes."""
    while 8 * x.shape[1] > width:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


class Sketches:
    """Sketches of several widths: each is kept at its own and at every smaller width that occurs."""

    def __init__(self, bits: list[bytes]):
        self.widths = np.array([len(x) for x in bits], np.int64)
        own = {}
        for w in np.unique(self.widths):
            at = np.flatnonzero(self.widths == w)
            own[int(w)] = at, np.frombuffer(b"".join(bits[i] for i in at), U).reshape(len(at), -1)
        self.row: dict[int, np.ndarray] = {}
        self.bits: dict[int, np.ndarray] = {}
        for w in own:
            wider = [(at, _folded(x, w)) for v, (at, x) in own.items() if v >= w]
            self.row[w] = np.full(len(bits), -1)
            self.row[w][np.concatenate([at for at, _ in wider])] = np.arange(sum(len(at) for at, _ in wider))
            self.bits[w] = np.concatenate([x for _, x in wider])

    def folded(self, width: int) -> np.ndarray:
        out = np.empty((len(self.widths), width // 8), U)
        for w in np.unique(self.widths):
            at = np.flatnonzero(self.widths == w)
            out[at] = _folded(self.bits[int(w)][self.row[int(w)][at]], width)
        return out

    def differ(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Bits in which the sketches of pairs differ, the wider folded to the narrower."""
        widths = np.minimum(self.widths[u], self.widths[v])
        out = np.zeros(len(u), np.int64)
        for w in np.unique(widths):
            pairs, row, bits = np.flatnonzero(widths == w), self.row[int(w)], self.bits[int(w)]
            step = max(1, (1 << 22) // int(w))
            for k in range(0, len(pairs), step):
                at = pairs[k : k + step]
                out[at] = np.bitwise_count(bits[row[u[at]]] ^ bits[row[v[at]]]).sum(axis=1, dtype=np.int64)
        return out


def _signature_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed rows by bucket: signatures (sigs u64, and of the set of each its short key i64, size u16, fold u32), and the
    same documents' own rows (``base``: doc_id, n_shingles, set_key, short, text_hash, sketch), read once this way. ``hots``
    are the signatures that are hot in the block, packed with the least of their sets only; the others (``mates``) are rows
    by ``hot``.

    A signature carries what its set needs to be compared, so its size does not depend on the number of buckets.
    """

    columns = ["bucket", "sigs", "shorts", "sizes", "folds", "hots", "base", "hot", "mates"]

    def block(sets: list[np.ndarray], bands: Bands, at: int, empty: pa.Array) -> Iterator[pa.RecordBatch]:
        unique = {set_key(h): h for h in sets if len(h)}
        if not unique:
            return
        each = [signatures(h, bands) for h in unique.values()]
        owner = np.repeat(np.arange(len(each)), [len(x) for x in each])
        sigs = np.concatenate(each)
        shorts = np.array([_short(k) for k in unique], np.int64)
        order = np.lexsort((shorts[owner], sigs))
        sigs, owner = sigs[order], owner[order]
        first = np.flatnonzero(np.r_[True, sigs[1:] != sigs[:-1]])
        count = np.diff(np.r_[first, len(sigs)])
        hot = count >= HOT
        found = [(sigs[lo : lo + 1].view(np.int64)[0], shorts[owner[lo + 1 : lo + n]]) for lo, n in zip(first[hot], count[hot], strict=True)]
        if found:
            none = pa.nulls(len(found), pa.binary())
            spread = pa.array(np.arange(at, at + len(found)) % buckets, pa.int64())
            name, mates = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [spread, *[none] * 5, pa.nulls(len(found), empty.type), pa.array(name, pa.int64()), pa.array(mates, pa.list_(pa.int64()))], names=columns
            )
        least = np.zeros(len(sigs), bool)
        least[first] = True
        hot = np.repeat(hot, count)
        sigs, owner, hot = (x[least | ~hot] for x in (sigs, owner, hot))
        bucket = (sigs >> U(16)) % U(buckets)
        order = np.argsort(bucket, kind="stable")
        sigs, owner, bucket, hot = sigs[order], owner[order], bucket[order], hot[order]
        sizes = np.array([min(len(h), WIDE_SIZE) for h in unique.values()], np.uint16)[owner]
        folds = np.array([np.bitwise_xor.reduce(sketch(h).view(np.uint32)) for h in unique.values()])[owner]
        shorts = shorts[owner]
        cut = [*np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(sigs)]
        rows = [
            (int(bucket[lo]), *(x[lo:hi].tobytes() for x in (sigs, shorts, sizes, folds)), sigs[lo:hi][hot[lo:hi]].tobytes())
            for lo, hi in zip(cut[:-1], cut[1:], strict=True)
        ]
        number, *rest = zip(*rows, strict=True)
        blank = [pa.nulls(len(rows), t) for t in (empty.type, pa.int64(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), *(pa.array(x, pa.binary()) for x in rest), *blank], names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, bands = Shingler(), Bands()
        for b in batches:
            lo = 0
            while lo < b.num_rows:
                sets, volume, hi = [], 0, lo
                while hi < b.num_rows and len(sets) < BLOCK_DOCS and volume < 2_000_000:
                    sets.append(shingler(b.column(1)[hi].as_py()))
                    volume += len(sets[-1])
                    hi += 1
                base = pa.StructArray.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo),
                        pa.array([len(h) for h in sets], pa.int64()),
                        pa.array(named := [set_key(h) if len(h) else None for h in sets], pa.binary()),
                        pa.array([None if k is None else _short(k) for k in named], pa.int64()),
                        b.column(2).slice(lo, hi - lo),
                        pa.array([sketch(h).tobytes() for h in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "short", "text_hash", "sketch"],
                )
                none = pa.nulls(hi - lo, pa.binary())
                spread = pa.array(np.arange(lo, hi) % buckets, pa.int64())
                blank = [pa.nulls(hi - lo, t) for t in (pa.int64(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([spread, *[none] * 5, base, *blank], names=columns)
                yield from block(sets, bands, lo, base)
                lo = hi
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    base = f"struct<doc_id:{kind},n_shingles:bigint,set_key:binary,short:bigint,text_hash:bigint,sketch:binary>"
    schema = f"bucket long, sigs binary, shorts binary, sizes binary, folds binary, hots binary, base {base}, hot long, mates array<long>"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, schema)


def _alike(sizes: np.ndarray, folds: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sizes and folded sketches leave it possible that sets ``a`` and ``b`` reach the threshold."""
    x, y = sizes[a], sizes[b]
    return _within(x, y, np.bitwise_count(folds[a] ^ folds[b]).sum(axis=-1, dtype=np.int64), num, den)


def _within(x: np.ndarray, y: np.ndarray, differ: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Whether sets of ``x`` and ``y`` shingles that differ in at least ``differ`` may reach the threshold."""
    differ = np.where(np.maximum(x, y) >= WIDE_SIZE, 0, differ)  # sizes from WIDE_SIZE on are not told apart everywhere
    return (np.minimum(x, y) * den >= num * np.maximum(x, y)) & (differ * (den + num) <= (x + y) * (den - num))


def _groups(blocks: DataFrame, buckets: int, num: int = NUM, den: int = DEN) -> DataFrame:
    """Documents that share a signature and may be similar: hub (the least), members (the others; ``wide``: groups of more
    than two, joined by hub), ``sig`` where it is hot; rows of hot signatures without hub; and base."""

    def parts(members: np.ndarray, sizes: np.ndarray, folds: np.ndarray) -> Iterator[np.ndarray]:
        forest = Forest(len(members))
        everyone = np.arange(len(members))
        for lo in range(0, len(members), 256):
            rows = everyone[lo : lo + 256, None]
            u, v = np.nonzero((rows < everyone) & _alike(sizes, folds, members[rows], members[everyone][None, :], num, den))
            forest.add(u + lo, v)
        for root in np.flatnonzero(np.bincount(forest.root, minlength=len(members)) > 1):
            yield members[forest.root == root]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["base", "hub", "wide", "members", "sig"]
        kinds = {"sigs": U, "shorts": np.int64, "sizes": np.uint16, "folds": np.uint32, "hots": U}
        held: dict[str, list[np.ndarray]] = {c: [] for c in kinds}
        base_type = None
        for b in batches:
            base_type = b.schema.field("base").type
            own = b.filter(b.column("base").is_valid()).column("base")
            if len(own):
                blank = [pa.nulls(len(own), t) for t in (pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.int64())]
                yield pa.RecordBatch.from_arrays([own, *blank], names=columns)
            apart = b.filter(b.column("hot").is_valid())
            if apart.num_rows:
                blank = [pa.nulls(apart.num_rows, t) for t in (base_type, pa.int64(), pa.bool_())]
                mates = apart.column("mates").cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*blank, mates, apart.column("hot")], names=columns)
            packed = b.filter(b.column("sigs").is_valid())
            for c, kind in kinds.items():
                held[c] += [np.frombuffer(x, kind) for x in packed.column(c).to_pylist()]
        if not held["sigs"]:
            return
        sigs, shorts, sizes, folds, hots = (np.concatenate(held.pop(c)) for c in kinds)
        hots = np.unique(hots)
        order = np.argsort(sigs)
        same = sigs[order[1:]] == sigs[order[:-1]]
        # places of signatures that stand more than once, or are hot
        order = order[np.r_[same, False] | np.r_[False, same] | np.isin(sigs[order], hots)]
        if not len(order):
            return
        sigs = sigs[order]
        names, first, who = np.unique(shorts[order], return_index=True, return_inverse=True)
        sizes, folds = sizes[order][first].astype(np.int64), folds[order][first].reshape(-1, 1)
        cut = np.flatnonzero(np.r_[True, sigs[1:] != sigs[:-1]])
        long = np.diff(np.r_[cut, len(sigs)])
        hot = np.isin(sigs[cut], hots)
        two = (long == 2) & ~hot
        a, b = who[cut[two]], who[cut[two] + 1]
        a, b = np.minimum(a, b), np.maximum(a, b)
        good = (a != b) & _alike(sizes, folds, a, b, num, den)
        pairs = np.unique(a[good] * len(names) + b[good])
        seen: set[bytes] = set()
        wide: list[np.ndarray] = []
        more: list[int] = []
        named: list[tuple[int, int]] = []
        for lo, n, apart in zip(*(x[(long > 2) | hot] for x in (cut, long, hot)), strict=True):
            members = np.unique(who[lo : lo + n])
            if apart:
                named.append((int(members[0]), int(sigs[lo : lo + 1].view(np.int64)[0])))
            tag = hashlib.blake2b(members.tobytes(), digest_size=16).digest()
            if len(members) < 2 or tag in seen:
                continue
            seen.add(tag)
            if apart or len(members) > BLOCK_MEMBERS:
                wide.append(members)
                continue
            for part in parts(members, sizes, folds):
                if len(part) == 2:
                    more.append(int(part[0]) * len(names) + int(part[1]))
                else:
                    wide.append(part)
        pairs = np.union1d(pairs, np.array(more, np.int64))
        hubs = pairs // len(names)
        cut = [*np.flatnonzero(np.r_[True, hubs[1:] != hubs[:-1]]), len(pairs)] if len(pairs) else []
        rows = [(int(hubs[lo]), False, pairs[lo:hi] % len(names), None) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
        by_hub: dict[int, list[np.ndarray]] = {}
        for part in wide:
            by_hub.setdefault(int(part[0]), []).append(part[1:])
        for hub, parted in by_hub.items():
            members = np.unique(np.concatenate(parted))
            rows += [(hub, True, members[at : at + BLOCK_DOCS], None) for at in range(0, len(members), BLOCK_DOCS)]
        rows += [(hub, True, np.empty(0, np.int64), sig) for hub, sig in named]
        for at in range(0, len(rows), 1000):
            part = rows[at : at + 1000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(len(part), base_type),
                    pa.array([names[h] for h, _, _, _ in part], pa.int64()),
                    pa.array([w for _, w, _, _ in part], pa.bool_()),
                    pa.array([names[m] for _, _, m, _ in part], pa.list_(pa.int64())),
                    pa.array([x for _, _, _, x in part], pa.int64()),
                ],
                names=columns,
            )
        give_back()

    base = blocks.schema["base"].dataType.simpleString()
    return blocks.repartition(buckets, "bucket").mapInArrow(run, f"base {base}, hub long, wide boolean, members array<long>, sig long")


def _possible(pairs: DataFrame, info: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """Set keys (a, b), in order, of the pairs of short keys that sizes and whole sketches leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            differ = Sketches(b.column("sa").to_pylist() + b.column("sb").to_pylist()).differ(np.arange(n), np.arange(n, 2 * n))
            mask = pa.array(_within(b.column("na").to_numpy(), b.column("nb").to_numpy(), differ, num, den))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], names=["a", "b"])
        give_back()

    left = info.select(F.col("short").alias("hub"), F.col("set_key").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    right = info.select(F.col("short").alias("member"), F.col("set_key").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(left, "hub").join(right, "member").where("a != b")
    both = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "na", "nb", "sa", "sb")
    return both.mapInArrow(run, "a binary, b binary")


def _across(members: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """Possible pairs (a, b) inside groups between different components, of rows gid, size, main, most, member, root,
    n_shingles, sketch.

    A group is compared in blocks of ``BLOCK_MEMBERS``, each pair of blocks a task of its own; only pairs that sizes and
    whole sketches leave possible come out (folded sketches first). The ``most`` members of the largest component (``main``) have blocks of their
    own, which are not compared with each other.
    """

    def compare(unit: pd.DataFrame) -> pd.DataFrame:
        sizes, block = unit["n_shingles"].to_numpy(), unit["block"].to_numpy()
        whole = Sketches([bytes(x) for x in unit["sketch"]])
        bits = whole.folded(128)
        keys = [bytes(k) for k in unit["member"]]
        root = np.unique([bytes(r).hex() for r in unit["root"]], return_inverse=True)[1]
        first, second = int(unit["x"].iloc[0]), int(unit["y"].iloc[0])
        rows, others = np.flatnonzero(block == first), np.flatnonzero(block == second)
        out: list[tuple[bytes, bytes]] = []
        for at in range(0, len(rows), 64):
            u, v = np.meshgrid(rows[at : at + 64], others, indexing="ij")
            apart = (root[u] != root[v]) & ((first != second) | (u < v))
            u, v = u[apart], v[apart]
            ok = np.concatenate([_alike(sizes, bits, u[k : k + 20_000], v[k : k + 20_000], num, den) for k in range(0, len(u), 20_000)] or [np.empty(0, bool)])
            u, v = u[ok], v[ok]
            ok = _within(sizes[u], sizes[v], whole.differ(u, v), num, den)
            out += [(min(keys[i], keys[j]), max(keys[i], keys[j])) for i, j in zip(u[ok], v[ok], strict=True)]
        return pd.DataFrame(out, columns=["a", "b"])

    number = lambda n: F.ceil(n / BLOCK_MEMBERS).cast("int")
    own, rest, inside = number(F.col("most")), number(F.col("size") - F.col("most")), F.col("root") == F.col("main")
    place = F.xxhash64("member")
    df = members.withColumn("block", F.when(inside, F.pmod(place, own)).otherwise(own + F.pmod(place, rest)).cast("int"))
    others = F.sequence(F.when(inside, own).otherwise(F.lit(0)), own + rest - 1)
    units = F.transform(others, lambda y: F.struct(F.least("block", y).alias("x"), F.greatest("block", y).alias("y")))
    df = df.withColumn("unit", F.explode(units)).select("gid", "unit.x", "unit.y", "block", "member", "root", "n_shingles", "sketch")
    return df.groupBy("gid", "x", "y").applyInPandas(lambda unit: compare(unit), "a binary, b binary")


def _sets_of(keys: DataFrame, info: DataFrame, docs: DataFrame) -> DataFrame:
    """set_key and whole set (sorted hashes) of the given keys, from one text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                sets = [shingler(t) for t in b.column(0).slice(lo, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_key(h) if len(h) else None for h in sets], pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary())],
                    names=["set_key", "hashes"],
                )
        give_back()

    wanted = stored(info.join(keys, "set_key", "left_semi").select("text_hash"), "candidate-texts")
    few = wanted.count() <= BROADCAST_KEYS
    texts = docs.select("text", F.xxhash64("text").alias("text_hash")).join(F.broadcast(wanted) if few else wanted, "text_hash", "left_semi")
    found = texts.select("text").mapInArrow(run, "set_key binary, hashes binary")
    return found.groupBy("set_key").agg(F.min("hashes").alias("hashes"))


def _verified(pairs: DataFrame, info: DataFrame, docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """The (a, b) rows of ``pairs`` (distinct set keys) that reach the threshold, by whole sets."""
    sets = _sets_of(pairs.select(F.col("a").alias("set_key")).union(pairs.select("b")).distinct(), info, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for left, right in zip(b.column(2), b.column(3), strict=True):
                h, g = np.frombuffer(left.as_py(), U), np.frombuffer(right.as_py(), U)
                common = len(np.intersect1d(h, g, assume_unique=True))
                ok.append(den * common >= num * (len(h) + len(g) - common))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])
        give_back()

    left = sets.select(F.col("set_key").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("set_key").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a binary, b binary")


def similar_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per document its set (doc_id, n_shingles, set_key, text_hash), and verified links (a, b) between set keys.

    The connected components of these links are those of all links.
    """
    docs = docs.select("doc_id", "text")
    buckets = partitions(docs.sparkSession)
    found = stored(_groups(_signature_blocks(docs, buckets), buckets), "signature-groups")
    base, groups = found.where("base is not null").select("base.*"), found.where("hub is not null")
    one = base.where("set_key is not null").groupBy("set_key")
    info = stored(one.agg(*(F.min(c).alias(c) for c in ("short", "n_shingles", "text_hash", "sketch"))), "sets")
    named = stored(groups.where("sig is not null").select("sig", "hub"), "hot-signatures")
    apart = found.where("hub is null and sig is not null").select("sig", "members")
    apart = apart.join(F.broadcast(named) if named.count() <= BROADCAST_KEYS else named, "sig")
    apart = stored(apart.select("hub", F.explode("members").alias("member")).where("hub != member").distinct(), "hot-groups")
    # a hub and a member meet in every bucket of a signature they share: one row from here on
    met = groups.select("hub", F.explode("members").alias("member"), "wide").union(apart.select("hub", "member", F.lit(True)))
    met = stored(met.groupBy("hub", "member").agg(F.max("wide").alias("wide")), "group-members")
    first = stored(_possible(met.select("hub", "member"), info).distinct(), "pairs")
    links = stored(_verified(first, info, docs), "links")
    roots = connected_components(links)
    names = info.select("short", "set_key")
    wide = met.where("wide").select("hub", "member")
    wide = wide.join(names.select(F.col("short").alias("member"), F.col("set_key").alias("key")), "member").select("hub", "key")
    own = wide.select("hub").distinct().join(names.select(F.col("short").alias("hub"), F.col("set_key").alias("key")), "hub")
    placed = wide.union(own.select("hub", "key")).join(roots.withColumnRenamed("vertex", "key"), "key", "left")
    placed = stored(placed.select("hub", "key", F.coalesce("root", "key").alias("root")), "wide-groups")
    several = placed.groupBy("hub", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("hub")
    several = several.agg(F.sum("n").alias("size"), F.max(F.struct(F.col("n").alias("most"), F.col("root").alias("main"))).alias("of"))
    mates = placed.join(several.select("hub", "size", "of.*").where("most < size"), "hub")
    mates = mates.select(F.col("hub").alias("gid"), "size", "main", "most", F.col("key").alias("member"), "root")
    mates = mates.join(info.select(F.col("set_key").alias("member"), "n_shingles", "sketch"), "member")
    pairs = stored(_across(mates).distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    links = links.union(stored(_verified(pairs, info, docs), "links"))
    return base.select("doc_id", "n_shingles", "set_key", "text_hash"), links


def _placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with a set and their ``root`` (a set key of their component), and documents without one."""
    base, links = similar_sets(docs)
    roots = connected_components(links).withColumnRenamed("vertex", "set_key")
    placed = base.where("set_key is not null").join(roots, "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    return placed, base.where("set_key is null")


def components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, set_key, component_id.

    component_id is the smallest doc_id reachable over links, the document's own included. Null and empty texts, and texts
    without words, have an empty set: n_shingles 0, null key, component_id their own doc_id. Equal sets are one vertex, so
    repeated rows and copies share a component; a null doc_id takes part and is never the smallest. An empty table gives
    no rows. Other columns are not read.
    """
    placed, empty = _placed(docs)
    lowest = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    full = placed.join(lowest, "root").select("doc_id", "n_shingles", "set_key", "component_id")
    return full.union(empty.select("doc_id", "n_shingles", "set_key", F.col("doc_id").alias("component_id")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each component: that of the smallest doc_id.

    Nulls sort last; among rows of one doc_id the one of least text hash stays, and of equal rows one. Documents without
    words link with nothing and all stay.
    """
    placed, empty = _placed(docs)
    placed = stored(placed.select("doc_id", "text_hash", "root"), "placed")
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("first"))
    keep = stored(first.select("first.doc_id", "first.text_hash").union(empty.select("doc_id", "text_hash")).distinct(), "kept")
    keep = keep.select(F.col("doc_id").alias("__jaccard_id"), F.col("text_hash").alias("__jaccard_hash"))
    again = placed.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("doc_id").alias("__jaccard_id"), F.col("text_hash").alias("__jaccard_hash")
    )
    again = stored(again, "repeated-rows")
    rows = docs.withColumn("__jaccard_row", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__jaccard_id")) & (F.col("__jaccard_row") == F.col("__jaccard_hash"))
    kept = rows.join(F.broadcast(keep) if keep.count() <= BROADCAST_KEYS else keep, same, "left_semi")
    if again.limit(1).count():
        few = F.broadcast(again) if again.count() <= BROADCAST_KEYS else again
        once = kept.join(few, same, "left_semi").dropDuplicates(["doc_id", "__jaccard_row"])
        kept = kept.join(few, same, "left_anti").union(once)
    return kept.drop("__jaccard_row")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT rid, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]) END) AS sh FROM w
), n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.rid <> b.rid GROUP BY a.rid, b.rid),
l AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
reach AS (SELECT a AS u, b AS v FROM l UNION SELECT u, b FROM reach JOIN l ON v = a),
low AS (SELECT u, min(doc_id) AS m FROM reach JOIN w ON w.rid = v GROUP BY u)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(low.m, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (rid) LEFT JOIN low ON low.u = w.rid
"""
