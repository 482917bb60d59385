"""Byte-level BPE encoding and decoding by rank files.

Each piece of the split pattern is encoded alone. A segment tree over its byte positions holds, per live position, the
rank of the pair that starts there together with the position, so the root is the leftmost pair of least rank. A merge
updates three leaves (the merged position, its live left neighbour, the absorbed right one) and their logarithmic paths.
Pieces of one width go through their merges in step, one numpy operation per tree level for all of them; distinct pieces
are encoded once per task.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "byte_bpe_50k.tiktoken"
NONE = np.int64(1) << np.int64(62)
#: Cells of one tree batch, and distinct pieces that a task remembers before it starts over: memory bounds only.
BATCH_CELLS = 1 << 20
MAX_REMEMBERED = 300_000


class Vocabulary:
    """Ranks of a vocabulary file: lookups of bytes and of pairs of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        by_id = sorted((i, t) for t, i in ranks.items())
        self.base = by_id[-1][0] + 1
        lengths = np.zeros(self.base + 1, dtype=np.int64)
        for i, t in by_id:
            lengths[i + 1] = len(t)
        self.starts = np.cumsum(lengths)
        self.lengths = lengths[1:]
        self.flat = np.frombuffer(b"".join(t for _, t in by_id), dtype=np.uint8)
        keys, merged = [], []
        for t, i in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a * self.base + b)
                    merged.append(i)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.append(np.array(keys, dtype=np.int64)[order], np.iinfo(np.int64).max)
        self.merged = np.append(np.array(merged, dtype=np.int64)[order], -1)

    @staticmethod
    @functools.lru_cache(maxsize=2)
    def load(path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each merged pair, or -1."""
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def encode_group(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of pieces of at most ``width`` bytes (a power of two)."""
        n = len(pieces)
        sizes = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
        ids = self.byte_ids[raw]
        cols = np.arange(width)
        live = cols < sizes[:, None]
        nxt = np.broadcast_to(cols + 1, (n, width)).copy()  # live right neighbour; the size of the piece is the end
        prv = np.broadcast_to(cols - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE)
        has = cols[:-1] < sizes[:, None] - 1
        rank = self.pair(ids[:, :-1], ids[:, 1:])
        tree[:, width : 2 * width - 1] = np.where(has & (rank >= 0), rank * width + cols[:-1], NONE)
        for level in reversed(range(1, width)):
            if level & (level + 1) == 0:  # the last node of a level: build that level at once
                lo = (level + 1) // 2
                tree[:, lo : level + 1] = np.minimum(tree[:, 2 * lo : 2 * level + 2 : 2], tree[:, 2 * lo + 1 : 2 * level + 2 : 2])
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            top = tree[rows, 1]
            at, new = top % width, top // width
            right = nxt[rows, at]
            after = nxt[rows, right]
            ids[rows, at] = new
            live[rows, right] = False
            nxt[rows, at] = after
            inner = after < sizes[rows]
            prv[rows[inner], after[inner]] = at[inner]
            before = prv[rows, at]
            ahead = np.where(inner, self.pair(new, ids[rows, np.where(inner, after, 0)]), -1)
            self._set(tree, rows, right, np.full(len(rows), NONE), width)
            self._set(tree, rows, at, np.where(ahead >= 0, ahead * width + at, NONE), width)
            r = before >= 0
            if r.any():
                back = self.pair(ids[rows[r], before[r]], new[r])
                self._set(tree, rows[r], before[r], np.where(back >= 0, back * width + before[r], NONE), width)
            rows = rows[tree[rows, 1] < NONE]
        return [ids[i, live[i]] for i in range(n)]

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray, width: int) -> None:
        node = leaf + width
        tree[rows, node] = value
        while width > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            width >>= 1

    def encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(pieces)
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for i, p in enumerate(pieces):
            b = p.encode()
            if (rank := self.ranks.get(b)) is not None:
                out[i] = np.array([rank])
            else:
                groups.setdefault(1 << (len(b) - 1).bit_length(), []).append((i, b))
        for width, group in groups.items():
            step = max(1, BATCH_CELLS // width)
            for lo in range(0, len(group), step):
                part = group[lo : lo + step]
                for (i, _), ids in zip(part, self.encode_group([b for _, b in part], width), strict=True):
                    out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return b""
        where = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.flat[where].tobytes()


class Encoder:
    """Encodes texts and remembers the ids of distinct pieces."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.find = regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > MAX_REMEMBERED:
            self._forget()
        found = [self.find(t) for t in texts]
        known = self.known
        new = set().union(*found).difference(known)
        if new:
            self.learn(list(new))
        out = []
        for pieces in found:
            at = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
            sizes = self.sizes[at]
            total = np.cumsum(sizes)
            shift = np.repeat(self.starts[at] - (total - sizes), sizes)
            out.append(self.flat[np.arange(len(shift)) + shift])
        return out

    def learn(self, new: list[str]) -> None:
        ids = self.vocabulary.encode_pieces(new)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        sizes = np.array([len(x) for x in ids])
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.flat = np.append(self.flat, np.concatenate(ids).astype(np.int32))


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, ids array<int>, n_tokens, ids_sha256, decoded_sha256.

    ``path`` is a rank file that every executor can open; the public vocabulary by default. The digests are those of the
    ids as little-endian unsigned 32-bit integers and of the bytes they decode to. A null text counts as empty: no ids.
    Repeated rows give equal rows; an empty table gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers as public

        vocabulary = Vocabulary.load(path or public.path(RANKS))
        encoder = Encoder(vocabulary, pattern or public.PATTERN)
        for b in batches:
            for lo in range(0, b.num_rows, 250):
                part = b.slice(lo, 250)
                ids = encoder.encode_all([t or "" for t in part.column(1).to_pylist()])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                        pa.array(np.diff(offsets).astype(np.int64)),
                        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(vocabulary.decode(x)).hexdigest() for x in ids]),
                    ],
                    names=["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Text of each row of ``encoded`` (doc_id, ids): doc_id, text. Null ids decode to null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers as public

        vocabulary = Vocabulary.load(path or public.path(RANKS))
        for b in batches:
            texts = [None if x is None else vocabulary.decode(np.array(x, np.int64)).decode(errors="replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(F.col("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
