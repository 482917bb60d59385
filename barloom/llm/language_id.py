"""Language identification by unigram pieces with all segmentations summed.

Every language has a probability for each piece of a fixed public vocabulary (letters only, as lower-casing
leaves them, with or without the word-start mark). The probability of a word is the sum over all its segmentations, by a forward
pass over its characters; a text scores the sum of its words' logarithms. The piece probabilities come from expectation
maximisation (forward-backward) over word counts of a bounded hash sample of labelled documents; a text's scores cover
all its words. Distinct words are scored once per task, for all languages at once.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import give_back

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Documents per language (in expectation) whose whole texts are counted to fit the model.
FIT_DOCS = 500
MAX_LANGUAGES = 1000
ROUNDS = 2
FLOOR = 1e-7
LONG_WORD = 32
BASE = np.uint64(0x9E3779B97F4A7C15)
MAX_REMEMBERED = 200_000
WORDS = regex.compile(r"\p{L}+")


@functools.lru_cache(maxsize=2)
def pieces_of(path: str) -> tuple[str, ...]:
    """Letter pieces of a sentencepiece vocabulary that lower-casing leaves unchanged, of any script and length."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    keep = {p for p in found if p == p.lower() and regex.fullmatch(f"{MARK}?\\p{{L}}+|{MARK}", p)}
    return tuple(sorted(keep))


def _hashes(pieces: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(len(pieces), dtype=np.uint64)
    for k, p in enumerate(pieces):
        h = 0
        for ch in p:
            h = (h * int(BASE) + ord(ch)) & 0xFFFFFFFFFFFFFFFF
        out[k] = h
    return out


class Lattice:
    """Piece ids of all substrings of a batch of words, and sums over their segmentations."""

    def __init__(self, pieces: tuple[str, ...]):
        h = _hashes(pieces)
        order = np.argsort(h)
        self.keys = np.append(h[order], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.ids = np.append(order, len(pieces))
        self.unknown = len(pieces)  # a single letter outside the vocabulary
        self.none = len(pieces) + 1  # no piece
        self.longest = max(map(len, pieces), default=1)

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids[word, start, length - 1] with the mark as first character, and the words' lengths with it."""
        sizes = np.array([len(w) + 1 for w in words])
        width = int(sizes.max())
        text = "".join((MARK + w).ljust(width, "\0") for w in words)
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), width).astype(np.uint64)
        ids = np.full((len(words), width, self.longest), self.none, dtype=np.int32)
        h = np.zeros_like(cp)
        for size in range(1, min(self.longest, width) + 1):
            n = width - size + 1
            h = h[:, :n] * BASE + cp[:, size - 1 :]
            at = np.searchsorted(self.keys, h)
            got = np.where(self.keys[at] == h, self.ids[at], self.unknown if size == 1 else self.none)
            inside = (np.arange(n) + size) <= sizes[:, None]
            ids[:, :n, size - 1] = np.where(inside, got, self.none)
        return ids, sizes

    def forward(self, ids: np.ndarray, sizes: np.ndarray, p: np.ndarray) -> np.ndarray:
        """alpha[word, position, model]; ``p`` has a row per piece, one for unknown letters and one of zeros."""
        n, width, _ = ids.shape
        alpha = np.zeros((n, width + 1, p.shape[1]))
        alpha[:, 0] = 1
        for i in range(width):
            for k in range(min(self.longest, width - i)):
                alpha[:, i + k + 1] += alpha[:, i] * p[ids[:, i, k]]
        return alpha

    def word_logs(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log-probability of each word under each model."""
        out = np.empty((len(words), p.shape[1]))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        lo = 0
        while lo < len(order):
            width = len(words[order[lo]])
            if width > LONG_WORD:
                out[order[lo]] = self._long(words[order[lo]], p)
                lo += 1
                continue
            hi = lo
            while hi < len(order) and hi - lo < 8192 and len(words[order[hi]]) <= min(LONG_WORD, width + 3):
                hi += 1
            part = [words[i] for i in order[lo:hi]]
            ids, sizes = self.arcs(part)
            alpha = self.forward(ids, sizes, p)
            out[order[lo:hi]] = np.log(alpha[np.arange(len(part)), sizes])
            lo = hi
        return out

    def _long(self, word: str, p: np.ndarray) -> np.ndarray:
        """The same for a word of any length, in bounded memory: a window of alphas, rescaled at every step."""
        window = [np.ones(p.shape[1])] + [np.zeros(p.shape[1]) for _ in range(self.longest)]
        total = np.zeros(p.shape[1])
        step = 4096
        for lo in range(0, len(word) + 1, step):
            # the chunk carries ``longest`` further characters, whose own starts belong to the next chunk
            chunk = (MARK + word)[lo : lo + step + self.longest]
            ids = self._chunk_arcs(chunk)
            for i in range(min(step, len(word) + 1 - lo)):
                for k in range(self.longest):
                    if ids[i, k] != self.none:
                        window[k + 1] = window[k + 1] + window[0] * p[ids[i, k]]
                window = window[1:] + [np.zeros(p.shape[1])]
                scale = np.maximum(np.max(window, axis=0), 1e-300)
                window = [w / scale for w in window]
                total += np.log(scale)
        return total + np.log(np.maximum(window[0], 1e-300))

    def _chunk_arcs(self, chunk: str) -> np.ndarray:
        cp = np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        ids = np.full((len(cp), self.longest), self.none, dtype=np.int64)
        h = np.zeros_like(cp)
        for size in range(1, min(self.longest, len(cp)) + 1):
            n = len(cp) - size + 1
            h = h[:n] * BASE + cp[size - 1 :]
            at = np.searchsorted(self.keys, h)
            ids[:n, size - 1] = np.where(self.keys[at] == h, self.ids[at], self.unknown if size == 1 else self.none)
        return ids

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece (and of unknown letters) over all segmentations, for one model."""
        total = np.zeros(self.none + 1)
        order = sorted((i for i in range(len(words)) if len(words[i]) <= LONG_WORD), key=lambda i: len(words[i]))
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                total += counts[i] * self._long_expected(w, p)
        for lo in range(0, len(order), 8192):
            part = order[lo : lo + 8192]
            ids, sizes = self.arcs([words[i] for i in part])
            n, width, _ = ids.shape
            alpha = self.forward(ids, sizes, p[:, None])[:, :, 0]
            beta = np.zeros((n, width + 1 + self.longest))
            beta[np.arange(n), sizes] = 1
            weight = counts[part] / alpha[np.arange(n), sizes]
            for i in reversed(range(width)):
                for k in range(min(self.longest, width - i)):
                    arc = p[ids[:, i, k]] * beta[:, i + k + 1]
                    beta[:, i] += arc
                    total += np.bincount(ids[:, i, k], weights=weight * alpha[:, i] * arc, minlength=self.none + 1)
        return total

    def _long_expected(self, word: str, p: np.ndarray) -> np.ndarray:
        """The same for one word of any length: sums in logarithms, arcs of a stretch of positions at a time."""
        total, text, step = np.zeros(self.none + 1), MARK + word, 4096
        n = len(text)
        log_p = np.log(p, out=np.full(len(p), -np.inf), where=p > 0)
        stretch = lambda lo: self._chunk_arcs(text[lo : lo + step + self.longest - 1])
        ahead = np.full(n + 1, -np.inf)  # of reaching a position
        ahead[0] = 0
        for lo in range(0, n, step):
            arcs = log_p[stretch(lo)]
            for i in range(lo, min(lo + step, n)):
                k = min(self.longest, n - i)
                ahead[i + 1 : i + 1 + k] = np.logaddexp(ahead[i + 1 : i + 1 + k], ahead[i] + arcs[i - lo, :k])
        back = np.full(n + 1 + self.longest, -np.inf)  # of the rest from a position
        back[n] = 0
        for lo in reversed(range(0, n, step)):
            ids = stretch(lo)
            arcs = log_p[ids]
            hi = min(lo + step, n)
            for i in reversed(range(lo, hi)):
                back[i] = np.logaddexp.reduce(arcs[i - lo] + back[i + 1 : i + 1 + self.longest])
            rest = np.lib.stride_tricks.sliding_window_view(back[lo + 1 : hi + self.longest], self.longest)
            uses = np.exp(ahead[lo:hi, None] + arcs[: hi - lo] + rest - ahead[n])
            total += np.bincount(ids[: hi - lo].ravel(), weights=uses.ravel(), minlength=self.none + 1)
        return total


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    pieces: tuple[str, ...]
    table: np.ndarray  # probability of piece (row) in language (column); then unknown letters; then zeros


def fit_counts(counts: dict[str, dict[str, int]], pieces: tuple[str, ...], rounds: int = ROUNDS) -> Model:
    """Piece probabilities of each language from its word counts."""
    lattice = Lattice(pieces)
    columns = []
    for lang in sorted(counts):
        words = sorted(counts[lang])
        n = np.array([counts[lang][w] for w in words], dtype=float)
        p = np.array([0.05 ** len(x) for x in pieces] + [FLOOR, 0.0])
        for _ in range(rounds):
            uses = lattice.expected(words, n, p) if words else np.zeros(lattice.none + 1)
            p = (uses + 0.01) / (uses[:-1].sum() + 0.01 * len(uses))
            p[lattice.unknown], p[lattice.none] = max(p[lattice.unknown], FLOOR), 0.0
        columns.append(p)
    return Model(tuple(sorted(counts)), pieces, np.array(columns).T.copy() if columns else np.zeros((len(pieces) + 2, 0)))


def fit(docs: DataFrame, pieces: tuple[str, ...], fit_docs: int = FIT_DOCS) -> Model:
    """The model of labelled ``docs`` (doc_id, text, lang): a hash sample of about ``fit_docs`` documents a language.

    Rows without text or label are not used. The sample is chosen by a hash of the text, so it does not depend on order.
    """
    rows = docs.select("text", "lang").where("text is not null and lang is not null")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not totals:
        return fit_counts({}, pieces)
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    share = F.create_map(*[x for k, v in sorted(totals.items()) for x in (F.lit(k), F.lit(fit_docs / v))])
    words = rows.where(draw < F.element_at(share, F.col("lang"))).select(
        "lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")
    )
    counts: dict[str, dict[str, int]] = {k: {} for k in totals}
    for r in words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        counts[r["lang"]][r["word"]] = r["n"]
    return fit_counts(counts, pieces)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(model.pieces)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.logs = np.empty((0, len(self.model.languages)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.known) > MAX_REMEMBERED:
            self._forget()
        found = [Counter(WORDS.findall(t.lower())) if t else Counter() for t in texts]
        new = list(set().union(*found).difference(self.known))
        if new and self.model.languages:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.logs = np.concatenate([self.logs, self.lattice.word_logs(new, self.model.table)])
        names, scores = [], []
        for words in found:
            if not words or not self.model.languages:
                names.append("und")
                scores.append(0.0)
                continue
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            log = np.fromiter(words.values(), np.float64, len(words)) @ self.logs[at]
            share = np.exp(log - log.max())
            names.append(self.model.languages[int(log.argmax())])
            scores.append(float(1 / share.sum()))
        return names, scores


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with all its columns and ``lang_pred``, ``score``: the likeliest language and its posterior.

    ``und`` with score 0 where the text is null or has no letter (or no language was learned). Words and pieces of any
    length count; repeated rows give equal rows; an empty table gives none.
    """
    kept = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(kept)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                names, scores = scorer.predict(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    schema=pa.schema([*[f for f in part.schema][:-1], pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())]),
                )
        give_back()

    others = docs.drop("lang_pred", "score")
    rows = others.select("*", F.col(text).alias("__language_text"))
    schema = others.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(run, schema)


def vocabulary(path: str | None = None) -> tuple[str, ...]:
    import public_tokenizers as public

    return pieces_of(path or public.path(VOCABULARY))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32(doc_id as text) falls in ``fold``; false where doc_id is null."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def identify(docs: DataFrame, path: str | None = None, fit_docs: int = FIT_DOCS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score, learned without the held-out fold."""
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id"), 5, 0))
    model = fit(rows.where("not held_out"), vocabulary(path), fit_docs)
    return predict(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
