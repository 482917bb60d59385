"""Toxic spans and document scores from a linear-chain conditional random field.

The chain tags each word of a sentence as clean or toxic. Emission features are the word, its prefixes and its suffix;
transitions are learned. The document labels become labelled tokens first: in documents marked toxic, a word is a toxic
token if it or a prefix of it stands in such documents almost only; all other words are clean tokens. Training maximises
the conditional likelihood (forward-backward gradients) on a bounded hash sample of labelled documents. For scoring,
every word of every text gets its forward-backward marginal; the sum of their squares (so that many unlikely words do not
add up in a long text) and their maximum per document go through a logistic curve fitted on the same sample, and words whose
marginal passes one half are the offending offsets.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.language_id import held_out

#: Labelled documents (in expectation) whose whole texts fit the model.
FIT_DOCS = 2000
#: Broadcast bound of the sampled label rows.
MAX_FIT_ROWS = 100_000
MIN_DOCS, MIN_SHARE = 5, 0.9
ROUNDS = 30
THRESHOLD = 0.3
MAX_REMEMBERED = 400_000
TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+|[.!?\n]")
BREAKS = frozenset(".!?\n")


def features_of(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:k]}" for k in range(4, min(8, len(word) + 1))), f"${word[-3:]}"]


def token_labels(docs: list[tuple[list[str], int]], min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> set[str]:
    """Features (word or prefix) that mark toxic tokens, from (words, label) of documents.

    A mark stands in toxic documents almost only, and there between enough different neighbours: the words of one
    document and its copies do not become marks by being repeated.
    """
    seen, toxic = Counter(), Counter()
    for words, label in docs:
        marks = {f for w in set(words) for f in features_of(w) if f[0] != "$"}
        seen.update(marks)
        if label:
            toxic.update(marks)
    places: dict[str, set] = {f: set() for f, n in toxic.items() if n >= min_docs and n / (seen[f] + 0.1) >= min_share}
    for words, label in docs:
        if label:
            for before, word, after in zip([None, *words], words, [*words[1:], None], strict=False):
                for f in features_of(word):
                    if f in places:
                        places[f].add((before, after))
    return {f for f, found in places.items() if len(found) >= min_docs}


class Sentences:
    """Word sequences laid out by length, so that one numpy step moves all of them by one word."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.starts = (np.cumsum(lengths) - lengths)[self.order]
        self.total = int(lengths.sum())
        longest = int(self.lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-self.lengths, -np.arange(longest), side="left")  # sequences longer than step

    def marginals(self, emit: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of every word, and the expected counts of the four transitions.

        ``emit`` is the score of toxic over clean per word; ``transition[a, b]`` the score from tag a to tag b.
        """
        t, n = np.exp(transition), len(self.lengths)
        forward = np.empty((self.total, 2))
        e = np.exp(np.clip(emit, -30, 30))
        alpha = np.ones((n, 2))
        for step, live in enumerate(self.active):
            at = self.starts[:live] + step
            alpha = alpha[:live] @ t if step else np.ones((live, 2))
            alpha[:, 1] *= e[at]
            alpha /= alpha.sum(axis=1, keepdims=True)
            forward[at] = alpha
        p = np.empty(self.total)
        pairs = np.zeros((2, 2))
        beta = np.ones((n, 2))
        for step in reversed(range(len(self.active))):
            live = self.active[step]
            at = self.starts[:live] + step
            if step + 1 < len(self.active):
                more = self.active[step + 1]
                ahead = beta[:more].copy()
                ahead[:, 1] *= e[at[:more] + 1]
                joint = forward[at[:more]][:, :, None] * t[None] * ahead[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                back = ahead @ t.T
                beta[:more] = back / back.sum(axis=1, keepdims=True)
            both = forward[at] * beta[:live]
            p[at] = both[:, 1] / both.sum(axis=1)
        return p, pairs


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]  # by feature
    bias: float
    transition: np.ndarray
    curve: np.ndarray  # constant, weight of log(1 + sum of squared marginals), weight of the highest marginal

    def word_score(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features_of(word))

    def document(self, expected: np.ndarray, highest: np.ndarray) -> np.ndarray:
        x = self.curve[0] + self.curve[1] * np.log1p(expected) + self.curve[2] * highest
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def sentences_of(text: str) -> tuple[list[str], list[int]]:
    """Words in order and the lengths of the sentences (stop marks and line ends close one)."""
    words, lengths, n = [], [], 0
    for t in TOKEN.findall(text):
        if t in BREAKS:
            if n:
                lengths.append(n)
                n = 0
        else:
            words.append(t)
            n += 1
    if n:
        lengths.append(n)
    return words, lengths


def _curve(expected: np.ndarray, highest: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(y)), np.log1p(expected), highest])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        w -= np.linalg.solve(h, x.T @ (p - y) + 0.05 * w)
    return w


def fit_texts(rows: Iterator[tuple[str | None, int]], rounds: int = ROUNDS) -> Model:
    """The model of (text, label) rows."""
    known: dict[str, int] = {}
    docs, ids, lengths, ends = [], [], [], [0]
    for text, label in rows:
        words, sizes = sentences_of((text or "").lower())
        docs.append((words, int(label)))
        ids.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        lengths += sizes
        ends.append(ends[-1] + len(words))
    if not docs or not ends[-1]:
        share = (sum(y for _, y in docs) + 0.5) / (len(docs) + 1)
        return Model({}, 0.0, np.zeros((2, 2)), np.array([np.log(share / (1 - share)), 0.0, 0.0]))
    marks = token_labels(docs)
    vocabulary = list(known)
    marked = np.array([any(f in marks for f in features_of(w)) for w in vocabulary])
    names: dict[str, int] = {}
    cells, counts = array("l"), array("l")
    for w in vocabulary:
        own = [names.setdefault(f, len(names)) for f in features_of(w)]
        cells.extend(own)
        counts.append(len(own))
    word_at, feature_at = np.repeat(np.arange(len(vocabulary)), np.array(counts)), np.array(cells)
    word = np.concatenate(ids)
    y_doc = np.array([y for _, y in docs])
    gold = marked[word] & (np.repeat(y_doc, np.diff(ends)) == 1)
    sent = Sentences(np.array(lengths))
    first = np.zeros(sent.total, bool)
    first[sent.starts] = True
    follows = np.flatnonzero(~first)
    gold_pairs = np.bincount(gold[follows - 1] * 2 + gold[follows], minlength=4).reshape(2, 2).astype(float)
    theta, bias, transition = np.zeros(len(names)), np.log((gold.sum() + 1) / (len(gold) + 2)), np.zeros((2, 2))
    g_theta, g_bias, g_tr = np.full(len(names), 1e-8), 1e-8, np.full((2, 2), 1e-8)
    for _ in range(rounds):
        score = bias + np.bincount(word_at, weights=theta[feature_at], minlength=len(vocabulary))
        p, pairs = sent.marginals(score[word], transition)
        error = np.bincount(word, weights=gold - p, minlength=len(vocabulary))
        step = np.bincount(feature_at, weights=error[word_at], minlength=len(names)) - 0.05 * theta
        g_theta += step**2
        theta += 0.8 * step / np.sqrt(g_theta)
        slope = float(error.sum())
        g_bias += slope**2
        bias += 0.3 * slope / np.sqrt(g_bias)
        turn = gold_pairs - pairs - 0.05 * transition
        g_tr += turn**2
        transition = transition + 0.2 * turn / np.sqrt(g_tr)
    score = bias + np.bincount(word_at, weights=theta[feature_at], minlength=len(vocabulary))
    p, _ = sent.marginals(score[word], transition)
    doc = np.repeat(np.arange(len(docs)), np.diff(ends))
    expected = np.bincount(doc, weights=p * p, minlength=len(docs))
    highest = np.zeros(len(docs))
    np.maximum.at(highest, doc, p)
    kept = {f: float(theta[k]) for f, k in names.items() if abs(theta[k]) > 1e-3}
    return Model(kept, float(bias), transition, _curve(expected, highest, y_doc))


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """The model of documents (doc_id, text) with labels (doc_id, toxic): a hash sample of about ``fit_docs`` of them.

    Rows without doc_id or label are not used; a doc_id with several labels is toxic if any of them is, and one with
    several texts gives the one of least hash, so the driver sees one text per sampled doc_id, whatever its rows.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = known.where(draw < fit_docs / max(total, 1))
    few = sample.count() <= MAX_FIT_ROWS
    rows = docs.select("doc_id", "text").join(F.broadcast(sample) if few else sample, "doc_id")
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("text"), "text")).alias("one"))
    rows = rows.select("doc_id", "one.text", "toxic")
    ordered = sorted(rows.toLocalIterator(), key=lambda r: (r["doc_id"], r["text"] or ""))
    return fit_texts((r["text"], r["toxic"]) for r in ordered)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.empty(0)

    def marginals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of all words of the texts, and the number of words of each text."""
        if len(self.known) > MAX_REMEMBERED:
            self._forget()
        known = self.known
        words, lengths, counts, new = [], [], [], []
        for t in texts:
            w, sizes = sentences_of((t or "").lower())
            words += w
            lengths += sizes
            counts.append(len(w))
        new = list(set(words).difference(known))
        known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        self.scores = np.append(self.scores, [self.model.word_score(w) for w in new])
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if not len(at):
            return np.empty(0), np.array(counts, np.int64)
        p, _ = Sentences(np.array(lengths)).marginals(self.scores[at], self.model.transition)
        return p, np.array(counts, np.int64)

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, counts = self.marginals(texts)
        doc = np.repeat(np.arange(len(counts)), counts)
        highest = np.zeros(len(counts))
        np.maximum.at(highest, doc, p)
        return self.model.document(np.bincount(doc, weights=p * p, minlength=len(counts)), highest), p, counts


def score(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, score, and with ``spans`` the offsets (code points) of toxic words.

    Null texts and texts without words score what a document without toxic words does, and have no spans. Repeated rows
    give equal rows; an empty table gives none; other columns are not read.
    """

    def found(text: str | None, p: np.ndarray) -> list[dict]:
        if not (p > 0.5).any():
            return []
        lower = text.lower()
        at = [m.span() for m in TOKEN.finditer(lower) if m[0] not in BREAKS]
        spans = [(s, e, float(q)) for (s, e), q in zip(at, p, strict=True) if q > 0.5]
        if len(lower) != len(text):  # some letters lower-case to two code points
            ends = np.cumsum([len(ch.lower()) for ch in text])
            place = lambda i: int(np.searchsorted(ends, i, "right"))
            spans = [(place(s), place(e - 1) + 1, q) for s, e, q in spans]
        return [{"start": s, "end": e, "marginal": q} for s, e, q in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            for lo in range(0, b.num_rows, 250):
                part = b.slice(lo, 250)
                texts = part.column(1).to_pylist()
                s, p, counts = scorer.documents(texts)
                columns, names = [part.column(0), pa.array(s)], ["doc_id", "score"]
                if spans:
                    ends = np.cumsum(counts)
                    columns.append(pa.array([found(t, p[e - n : e]) for t, e, n in zip(texts, ends, counts, strict=True)], kind_of_spans))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind_of_spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, score double" + (", spans array<struct<start:int,end:int,marginal:double>>" if spans else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def predict(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted, and spans: start, end (code points of the text) and
    marginal of every toxic word. Labels of the held-out fold are never read."""
    fold = held_out(F.col("doc_id"), 4, 2)
    model = fit(docs.where(~fold), labels.where(~fold), fit_docs)
    scored = score(docs, model, spans=True)
    return scored.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
