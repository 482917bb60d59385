"""Token counts, periodic runs and whitening against their libraries, brute force and numpy."""

import random
import zlib

import numpy as np
import pytest

from barloom.llm import periodic_runs, token_counts, whitening

from .helpers import documents, sha

# --- token counts

HARD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "don't we'll 'tis 's", "x<|endoftext|>y", "x <|endoftext|> y  <|endoftext|>", "<|endoftext|",
    "a b c　d", "a  b", "é ü", "½ ²  3", "日本語 テキスト", "emoji 🙂 🙂", "tab\tx y", "\x1c a", "a \x1c", "_ _", "٣ ٤", "a.b , c ; !", "​ a ​b", "a" * 5000,
    "Mixed CASE Text", "line one\nline two\r\n\r\nline three ", "  lead", "ab " * 3000,
]


def _expected(name, texts):
    import public_tokenizers

    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    import tokenizers

    t = tokenizers.Tokenizer.from_file(path)
    return [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, name):
    rng = random.Random(3)
    bits = ["a", "The", " ", "  ", "\n", "'s", "<|endoftext|>", "9", "é", "日", ".", "-", "\t", " ", "word", "’", "_", "²"]
    texts = HARD + ["".join(rng.choices(bits, k=rng.randrange(1, 40))) for _ in range(400)]
    docs = documents(spark, [(k, t, None) for k, t in enumerate(texts)])
    want = _expected(name, [t or "" for t in texts])
    got = {r.doc_id: r for r in token_counts.token_counts(docs, name=name).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        data = (t or "").encode()
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len(data), want[k], want[k] > 512), repr(t)
        assert got[k].content_sha256 == sha(data)


def test_cache_encodes_only_distinct_misses(spark, tmp_path):
    cache = str(tmp_path / "cache")
    first = documents(spark, [(1, "one text", "en"), (1, "one text", "en"), (2, "one text", None), (None, None, None), (3, "", "x")])
    assert token_counts.fill(first, cache) == 2
    assert token_counts.fill(first, cache) == 0
    more = first.union(documents(spark, [(4, "another text", "en"), (5, "another text", "en")]))
    rows = token_counts.token_counts(more, cache)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows.collect()) == [(0, 0), (1, 2), (1, 2), (2, 2), (3, 0), (4, 2), (5, 2)]
    stored = token_counts.cached(spark, cache, token_counts.version_digest(token_counts.TOKENIZER))
    assert stored.count() == 3
    # a count that stands in the cache is taken, not made again
    fake = stored.selectExpr("digest", "n_tokens + 700 AS n_tokens")
    other = str(tmp_path / "other")
    fake.write.parquet(f"{other}/{token_counts.version_digest(token_counts.TOKENIZER)}")
    assert {(r.n_tokens, r.over_limit) for r in token_counts.token_counts(more, other).collect()} == {(700, True), (702, True)}
    # another tokenizer has counts of its own
    assert token_counts.fill(more, other, "word_bpe_49k.json") == 3


def test_counts_of_an_empty_table_and_other_errors(spark, tmp_path):
    empty = token_counts.token_counts(documents(spark, []))
    assert empty.count() == 0
    assert empty.columns[:4] == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    with pytest.raises(FileNotFoundError):
        token_counts.version_digest(str(tmp_path / "none.json"))


# --- periodic runs


def _brute(words, least=24, times=3):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            smaller = any(all(words[k] == words[k + d] for k in range(start, start + length - d)) for d in range(1, q))
            if length >= max(least, times * q) and not smaller:
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def _loops(rng, most):
    words = []
    while len(words) < most:
        unit = rng.choices("abcdefgh"[: rng.randrange(1, 9)], k=rng.randrange(1, 14))
        words += (unit * rng.randrange(1, 12))[: rng.randrange(1, 60)]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(11)
    for _ in range(400):
        words = _loops(rng, rng.randrange(1, 160))
        assert periodic_runs.runs_of([w.encode() for w in words]) == _brute(words)
        squares = periodic_runs.runs_in([ord(w) for w in words], 2, 2)
        assert sorted(squares, key=lambda r: (r[0], r[2])) == _brute(words, 2, 2)


def test_runs_of_extreme_words():
    assert periodic_runs.runs_of([]) == []
    assert periodic_runs.runs_of([b"a"] * 23) == []
    assert periodic_runs.runs_of([b"a"] * 24) == [(0, 24, 1)]
    assert periodic_runs.runs_of([b"a"] * 30_000) == [(0, 30_000, 1)]
    fib = [b"a", b"ab"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    words = [bytes([c]) for c in fib[-1]]
    assert periodic_runs.runs_of(words) == _brute(words)
    long = [b"%d" % (k % 1000) for k in range(3000)]
    assert periodic_runs.runs_of(long) == [(0, 3000, 1000)]
    assert periodic_runs.runs_of(long[:-1]) == []


def test_run_query_equals_brute_force(spark):
    rng = random.Random(2)
    spaces = [" ", "\n", "\t ", "  ", "\x0b", "\x0c\r"]
    rows = [(k, "".join(w + rng.choice(spaces) for w in _loops(rng, rng.randrange(1, 200))), None) for k in range(300)]
    rows += [(900, None, None), (901, "", None), (902, " \n", None), (None, "a " * 40, None), (903, "é b " * 40, "x"), (903, "é b " * 40, "x")]
    got = periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.looped(documents(spark, rows)))).collect()
    changed = 0
    want = []
    for k, text, _ in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(str(k).encode())
        n, g = len(words), h // 10
        if k is not None and h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        runs = _brute(words)
        drop = {i for s, size, q in runs for i in range(s + q, s + size)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        text = "".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()
        kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
        want.append((k, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha(text), sha(kept)))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert changed > 15
    assert sum(r[1] > 0 for r in want) > 30
    assert periodic_runs.periodic_runs(documents(spark, [])).count() == 0


# --- whitening


def _vectors(spark, rows):
    full = [(i, v, 1, "x", 5, "y") for i, v in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<float>, label int, x string, n long, component string")


@pytest.mark.parametrize("d", [1, 2, 5, 9])
def test_polynomial_and_roots_equal_numpy(spark, d):
    rng = np.random.default_rng(d)
    a = rng.integers(-30, 30, (d + 2, d)).astype(object)
    m = a.T @ a
    c = whitening.polynomial(spark, m)
    assert np.allclose([float(v) for v in c[::-1]], np.poly(m.astype(float)), rtol=1e-9)
    for x in (-3, 0, 17):  # exact at integer points, by fractions
        assert sum(v * x**k for k, v in enumerate(c)) == _determinant(x * np.eye(d, dtype=int).astype(object) - m)
    roots = whitening.greatest_roots(c, d)
    assert np.allclose([r / 2**whitening.BITS for r, _ in roots], np.linalg.eigvalsh(m.astype(float))[::-1], rtol=1e-9)


def _determinant(m):
    from fractions import Fraction

    m, out = [[Fraction(int(v)) for v in row] for row in m], Fraction(1)
    for k in range(len(m)):
        p = next((i for i in range(k, len(m)) if m[i][k]), None)
        if p is None:
            return 0
        if p != k:
            m[k], m[p], out = m[p], m[k], -out
        out *= m[k][k]
        for i in range(k + 1, len(m)):
            f = m[i][k] / m[k][k]
            m[i] = [x - f * y for x, y in zip(m[i], m[k], strict=True)]
    return out


def test_equal_and_zero_eigenvalues(spark):
    m = np.diag(np.array([5, 5, 2, 0, 7], object))
    found = whitening.components(spark, m, 5)
    assert [float(e) for e, _ in found] == [7, 5, 5, 2]
    v = np.array([v for _, v in found])
    assert np.allclose(v @ v.T, np.eye(4), atol=1e-15)
    assert np.allclose(m.astype(float) @ v.T, v.T * [7, 5, 5, 2], atol=1e-14)


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(4)
    base = (rng.normal(size=(300, 6)) * [1, 0.5, 0.5, 0.3, 0.2, 0.1]) @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    rows = [(k, [float(np.float32(v)) for v in r]) for k, r in enumerate(base)]
    rows += [(500, rows[0][1]), (500, rows[0][1]), (None, rows[1][1]), (501, [0.0] * 6), (502, [-0.0] * 6)] + [(600 + k, rows[2][1]) for k in range(150)]
    bad = [(700, None), (701, [1.0, None] + [0.0] * 4), (702, [float("nan")] + [0.0] * 5), (703, [float("inf")] * 6), (704, []), (705, [1.0] * 5)]
    out = whitening.whiten(_vectors(spark, rows + bad)).collect()
    assert len(out) == 4 * len(rows)
    x = np.floor(256 * np.array([v for _, v in rows])).astype(int)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    e, q = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    e, q = e[::-1], q[:, ::-1]
    want = (x - s / n) @ q[:, :4] / np.sqrt(e[:4])
    by_id = {}
    for (i, _), y, dev in zip(rows, want, ((n * x - s) ** 2).sum(axis=1), strict=True):
        by_id[i] = (y, int(dev))
    sign = [np.sign(next(r.whitened * by_id[0][0][c - 1] for r in out if r.vec_id == 0 and r.component == c)) for c in (1, 2, 3, 4)]
    for r in out:
        y, dev = by_id[r.vec_id]
        assert (r.n, r.deviation) == (n, dev)
        assert r.whitened * sign[r.component - 1] == pytest.approx(y[r.component - 1], abs=1e-9)
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9)
        assert r.identity_error < 1e-9


def test_whitening_of_small_and_large_values(spark):
    assert whitening.whiten(_vectors(spark, [])).count() == 0
    assert whitening.whiten(_vectors(spark, [(1, None)])).count() == 0
    assert whitening.whiten(_vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no variance, no component
    two = whitening.whiten(_vectors(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0])])).collect()
    assert [(r.component, r.n, r.deviation, round(abs(r.whitened), 12), r.explained) for r in two] == [(1, 2, 65536, 1.0, 1.0)] * 2
    big = whitening.whiten(_vectors(spark, [(k, [1e12 * k, 1.0, -1e13 * k * k]) for k in range(5)])).collect()
    assert {r.vec_id for r in big if r.deviation is None} != set()
    assert len(big) == 10
    assert all(r.identity_error < 1e-6 for r in big)


def test_exact_sums_of_large_entries():
    x = np.array([[2**62, -5], [-(2**62), 3], [7, 2**40]], np.int64)
    assert whitening._exact_gram(x)[0, 0] == 2**125 + 49
    for v in (0, -1, 2**125 + 49, -(2**125)):
        limbs = whitening._limbs(v)
        assert sum(p << (whitening.LIMB * k) for k, p in enumerate(limbs)) == v
        assert all(abs(p) < 1 << 62 for p in limbs)
