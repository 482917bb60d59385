"""Whitening of embeddings from the exact characteristic polynomial of their integer scatter.

Entries are taken as integers x = floor(256 c). With n distinct vectors and sums S, M = n * sum(x x') - S S' is an integer
matrix, n^2 times the covariance. Its characteristic polynomial is found exactly: modulo 31-bit primes by reduction to
Hessenberg form, a Spark task for a share of the primes, and by Chinese remaindering up to a proven bound of the
coefficients. All roots are real, so Descartes' rule counts the roots above any number exactly; bisection on integers
isolates the greatest roots with their multiplicities and carries them to ``BITS`` binary places. A component spans the
null space of M - root, found by inverse iteration in decimal arithmetic; a root of multiplicity m gives m orthonormal ones.

Rows go through Spark: distinct vectors by a map-side combined aggregate, the scatter as exact partial sums per task (one
number per pair of dimensions, in limbs), the whitened rows and their own covariance. The driver sees matrices whose size
is that of the dimension, never rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from decimal import Decimal, localcontext
from math import comb, gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import stored

SCALE, COMPONENTS = 256, 4
#: Binary places of a root beyond the integers, and steps of inverse iteration.
BITS, STEPS = 256, 4
#: Exact sums travel in limbs of so many bits; sums of up to 2^(62 - LIMB) partial rows fit a long.
LIMB = 40
LIMBS = 4


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and integer entries ``x`` of the rows whose vector has only finite entries; see ``whiten``."""
    c = F.col("embedding").cast("array<double>")
    whole = F.col("embedding").isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = embeddings.where(F.coalesce(whole, F.lit(False)) & (F.size("embedding") > 0))
    rows = rows.select("vec_id", F.transform(c, lambda v: F.floor(v * SCALE) + F.lit(0).cast("long")).alias("x"))
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).select("d").first()
    return rows.where(F.size("x") == (usual.d if usual else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _exact_gram(x: np.ndarray) -> np.ndarray:
    """x' x as Python integers. Floats where every sum is below 2^53, so exact; whole numbers otherwise."""
    top = max((abs(int(v)) for v in (x.max(), x.min())), default=0)
    if top * top * len(x) < 1 << 53:
        f = x.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    whole = x.astype(object)
    return whole.T @ whole


def _limbs(value: int) -> list[int]:
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def moments(fit: DataFrame) -> np.ndarray | None:
    """Exact sums of products of (1, x) over the rows of ``fit`` (x); None where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                part = _exact_gram(np.column_stack([np.ones(len(x), np.int64), x]))
                total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(total))
            limbs = zip(*(_limbs(int(v)) for v in total[i, j]), strict=True)
            arrays = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *(pa.array(x, pa.int64()) for x in limbs)]
            yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", *(f"limb{k}" for k in range(LIMBS))])

    names = [f"limb{k}" for k in range(LIMBS)]
    parts = fit.select("x").mapInArrow(run, "i int, j int, " + ", ".join(f"{c} long" for c in names))
    rows = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in names)).collect()  # as many as pairs of dimensions
    if not rows:
        return None
    d = max(r.j for r in rows) + 1
    out = np.zeros((d, d), object)
    for r in rows:
        out[r.i, r.j] = out[r.j, r.i] = sum(r[c] << (LIMB * k) for k, c in enumerate(names))
    return out


def primes(bits: int) -> list[int]:
    """Primes below 2^31, from above, whose product has more than ``bits`` bits."""

    def prime(n: int) -> bool:
        odd, twos = n - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for a in (2, 3, 5, 7):  # decides every n below 3,215,031,751
            y = pow(a, odd, n)
            if y not in (1, n - 1) and all((y := y * y % n) != n - 1 for _ in range(twos - 1)):
                return False
        return True

    out, n, held = [], (1 << 31) - 1, 0
    while held <= bits:
        if prime(n):
            out.append(n)
            held += 30
        n -= 2
    return out


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo ``p``, constant first, by reduction to Hessenberg form."""
    h = (matrix % p).astype(np.int64)
    d = len(h)
    for m in range(1, d - 1):
        filled = np.flatnonzero(h[m:, m - 1])
        if not len(filled):
            continue
        i = m + filled[0]
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(axis=1)) % p
    c = np.zeros((d + 1, d + 1), np.int64)
    c[0, 0] = 1
    for k in range(1, d + 1):
        c[k, 1:] = c[k - 1, :-1]
        t, below = [int(h[k - 1, k - 1])], 1
        for i in range(1, k):
            below = below * int(h[k - i, k - i - 1]) % p
            t.append(int(h[k - 1 - i, k - 1]) * below % p)
        c[k] = (c[k] - (np.array(t, np.int64)[:, None] * c[k - 1 :: -1][:k] % p).sum(axis=0)) % p
    return c[d]


def polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Integer coefficients of det(x - matrix), constant first, for a positive semidefinite integer matrix.

    The k-th elementary symmetric function of its roots is at most C(d, k) (trace / d)^k, which bounds the coefficients.
    """
    d, trace = len(matrix), int(np.trace(matrix))
    bound = max(comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))
    basis = primes(bound.bit_length() + 2)
    text = [[str(v) for v in row] for row in matrix]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = np.array([[int(v) for v in row] for row in text], object)
        for b in batches:
            yield pd.DataFrame({"p": b["p"], "c": [polynomial_mod(whole, int(p)).tolist() for p in b["p"]]})

    share = spark.createDataFrame([(p,) for p in basis], "p long").repartition(min(len(basis), spark.sparkContext.defaultParallelism))
    residues = {r.p: r.c for r in share.mapInPandas(run, "p long, c array<long>").collect()}  # primes x dimensions
    product = 1
    for p in basis:
        product *= p
    out = [0] * (d + 1)
    for p in basis:
        rest = product // p
        unit = rest * pow(rest, -1, p)
        out = [a + unit * r for a, r in zip(out, residues[p], strict=True)]
    out = [a % product for a in out]
    return [a - product if 2 * a > product else a for a in out]


def _above(coefficients: list[int], bound: int) -> int:
    """How many roots of a polynomial with only real roots exceed ``bound``: sign changes after a shift by it."""
    c = list(coefficients)
    for k in range(len(c) - 1):
        for i in range(len(c) - 2, k - 1, -1):
            c[i] += bound * c[i + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def greatest_roots(coefficients: list[int], count: int) -> list[tuple[int, int]]:
    """The greatest positive roots, falling, until ``count`` are reached: (root * 2^BITS rounded up, multiplicity).

    The polynomial has integer coefficients, the leading one 1, and only real roots. Intervals are halved on counts of the
    roots above a point; an interval with one simple root goes on by the polynomial's sign. Roots that share an interval of
    2^-BITS are one root.
    """
    d = len(coefficients) - 1
    scaled = [c << (BITS * (d - k)) for k, c in enumerate(coefficients)]  # its roots are 2^BITS times those asked for

    def value(at: int) -> int:
        y = 0
        for c in reversed(scaled):
            y = y * at + c
        return y

    top = (-coefficients[-2] + 1) << BITS  # all roots are at least zero, so none exceeds their sum
    out: list[tuple[int, int]] = []
    done = 0
    while done < count:
        # roots in (low, high]: all but the ``done`` found ones, as far as positive
        low, high, inside = 0, out[-1][0] - 1 if out else top, _above(scaled, 0) - done
        if inside <= 0:
            break
        first = high
        while high - low > 1 and not (inside == 1 and high < first):
            middle = (low + high) // 2
            over = _above(scaled, middle) - done
            low, high, inside = (middle, high, over) if over else (low, middle, inside)
        if inside == 1 and value(high):
            sign = value(high) > 0
            while high - low > 1:
                middle = (low + high) // 2
                v = value(middle)
                if v == 0:
                    low, high = middle - 1, middle
                elif (v > 0) == sign:
                    high = middle
                else:
                    low = middle
        out.append((high, inside))
        done += inside
    return out


def null_space(matrix: np.ndarray, root: int, multiplicity: int) -> list[list[float]]:
    """Orthonormal vectors of the null space of ``matrix`` - root / 2^BITS, by inverse iteration in decimal arithmetic."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = BITS // 3 + 2 * len(str(int(np.trace(matrix)))) + 40
        tiny = Decimal(1).scaleb(-BITS)
        a = np.array([[Decimal(int(v)) for v in row] for row in matrix], object)
        a[np.arange(d), np.arange(d)] -= Decimal(root) / Decimal(1 << BITS)
        order = np.arange(d)
        for k in range(d):
            pivot = k + int(np.argmax(np.abs(a[k:, k])))
            a[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], order[[pivot, k]]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            a[k + 1 :, k] /= a[k, k]
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])

        def solve(b: np.ndarray) -> np.ndarray:
            y = b[order].copy()
            for k in range(1, d):
                y[k] -= a[k, :k] @ y[:k]
            for k in range(d - 1, -1, -1):
                y[k] = (y[k] - (a[k, k + 1 :] @ y[k + 1 :] if k + 1 < d else 0)) / a[k, k]
            return y

        seeds = np.random.default_rng(7).integers(1, 1000, (multiplicity, d))
        basis = [np.array([Decimal(int(v)) for v in row], object) for row in seeds]
        for _ in range(STEPS):
            solved: list[np.ndarray] = []
            for v in basis:
                w = solve(v)
                for _ in range(2):
                    for u in solved:
                        w = w - (u @ w) * u
                    w = w / (w @ w).sqrt()
                solved.append(w)
            basis = solved
        return [[float(x) for x in v] for v in basis]


def components(spark: SparkSession, matrix: np.ndarray, count: int) -> list[tuple[Decimal, list[float]]]:
    """Greatest positive eigenvalues of an integer scatter, falling, with unit eigenvectors: at most ``count``."""
    share = functools.reduce(gcd, (int(v) for v in matrix.ravel()), 0)
    if not share:
        return []
    small = matrix // share
    roots = greatest_roots(polynomial(spark, small), count)
    text = [[str(v) for v in row] for row in small]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = np.array([[int(v) for v in row] for row in text], object)
        for b in batches:
            found = [null_space(whole, int(r), int(m)) for r, m in zip(b["root"], b["m"], strict=True)]
            yield pd.DataFrame({"k": b["k"], "v": found})

    tasks = spark.createDataFrame([(k, str(r), m) for k, (r, m) in enumerate(roots)], "k int, root string, m int").repartition(len(roots))
    spaces = {r.k: r.v for r in tasks.mapInPandas(run, "k int, v array<array<double>>").collect()}  # as many as components
    out = []
    with localcontext() as context:
        context.prec = 200
        for k, (root, _) in enumerate(roots):
            out += [(Decimal(root) * share / Decimal(1 << BITS), list(v)) for v in spaces[k]]
    return out[:count]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 per row, exact; None where it exceeds a long."""
    top = max((abs(int(v)) for v in (x.max(), x.min())), default=0)
    if (n * top + max(map(abs, sums))) ** 2 * len(sums) < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    rows = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in rows]


def _whitened(x: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return (x - mean) @ axes


def _covariance_error(fit: DataFrame, n: int, mean: np.ndarray, axes: np.ndarray) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = _whitened(_matrix(b.column(0)), mean, axes)
                y = np.column_stack([np.ones(len(y)), y])
                i, j = np.indices((y.shape[1],) * 2).reshape(2, -1)
                arrays = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array((y.T @ y).ravel())]
                yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", "s"])

    rows = fit.select("x").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    g = np.zeros((axes.shape[1] + 1,) * 2)
    for r in rows:
        g[r.i, r.j] = r.s / n
    centred = g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:])
    return float(np.abs(centred - np.eye(len(centred))).max())


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """A row per vector and component of ``embeddings`` (vec_id, embedding): vec_id, component, n, deviation, whitened,
    explained, identity_error.

    Rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are vectors of another length
    than the most frequent one (of equals the longest), which belong to no common space. A vector that comes again counts
    once in the fit and gives a row each time. Components with eigenvalue zero have no whitened form and no rows: a table
    of one distinct vector gives none, nor does an empty table. Equal eigenvalues give orthonormal components of their
    space. ``deviation`` is null where it exceeds a long. Other columns are not read.
    """
    spark = embeddings.sparkSession
    rows = vectors(embeddings)
    kind = f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, {SCHEMA}"
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    sums = moments(fit)
    if sums is None:
        return spark.createDataFrame([], kind)
    n, total = int(sums[0, 0]), sums[0, 1:]
    scatter = n * sums[1:, 1:] - np.outer(total, total)
    found = components(spark, scatter, count)
    if not found:
        return spark.createDataFrame([], kind)
    trace = int(np.trace(scatter))
    mean = np.array([float(Decimal(int(s)) / n) for s in total])
    axes = np.column_stack([np.array(v) * (n / float(e.sqrt())) for e, v in found])
    explained = [float(e / trace) for e, _ in found]
    error = _covariance_error(fit, n, mean, axes)
    whole = [int(s) for s in total]
    k = len(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            each = np.repeat(np.arange(len(x)), k)
            constant = lambda v: pa.array(np.full(len(each), v))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    constant(np.int64(n)),
                    pa.array(_deviations(x, n, whole), pa.int64()).take(pa.array(each)),
                    pa.array(_whitened(x, mean, axes).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    constant(error),
                ],
                names=[f.strip().split(" ")[0] for f in kind.split(",")],
            )

    return rows.select("vec_id", "x").mapInArrow(run, kind)
