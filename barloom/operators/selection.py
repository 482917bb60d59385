"""Feature selection and two-stage models from sufficient statistics.

One pass gathers, per fold, the sums of products of the target, the features and their "is known" marks. Everything else is
arithmetic on these matrices, whose size is that of the feature list: the mean of earlier folds replaces missing values and
standardises (a linear map of the sums), a ridge regression is a solve, and the squared error on a later fold is a
quadratic form. So ablation, backward and forward steps cost no further pass over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col
RIDGE = 1.0
TOLERANCE = 1e-9


def fold_moments(df: DataFrame, features: Sequence[str], target: str, fold: str = "fold") -> DataFrame:
    """fold, i, j, s: sums of products of the columns 1, target, features (missing as 0), known marks; i <= j."""
    features = list(features)
    width = 2 + 2 * len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[2:]]).astype(float)
            known = np.isfinite(x)
            y = b.column(1).to_numpy(zero_copy_only=False).astype(float)
            z = np.column_stack([np.ones(len(x)), y, np.where(known, x, 0.0), known.astype(float)])
            folds = b.column(0).to_numpy(zero_copy_only=False)
            for k in np.unique(folds):
                part = z[folds == k]
                total[int(k)] = total.get(int(k), 0) + part.T @ part
        i, j = np.triu_indices(width)
        for k, g in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), k, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(g[i, j])],
                names=["fold", "i", "j", "s"])

    rows = df.where(C(fold).isNotNull() & C(target).isNotNull()).select(
        C(fold).cast("int").alias("fold"), C(target).cast("double").alias("y"), *[C(f).cast("double").alias(f) for f in features])
    parts = rows.mapInArrow(run, "fold int, i int, j int, s double")
    return parts.groupBy("fold", "i", "j").agg(F.sum("s").alias("s"))


def moment_report(moments: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per fold and feature: known rows, mean, standard deviation and, for complete ones, correlation with the target."""
    d = len(features)
    at = lambda i, j: F.max(F.when((C("i") == i) & (C("j") == j), C("s")))
    cells = {"n": at(0, 0), "y": at(0, 1), "yy": at(1, 1)}
    for k in range(d):
        cells |= {f"x{k}": at(0, 2 + k), f"xx{k}": at(2 + k, 2 + k), f"xy{k}": at(1, 2 + k), f"m{k}": at(0, 2 + d + k)}
    wide = moments.groupBy("fold").agg(*[e.alias(c) for c, e in cells.items()])
    one = lambda k, f: F.struct(F.lit(f).alias("feature"), *[C(f"{c}{k}").alias(c) for c in ("x", "xx", "xy", "m")])
    long = wide.select("fold", "n", "y", "yy", F.explode(F.array(*[one(k, f) for k, f in enumerate(features)])).alias("o")).select("*", "o.*")
    cov, vx, vy = C("xy") - C("x") * C("y") / C("n"), C("xx") - C("x") * C("x") / C("m"), C("yy") - C("y") * C("y") / C("n")
    return long.select(
        "fold", "feature", C("m").cast("bigint").alias("observed"), (C("x") / F.nullif(C("m"), F.lit(0.0))).alias("mean"),
        F.when(C("m") > 1, F.sqrt(F.greatest(vx, F.lit(0.0)) / (C("m") - 1))).alias("deviation"),
        F.when((C("m") == C("n")) & (vx > 1e-12 * C("xx")) & (vy > 0), cov / F.sqrt(vx * vy)).alias("correlation"))


class Folds:
    """Walk-forward ridge regressions: each fold is predicted from the folds before it."""

    def __init__(self, moments: DataFrame, features: Sequence[str], ridge: float = RIDGE):
        self.features, self.ridge = list(features), ridge
        d = len(self.features)
        sums: dict[int, np.ndarray] = {}
        for r in moments.collect():  # folds x pairs of columns
            g = sums.setdefault(r.fold, np.zeros((2 + 2 * d, 2 + 2 * d)))
            g[r.i, r.j] = g[r.j, r.i] = r.s
        self.models = {}
        numbers = sorted(sums)
        for k in numbers[1:]:
            train = sum(sums[f] for f in numbers if f < k)
            self.models[k] = self._prepared(train, sums[k])

    def _prepared(self, train: np.ndarray, valid: np.ndarray) -> dict[str, np.ndarray]:
        d = len(self.features)
        n, known = train[0, 0], train[0, 2 + d :]
        mean = np.where(known > 0, train[0, 2 : 2 + d] / np.maximum(known, 1), 0.0)
        # columns: y less its mean, then the features with missing ones at the mean, less the mean
        to = np.zeros((2 + 2 * d, 1 + d))
        to[0, 0], to[1, 0] = -train[0, 1] / n, 1.0
        at = np.arange(d)
        to[2 + at, 1 + at], to[2 + d + at, 1 + at] = 1.0, -mean
        g, h = to.T @ train @ to / n, to.T @ valid @ to
        spread = np.sqrt(np.maximum(np.diag(g)[1:], 0.0))
        scale = 1.0 / np.where(spread > 1e-9 * (np.abs(mean) + 1e-300), spread, np.inf)
        whole = np.r_[1.0, scale]
        g, h = g * np.outer(whole, whole), h * np.outer(whole, whole)
        return {"r": g[1:, 1:], "ry": g[1:, 0], "v": h[1:, 1:], "vy": h[1:, 0], "vv": h[0, 0], "mean": mean, "scale": scale, "y": train[0, 1] / n}

    def coefficients(self, fold: int, chosen: Sequence[str]) -> np.ndarray:
        m, at = self.models[fold], [self.features.index(f) for f in chosen]
        return np.linalg.solve(m["r"][np.ix_(at, at)] + self.ridge * np.eye(len(at)), m["ry"][at]) if at else np.zeros(0)

    def skill(self, chosen: Sequence[str]) -> float:
        """Mean over folds of 1 - squared error / that of the training mean."""
        out = []
        at = [self.features.index(f) for f in chosen]
        for k, m in self.models.items():
            b = self.coefficients(k, chosen)
            error = m["vv"] - 2 * b @ m["vy"][at] + b @ m["v"][np.ix_(at, at)] @ b
            out.append(1 - error / m["vv"] if m["vv"] > 0 else 0.0)
        return float(np.mean(out)) if out else 0.0

    def score(self, df: DataFrame, chosen: Sequence[str], out: str, fold: str = "fold") -> DataFrame:
        """Out-of-fold predictions of the rows whose fold has a model; other rows get null."""
        value = F.lit(None).cast("double")
        xs = F.array(*[C(f).cast("double") for f in chosen]) if chosen else F.array().cast("array<double>")
        for k, m in self.models.items():
            at = [self.features.index(f) for f in chosen]
            weight = (self.coefficients(k, chosen) * m["scale"][at]).tolist()
            terms = F.zip_with(
                F.zip_with(xs, F.lit([float(v) for v in m["mean"][at]]), lambda x, c: F.when(F.isnan(x), 0.0).otherwise(F.coalesce(x - c, F.lit(0.0)))),
                F.lit(weight), lambda x, w: x * w) if chosen else F.array().cast("array<double>")
            value = F.when(C(fold) == k, F.aggregate(terms, F.lit(float(m["y"])), lambda a, x: a + x)).otherwise(value)
        return df.withColumn(out, value)


def select_features(
    folds: Folds, groups: Mapping[str, Sequence[str]], protected: Sequence[str] = (), least: int = 5, loss: float = 0.0005
) -> tuple[list[dict], list[str]]:
    """Steps of group ablation, backward elimination and forward additions, and the chosen features.

    A group goes if the skill without it is at most ``loss`` below that of all features, and ``least`` features stay. Then the
    feature whose removal raises the skill most goes, while any does (never a protected one); then the one whose addition
    raises it most comes back. Ties go to the name that sorts first.
    """
    steps: list[dict] = []

    def note(stage: str, name: str, chosen: Sequence[str], skill: float, before: float, accepted: bool) -> None:
        steps.append({"stage": stage, "step": len(steps), "feature": name, "features": len(chosen), "skill": skill, "delta": skill - before, "accepted": accepted})

    chosen = sorted(folds.features)
    base = now = folds.skill(chosen)
    note("all", "", chosen, base, base, True)
    for name in sorted(groups):
        rest = [f for f in sorted(folds.features) if f not in set(groups[name])]
        skill = folds.skill(rest)
        left = [f for f in chosen if f not in set(groups[name])]
        ok = skill >= base - loss and len(left) >= least and not set(protected) & set(groups[name])
        note("group", name, rest, skill, base, ok)
        chosen = left if ok else chosen
    now = folds.skill(chosen)
    note("core", "", chosen, now, base, True)
    while len(chosen) > least:
        tried = [(folds.skill([g for g in chosen if g != f]), f) for f in chosen if f not in protected]
        if not tried:
            break
        best, name = max(tried, key=lambda t: (t[0], [-ord(c) for c in t[1]]))
        ok = best > now + TOLERANCE
        note("backward", name, chosen[:-1], best, now, ok)
        if not ok:
            break
        chosen, now = [f for f in chosen if f != name], best
    while len(chosen) < len(folds.features):
        tried = [(folds.skill([*chosen, f]), f) for f in sorted(folds.features) if f not in chosen]
        best, name = max(tried, key=lambda t: (t[0], [-ord(c) for c in t[1]]))
        ok = best > now + TOLERANCE
        note("forward", name, [*chosen, name], best, now, ok)
        if not ok:
            break
        chosen, now = [*chosen, name], best
    return steps, chosen
