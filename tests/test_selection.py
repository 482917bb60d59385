"""Feature selection against regressions on the rows, and the trial log."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import selection as sl
from barloom.operators import trials as tr

FEATURES = ["a", "b", "c", "d", "e", "flat"]


def _table(spark, seed=1, n=900):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5)) * [1, 3, 0.5, 100, 2] + [0, 5, 0, 1000, 0]
    x[:, 4] = x[:, 0] + 0.1 * rng.normal(size=n)
    y = (x[:, 0] + x[:, 1] / 3 + rng.normal(size=n) > 1.5).astype(float)
    x[rng.random((n, 5)) < 0.05] = np.nan
    fold = np.arange(n) // (n // 4)
    rows = [(int(f), float(t), *[None if np.isnan(v) else float(v) for v in r], 7.0) for f, t, r in zip(fold, y, x, strict=True)]
    extra = [(None, 1.0, *[1.0] * 6), (1, None, *[1.0] * 6)]  # no fold, no target: left out
    df = spark.createDataFrame(rows + extra, "fold int, y double, " + ", ".join(f"{f} double" for f in FEATURES))
    return df, fold, y, np.column_stack([x, np.full(n, 7.0)])


def _brute_skill(fold, y, x, names):
    """Ridge on rows: missing ones at the mean of earlier folds, standardised by them."""
    at, out, scores = [FEATURES.index(f) for f in names], [], np.full(len(y), np.nan)
    for k in sorted(set(fold))[1:]:
        tr_, va = fold < k, fold == k
        z = x[:, at]
        mean = np.nanmean(z[tr_], axis=0) if at else np.zeros(0)
        z = np.where(np.isnan(z), mean, z) - mean
        spread = z[tr_].std(axis=0)
        z = z / np.where(spread > 1e-9, spread, np.inf)
        t = y - y[tr_].mean()
        n = tr_.sum()
        b = np.linalg.solve(z[tr_].T @ z[tr_] / n + sl.RIDGE * np.eye(len(at)), z[tr_].T @ t[tr_] / n) if at else np.zeros(0)
        scores[va] = z[va] @ b + y[tr_].mean()
        out.append(1 - ((t[va] - z[va] @ b) ** 2).sum() / (t[va] ** 2).sum())
    return float(np.mean(out)), scores


def test_skill_and_scores_equal_regressions_on_rows(spark):
    df, fold, y, x = _table(spark)
    folds = sl.Folds(sl.fold_moments(df, FEATURES, "y"), FEATURES)
    for names in ([], ["a"], ["b", "a"], ["a", "b", "c", "d", "e"], FEATURES):
        want, scores = _brute_skill(fold, y, x, names)
        assert folds.skill(names) == pytest.approx(want, abs=1e-9)
        got = folds.score(df.where("fold IS NOT NULL AND y IS NOT NULL").withColumn("n", F.monotonically_increasing_id()).orderBy("n"), names, "p").toPandas()["p"]
        assert np.allclose(np.sort(got.dropna()), np.sort(scores[~np.isnan(scores)]), atol=1e-9)
        assert got.isna().sum() == (fold == 0).sum()


def test_steps_equal_brute_force(spark):
    df, fold, y, x = _table(spark, 2)
    folds = sl.Folds(sl.fold_moments(df, FEATURES, "y"), FEATURES)
    groups = {"noise": ["c", "d"], "signal": ["a", "e"], "kept": ["b"]}
    steps, chosen = sl.select_features(folds, groups, ["b"], least=1)
    skill = lambda names: _brute_skill(fold, y, x, names)[0]
    left, want = sorted(FEATURES), []
    base = skill(left)
    for g in sorted(groups):
        value = skill([f for f in sorted(FEATURES) if f not in groups[g]])
        ok = value >= base - 0.0005 and "b" not in groups[g] and len(set(left) - set(groups[g])) >= 1
        want.append(("group", g, value, ok))
        left = [f for f in left if f not in groups[g]] if ok else left
    now = skill(left)
    for stage in ("backward", "forward"):
        while True:
            drop = stage == "backward"
            pool = [f for f in left if f != "b"] if drop else [f for f in sorted(FEATURES) if f not in left]
            if not pool or drop and len(left) <= 1:
                break
            value, name = max(((skill([g for g in left if g != f] if drop else [*left, f]), f) for f in pool), key=lambda t: t[0])
            want.append((stage, name, value, value > now + sl.TOLERANCE))
            if not want[-1][-1]:
                break
            left, now = ([f for f in left if f != name] if drop else [*left, name]), value
    got = [(s["stage"], s["feature"], s["skill"], s["accepted"]) for s in steps if s["stage"] in ("group", "backward", "forward")]
    assert [(g[0], g[3]) for g in got] == [(w[0], w[3]) for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-9)
    assert sorted(chosen) == sorted(left)
    assert steps[0]["features"] == 6


def test_moments_of_an_empty_table(spark):
    df, *_ = _table(spark)
    folds = sl.Folds(sl.fold_moments(df.limit(0), FEATURES, "y"), FEATURES)
    assert folds.models == {}
    assert folds.skill(["a"]) == 0.0


def test_trial_log_counts_each_parameter_set_once(spark, tmp_path):
    path = str(tmp_path / "log")
    assert tr.count_trials(tr.trial_log(spark, path)).first().trials == 1
    one = spark.createDataFrame([("s", 8, 0.2, None), ("s", 8, 0.2, None), ("s", 9, 0.2, None)], "experiment string, top_n int, stop double, trail double")
    tr.log_trials(one, path)
    tr.log_trials(one, path)
    tr.log_trials(one.select("trail", "stop", "experiment", "top_n"), path)  # the order of the columns does not matter
    assert spark.read.parquet(path).count() == 2
    tr.log_trials(one.withColumn("experiment", F.lit("other")), path)
    assert tr.count_trials(tr.trial_log(spark, path)).first().trials == 4
    payloads = {r.payload for r in tr.trial_log(spark, path).collect()}
    assert '{"config":{"stop":0.2,"top_n":8,"trail":null},"experiment":"s"}' in payloads
