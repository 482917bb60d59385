"""Model training, calibration, ensembles and permutation importance with pyspark.ml."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.frames import with_row
from barloom.operators.evaluation import ranking_quality
from barloom.operators.order_stats import with_row_number

C = F.col


def models() -> dict[str, object]:
    """Model families compared side by side, with fixed seeds."""
    kw = {"featuresCol": "x", "labelCol": "y"}
    return {
        "logistic": LogisticRegression(maxIter=30, regParam=0.01, **kw),
        "forest": RandomForestClassifier(numTrees=20, maxDepth=5, seed=42, **kw),
        "boosted": GBTClassifier(maxIter=8, maxDepth=3, seed=42, **kw),
    }


def fit(train: DataFrame, features: Sequence[str], estimator) -> PipelineModel:
    """Missing features take the training median, so no row is left out of training or scoring."""
    filled = [f"_filled_{f}" for f in features]
    impute = Imputer(inputCols=list(features), outputCols=filled, strategy="median")
    return Pipeline(stages=[impute, VectorAssembler(inputCols=filled, outputCol="x"), estimator]).fit(train)


def score(model: PipelineModel, df: DataFrame, out: str = "p") -> DataFrame:
    p = vector_to_array(C("probability"))[1]
    done = model.transform(df).withColumn(out, p)
    return done.drop("x", "rawPrediction", "probability", "prediction", *[c for c in done.columns if c.startswith("_filled_")])


def time_split(df: DataFrame, train_end: Column, valid_end: Column) -> DataFrame:
    return df.withColumn(
        "split", F.when(C("date") < train_end, "train").when(C("date") < valid_end, "validation").otherwise("final_test"))


def compare_models(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """PR-AUC and ROC-AUC of every model family on validation and test rows."""
    train = df.where(C("split") == "train")
    rest = df.where(C("split") != "train")
    out = None
    for name, est in models().items():
        q = ranking_quality(score(fit(train, features, est), rest), "p", ["split"]).withColumn("model", F.lit(name))
        out = q if out is None else out.unionByName(q)
    return out


def calibrate(scored: DataFrame, fraction: float = 0.2) -> tuple[object, object]:
    """Platt and isotonic maps fitted on the latest share of dates (one row per date decides)."""
    dates = scored.groupBy("date").agg(F.count(F.lit(1)).alias("_n"))
    cut = dates.agg(F.percentile(F.unix_date("date"), 1 - fraction).alias("c")).first()["c"]
    fit_rows = scored.where(F.unix_date("date") >= F.lit(cut))
    va = VectorAssembler(inputCols=["p"], outputCol="x")
    platt = LogisticRegression(featuresCol="x", labelCol="y").fit(va.transform(fit_rows))
    iso = IsotonicRegression(featuresCol="p", labelCol="y").fit(fit_rows.withColumn("y", C("y").cast("double")))
    return platt, iso


def apply_calibration(scored: DataFrame, platt, iso) -> DataFrame:
    va = VectorAssembler(inputCols=["p"], outputCol="x")
    df = platt.transform(va.transform(scored)).withColumn("p_platt", vector_to_array(C("probability"))[1])
    df = df.drop("x", "rawPrediction", "probability", "prediction")
    return iso.transform(df).withColumnRenamed("prediction", "p_isotonic")


def ensemble(wide: DataFrame, weights: Mapping[str, float], out: str = "p") -> DataFrame:
    """Weighted mean of the model columns present in a row, weights renormalised."""
    total = sum((F.when(C(m).isNotNull(), w).otherwise(0.0) for m, w in weights.items()), F.lit(0.0))
    value = sum((F.coalesce(C(m), F.lit(0.0)) * w for m, w in weights.items()), F.lit(0.0))
    return wide.withColumn(out, value / F.nullif(total, F.lit(0.0)))


def permute(df: DataFrame, feature: str, key: Sequence[str], seed: int) -> DataFrame:
    """``feature`` shuffled over all rows by joining two distributed row numberings."""
    u = (F.xxhash64(F.lit(seed), *key) / F.lit(2.0**63)).cast("double")
    v = (F.xxhash64(F.lit(seed + 1), *key) / F.lit(2.0**63)).cast("double")
    a = with_row_number(df.withColumn("_u", u), [], "_u", list(key)).drop("_u", "group_rows")
    b = with_row_number(df.select(*key, feature).withColumn("_v", v), [], "_v", list(key)).select(
        "position", C(feature).alias("_shuffled"))
    return a.join(b, "position").withColumn(feature, C("_shuffled")).drop("_shuffled", "position")


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Loss of ROC-AUC when one feature is shuffled."""
    base = ranking_quality(score(model, df), "p").select(C("roc_auc").alias("base_auc"))
    out = None
    for i, f in enumerate(features):
        q = ranking_quality(score(model, permute(df, f, key, 100 + i)), "p").select(
            F.lit(f).alias("feature"), "roc_auc")
        out = q if out is None else out.unionByName(q)
    return with_row(out, base).select("feature", "base_auc", "roc_auc", (C("base_auc") - C("roc_auc")).alias("importance"))


def feature_labels(importance: DataFrame) -> DataFrame:
    """KEEP / REVIEW / DROP by quartile of importance (one row per feature)."""
    q = importance.agg(F.percentile("importance", 0.25).alias("_lo"), F.percentile("importance", 0.75).alias("_hi"))
    return with_row(importance, q).withColumn(
        "label", F.when((C("importance") <= 0) | (C("importance") < C("_lo")), "DROP").when(C("importance") >= C("_hi"), "KEEP").otherwise("REVIEW")
    ).drop("_lo", "_hi")


def evaluable_folds(df: DataFrame) -> list[int]:
    """The folds of ``df`` (yearly numbers) that have earlier rows to train on."""
    return sorted(r["fold"] for r in df.select("fold").where("fold is not null").distinct().collect())[1:]


def walk_forward_grid(df: DataFrame, features: Sequence[str], folds: Sequence[int], grid: Mapping[str, dict]) -> DataFrame:
    """One fit per (parameter set, fold): train on earlier folds, score the fold."""
    out = None
    for name, params in grid.items():
        for k in folds:
            est = RandomForestClassifier(featuresCol="x", labelCol="y", seed=42, **params)
            m = fit(df.where(C("fold") < k - 0), features, est)
            q = ranking_quality(score(m, df.where(C("fold") == k)), "p").select(
                F.lit(name).alias("trial"), F.lit(k).alias("fold"), "rows", "pr_auc", "roc_auc")
            out = q if out is None else out.unionByName(q)
    return out


def champion(metrics: DataFrame, order: Sequence[str]) -> DataFrame:
    """Best row of a metrics table by the listed metrics, highest first."""
    return metrics.orderBy(*[C(m).desc() for m in order]).limit(1)


def redundancy(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Largest absolute Pearson correlation of each feature to any other, one aggregate pass."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    items = F.array(*[
        x for a, b in pairs for x in (
            F.struct(F.lit(a).alias("feature"), F.lit(b).alias("other"), F.abs(C(f"{a}|{b}")).alias("r")),
            F.struct(F.lit(b).alias("feature"), F.lit(a).alias("other"), F.abs(C(f"{a}|{b}")).alias("r")))
    ])
    return row.select(F.explode(items).alias("o")).select("o.*").groupBy("feature").agg(
        F.max("r").alias("max_abs_correlation"), F.max(F.struct("r", "other"))["other"].alias("closest"))
