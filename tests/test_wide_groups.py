"""Quality queries over groups that each hold the table: bounded tasks, equal rows."""

import numpy as np

import __spark_entry__ as entry
from barloom.operators import quality as ql
from barloom.operators.order_stats import WIDE_GROUPS, order_bucket, quantiles
from barloom.session import SPREAD_CONF, tune


def test_finer_buckets_give_the_same_quantiles(spark):
    rng = np.random.default_rng(5)
    values = np.r_[rng.uniform(40, 60, 400), rng.normal(0, 1e-3, 200), [0.0, 0.0, -7.0]]
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("g", None), ("h", 1.5)], "g string, v double")
    probs = {"p01": 0.01, "q1": 0.25, "mid": 0.5, "p99": 0.99}
    got = {r.g: [r[n] for n in probs] for r in quantiles(df, ["g"], "v", probs, per_efold=WIDE_GROUPS).collect()}
    assert np.allclose(got["g"], np.quantile(values, list(probs.values())), rtol=1e-12) and got["h"] == [1.5] * 4
    buckets = df.where("g = 'g'").select(order_bucket("v", WIDE_GROUPS).alias("b"), "v").where("v >= 40").groupBy("b").count()
    assert buckets.count() > 200  # a narrow range is not a handful of tasks


def test_feature_rows_meet_their_statistics_without_a_shuffle(spark):
    long = spark.createDataFrame([("f", float(k)) for k in range(20)] + [("f", 1e6), ("e", None)], "feature string, value double")
    got = ql.feature_quality(long)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    rows = {r.feature: (r.rows, r.iqr_outliers) for r in got.collect()}
    assert rows == {"f": (21, 1), "e": (1, 0)}


def test_quality_queries_spread_and_run_their_windows_once(spark):
    try:
        for name in ("feature_quality", "feature_drift", "label_distribution"):
            plan = entry.queries()[name](spark, entry.SMOKE_DIR)._jdf.queryExecution().optimizedPlan().toString()
            assert "l_suppkey" not in plan and "lead(" not in plan
            assert all(spark.conf.get(k) == v for k, v in SPREAD_CONF.items())
    finally:
        tune(spark)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes", None) != SPREAD_CONF["spark.sql.files.maxPartitionBytes"]
