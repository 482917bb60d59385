"""Log of evaluated parameter sets: canonical JSON, its hash, an append-only table without repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col
SCHEMA = "trial_hash string, experiment string, payload string"


def canonical_json(parts: Sequence[Column]) -> Column:
    """JSON of named parts in the given order; nulls stay, so equal parameter sets have equal texts."""
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def with_trial_hash(trials: DataFrame) -> DataFrame:
    """trial_hash, experiment, payload of ``trials`` (experiment and one column per parameter, put in order of name)."""
    config = F.struct(*sorted(c for c in trials.columns if c != "experiment"))
    payload = canonical_json([config.alias("config"), C("experiment")])
    return trials.select(F.sha2(payload, 256).alias("trial_hash"), "experiment", payload.alias("payload"))


def trial_log(spark: SparkSession, path: str) -> DataFrame:
    """The logged trials, one row per hash; empty where nothing was logged."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)
    return rows.groupBy("trial_hash").agg(F.min("experiment").alias("experiment"), F.min("payload").alias("payload"))


def log_trials(trials: DataFrame, path: str) -> None:
    """Append the trials that the log lacks.

    Repeats within a batch and trials logged before add no row, so a replayed write changes nothing. Two writers at once may
    append one hash twice; readers take it once. The hash is the key of join and aggregate, so rows spread evenly.
    """
    new = with_trial_hash(trials).groupBy("trial_hash").agg(F.min("experiment").alias("experiment"), F.min("payload").alias("payload"))
    old = trial_log(trials.sparkSession, path).select("trial_hash")
    new.join(old, "trial_hash", "left_anti").select("trial_hash", "experiment", "payload").write.mode("append").parquet(path)


def count_trials(log: DataFrame) -> DataFrame:
    """One row: parameter sets tried, one at least (the number a deflated statistic is charged with)."""
    return log.agg(F.greatest(F.count_distinct("trial_hash"), F.lit(1)).alias("trials"))
