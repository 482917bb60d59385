"""Materialise an intermediate table that several branches of a plan read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from barloom.session import checkpoint_root


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster, or a folder of the warehouse where none is set."""
    root = checkpoint_root(spark)
    return root.rstrip("/") if root else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stage"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    Branches then scan a narrow columnar file instead of recomputing the windows
    behind it, and lost executors recover from shared storage.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)
