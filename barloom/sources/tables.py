"""Reading the input tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder. The schema comes from the Parquet footer, never inferred."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if "://" not in path and not os.path.exists(path):
        path = f"{sf_dir.rstrip('/')}/{name}"
    return spark.read.parquet(path)
