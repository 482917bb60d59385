"""Attaching one-row tables without a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row table (a global aggregate) as a scalar subquery.

    The row is computed once and inlined, so no cross join or nested loop is planned.
    Spark raises if the table has more than one row.
    """
    cols = one.columns
    packed = one.select(F.struct(*cols).alias("_row")).scalar()
    return df.withColumn("_row", packed).select("*", *[F.col(f"_row.{c}").alias(c) for c in cols]).drop("_row")
