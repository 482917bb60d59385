"""Helpers shared by the corpus operators: shared-folder tables, connected components, table access."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see: ``spark.checkpoint.dir``, or a folder of the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return root.rstrip("/") if root else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/llm-work"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: it survives lost executors and ends the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a batch between the JVM and Python, where whole texts travel (a memory bound of both sides; results do not depend on it).
BATCH_ROWS = 500


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, its session set to hand at most ``BATCH_ROWS`` rows at a time to Python; a smaller setting stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def give_back() -> None:
    """Return freed memory to the system, at the end of a task: idle Python workers keep what they hold otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        return


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Vertices of ``edges`` with the smallest vertex reachable from each: columns ``vertex``, ``root``.

    Alternates large-star and small-star: every round moves each vertex's links to its smallest neighbour until
    nothing moves, in a number of rounds logarithmic in the longest path. A round is an aggregate (map-side combined)
    and an equi-join, so a vertex with any share of the links is split by adaptive execution. Null ends, loops and
    repeated links are ignored. Each round is written to the shared folder.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    e = stored(e.distinct(), "links")
    state = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("x"))
        e = stored(star.select("x.u", "x.v").where("u != v").distinct(), "links")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = e.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())


class Forest:
    """Union-find over local points, fed with arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            a, b = self.root[u], self.root[v]
            apart = a != b
            if not apart.any():
                return
            u, v = u[apart], v[apart]
            high, low = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
            np.minimum.at(self.root, high, low)
            while True:
                flat = self.root[self.root]
                if (flat == self.root).all():
                    break
                self.root = flat
