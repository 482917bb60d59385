"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: For plans whose sorts hold most of a shuffle partition: shuffles start in many partitions, which adaptive execution joins
#: up to this size, so the memory of a task follows the size and not the table; scans combine rows in smaller splits.
SPREAD_CONF = {
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "800",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


def tune(spark: SparkSession, spread: bool = False) -> SparkSession:
    """Apply the runtime settings every plan assumes; sizing stays with the cluster unless the plan is to be ``spread``."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    for key, value in SPREAD_CONF.items():
        if spread:
            spark.conf.set(key, value)
        elif spark.conf.get(key, None) == value:
            spark.conf.unset(key)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def local_session(cpus: int = 8, app: str = "barloom") -> SparkSession:
    """Single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str | None:
    """Shared checkpoint folder named by the cluster, if one is set."""
    return spark.conf.get("spark.checkpoint.dir", None)
