"""Session settings for local runs; a cluster brings its own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, name: str = "lexmill") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LEXMILL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


# Wide projections of this library can compile to methods the JVM will not
# optimise; above this size Spark then runs them without whole-stage fusion.
# Small shuffles feed costly expressions, so they may keep several tasks; large
# ones are sized by total bytes over parallelism and are not affected.
RUNTIME_SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime settings above, unless the session already chose its own."""
    for name, value in RUNTIME_SETTINGS.items():
        if name not in _chosen(spark):
            spark.conf.set(name, value)
    return spark


def _chosen(spark: SparkSession) -> set[str]:
    return {name for name in RUNTIME_SETTINGS if spark.sparkContext.getConf().contains(name)}
