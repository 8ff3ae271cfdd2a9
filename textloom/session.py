"""Spark sessions with the settings that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that hold at any size; cluster sizing (executors, memory, shuffle partitions) is left to the caller.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, memory: str = "8g", partitions: int | None = None, **conf: str) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("textloom").config("spark.driver.memory", memory)
    settings = DEFAULTS | {"spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": str(partitions or cpus)} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the data directory's tables; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
