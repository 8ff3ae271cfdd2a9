"""Files and units of work as streams: each is processed once, and results replace their source's earlier rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import incremental

#: States after which a unit is not tried again; failed units are.
TERMINAL = ("ok", "empty", "refused")


def process_new_files(spark: SparkSession, source: str, schema, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Run over what is new in a directory of Parquet files and stop; a batch is a folder of its own, so a repeat overwrites it."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def merge_by_source(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str = "source", transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """New files replace all earlier rows of the sources they hold; run over what is new and stop.

    Batch n writes version n of the table from the newest version before it, so a batch that is repeated after a loss
    writes the same version again; latest reads the newest whole one, and the version before it is then dropped.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = transform(batch)
        before = newest(spark, target, number)
        if before is not None:
            rows = incremental.replace_by_source(spark.read.parquet(f"{target}/version={before}"), rows, key)
        rows.write.mode("overwrite").parquet(f"{target}/version={number}")
        for old in [n for n in versions(spark, target) if before is not None and n < before]:
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/version={old}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def versions(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the whole versions under a folder, those whose job ended."""
    if not _exists(spark, target):
        return []
    at = spark._jvm.org.apache.hadoop.fs.Path(target)
    names = [f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    found = [int(n.partition("=")[2]) for n in names if n.startswith("version=")]
    return sorted(n for n in found if _exists(spark, f"{target}/version={n}/_SUCCESS"))


def newest(spark: SparkSession, target: str, below: int | None = None) -> int | None:
    found = [n for n in versions(spark, target) if below is None or n < below]
    return found[-1] if found else None


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The table as of the newest whole version; ValueError before the first."""
    if (n := newest(spark, target)) is None:
        raise ValueError(f"no version in {target}")
    return spark.read.parquet(f"{target}/version={n}")


def pending(units: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Units without a terminal status in the log; a unit that failed and later ended is done."""
    done = log.where(F.col("status").isin(*TERMINAL)).select(key).distinct()
    return units.join(done, key, "left_anti")


def append_results(units: DataFrame, log_path: str, work: Callable[[DataFrame], DataFrame], key: str) -> int:
    """Work on units that the log at log_path doesn't end, in one appended write; how many were pending.

    work returns rows with key and status. A write that is lost leaves no rows, and its units are pending again.
    """
    spark = units.sparkSession
    rows = pending(units, spark.read.parquet(log_path), key) if _exists(spark, f"{log_path}/_SUCCESS") else units
    n = rows.count()
    if n:
        work(rows).write.mode("append").parquet(log_path)
    return n


def progress(log: DataFrame, units: DataFrame, key: str, seconds: float) -> DataFrame:
    """One row: total, processed, failed, remaining, rate (a second), eta_seconds (null without a rate) and state.

    A unit counts once, as processed if any of its rows is terminal; log rows of unknown units don't count.
    """
    ended = log.groupBy(key).agg(F.max(F.col("status").isin(*TERMINAL)).alias("ended"))
    joined = units.select(key).distinct().join(ended, key, "left")
    sums = joined.agg(F.count("*").alias("total"), F.count_if(F.col("ended")).alias("processed"), F.count_if(~F.col("ended")).alias("failed"))
    sums = sums.withColumn("remaining", F.col("total") - F.col("processed") - F.col("failed"))
    sums = sums.withColumn("rate", (F.col("processed") + F.col("failed")) / F.lit(max(0.001, float(seconds))))
    eta = F.when(F.col("rate") > 0, F.floor(F.col("remaining") / F.col("rate")))
    return sums.withColumns({"eta_seconds": eta, "state": F.when(F.col("remaining") > 0, "running").otherwise("complete")})
