"""Incremental processing: what changed, what to replace, what is done."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T


def resume(rows: DataFrame, done: DataFrame, key: str, failed: str | None = None) -> DataFrame:
    """Rows not done yet; rows whose failure column is set count as not done."""
    finished = done.where(F.coalesce(F.col(failed), F.lit("")) == "") if failed else done
    return rows.join(finished.select(key).distinct(), key, "left_anti")


def changed(files: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Files that the manifest lacks or knows with another size or time; both: source_path, file_size, mtime."""
    old = manifest.select("source_path", F.col("file_size").alias("_size"), F.col("mtime").alias("_mtime"))
    joined = files.join(old, "source_path", "left")
    same = F.col("file_size").eqNullSafe(F.col("_size")) & F.col("mtime").eqNullSafe(F.col("_mtime"))
    return joined.where(F.lit(force) | ~same).select(*files.columns)


def replace_by_source(old: DataFrame, new: DataFrame, source: str = "source") -> DataFrame:
    """Old rows of other sources, and all new rows."""
    return old.join(new.select(source).distinct(), source, "left_anti").unionByName(new)


def new_chunks(batch: DataFrame, known: DataFrame, order: list, text: str = "text") -> DataFrame:
    """Chunks of a batch whose near key is neither known nor earlier in the batch."""
    key = T.near_key(F.col(text), "spanish")
    first = batch.withColumn("_key", key).withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).where("_n = 1").drop("_n")
    return first.join(known.select(key.alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def upsert(manifest: DataFrame, entries: DataFrame, key: str, order: str) -> DataFrame:
    """Last write wins; of equally late rows one of entries, then the one with the larger JSON."""
    rows = manifest.withColumn("_new", F.lit(0)).unionByName(entries.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("_new"), F.desc(F.to_json(F.struct(*manifest.columns))))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def fill_missing(rows: DataFrame, values: dict[str, str]) -> DataFrame:
    """Provenance where it is null or empty."""
    return rows.withColumns({k: F.coalesce(F.nullif(F.col(k), F.lit("")), F.lit(v)) for k, v in values.items()})
