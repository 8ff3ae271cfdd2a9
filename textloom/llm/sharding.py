"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

A row's number is its rank by id (ties by text hash); its place in the shuffle is the permuted number, its shard the
place modulo the number of shards and its slot the quotient. Anyone who knows (row, rows, shards, seed) can compute shard
and slot, and back, without the table. Only ids, sizes and hashes are sorted, never texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import shared


class Permutation:
    """A keyed bijection of 0..n-1: a balanced Feistel network on the next even number of bits, walked until below n."""

    def __init__(self, n: int, seed: int = 42, rounds: int = 8):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        state = np.random.Generator(np.random.PCG64(seed))
        self.keys = state.integers(0, 1 << 63, size=rounds, dtype=np.uint64)

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & self.mask

    def _pass(self, x: np.ndarray, keys) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in keys:
            left, right = right, left ^ self._round(right, key)
        return (right << np.uint64(self.half)) | left

    def _walk(self, x, keys) -> np.ndarray:
        out = self._pass(np.asarray(x, dtype=np.uint64), keys)
        while (outside := out >= self.n).any():
            out[outside] = self._pass(out[outside], keys)
        return out.astype(np.int64)

    def place(self, rows) -> np.ndarray:
        return self._walk(rows, self.keys)

    def row(self, places) -> np.ndarray:
        return self._walk(places, self.keys[::-1])


def shard_and_slot(rows, n: int, shards: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of global row numbers, computable anywhere."""
    place = Permutation(n, seed).place(rows)
    return place % shards, place // shards


def numbered(narrow: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Add row (0..n-1 in the order of the keys, nulls first) without a task that sees all rows; returns n too.

    Equal keys are split by arrival, which only matters to rows that are equal anyway.
    """
    spark = narrow.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = narrow.withColumn("_tie", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(n, *keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    # written once: another job's sample could cut the ranges elsewhere
    placed = shared.save(placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "numbered")
    counts = placed.groupBy("_part").count().orderBy("_part").collect()  # a row for each shuffle partition
    starts = np.cumsum([0, *(r["count"] for r in counts)])
    offsets = spark.createDataFrame([(r["_part"], int(s)) for r, s in zip(counts, starts)], "_part int, _start long")
    return placed.join(F.broadcast(offsets), "_part").withColumn("row", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start"), int(starts[-1])


def shuffle(docs: DataFrame, shards: int = 40, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, row, shard, slot) for each row of docs; counts of any two shards differ by one at most.

    size is the text's UTF-8 bytes plus 16; a null text counts as empty. Null ids come first. Rows with equal id and text
    are interchangeable and take adjacent row numbers. An empty table gives an empty one; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_hash"))
    rows, n = numbered(narrow, ["doc_id", "text_crc32", "size", "_hash"])

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(Permutation(n, seed).place(row.to_numpy()))

    placed = rows.withColumn("_place", place("row"))
    return placed.select("doc_id", "size", "text_crc32", "row", (F.col("_place") % shards).cast("int").alias("shard"), F.floor(F.col("_place") / F.lit(shards)).cast("long").alias("slot"))
