"""Documents that resemble each other character by character, for inventories of documents."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T


def similar_documents(entries: DataFrame, key: str = "pdf_id", sample: str = "text_sample", least: float = 0.85, blocks: int = 32) -> DataFrame:
    """(id_a, id_b, similarity): ids whose fingerprints match in at least that share of their characters, id_a before id_b.

    Documents of one fingerprint are linked to the one with the smallest id, at 1.0, and that one alone is compared with
    others, so copies are not expanded into all pairs. Rows without an id or text take no part. The share has no filter
    that loses no pair but those of lengths and letter counts, so the work is quadratic in the distinct fingerprints;
    blocks spread it over blocks * (blocks + 1) / 2 tasks, each of which holds two blocks.
    """
    rows = entries.select(F.col(key).cast("string").alias("id"), F.col(sample).alias("s")).where("id <> '' and s <> ''")
    rows = rows.select("id", T.document_fingerprint(F.col("s")).alias("print"))
    prints = rows.groupBy("print").agg(F.min("id").alias("id"))
    blocked = prints.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    # each block goes to the tile of every pair of blocks that it is in
    tiles = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = tiles.select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "print")

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        low, high = tile["low"].iloc[0], tile["high"].iloc[0]
        left = list(tile[tile["block"] == low][["id", "print"]].itertuples(index=False, name=None))
        right = list(tile[tile["block"] == high][["id", "print"]].itertuples(index=False, name=None))
        found = []
        for x in left:
            for y in right:
                if low == high and x[0] >= y[0]:
                    continue
                (i, a), (j, b) = sorted((x, y))
                if 2 * min(len(a), len(b)) < least * (len(a) + len(b)):
                    continue
                m = SequenceMatcher(None, a, b)  # the share depends on the order of the two
                if m.quick_ratio() >= least and m.ratio() >= least:
                    found.append((i, j, round(m.ratio(), 4)))
        return pd.DataFrame(found, columns=["id_a", "id_b", "similarity"])

    links = tiles.groupBy("low", "high").applyInPandas(compare, "id_a string, id_b string, similarity double")
    first = prints.withColumnRenamed("id", "id_a")
    copies = rows.join(first, "print").where("id_a < id").select("id_a", F.col("id").alias("id_b"), F.lit(1.0).alias("similarity"))
    return links.unionByName(copies)


def without_duplicates(rows: DataFrame, pairs: DataFrame, key: str = "pdf_id") -> DataFrame:
    """Rows of documents that are not the second of a pair."""
    return rows.join(pairs.select(F.col("id_b").alias(key)).distinct(), key, "left_anti")
