"""Connected components of links that are far too many for one machine.

Alternating large-star and small-star rounds (Kiveris and others, "Connected components in MapReduce and beyond", 2014).
Each round is two aggregations; its links are written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import shared

#: Links up to this number are joined by one task; the bound is a constant, whatever the input.
SMALL = 200_000


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For n points and links (u, v), the smallest point that each one reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def _local(batches):
    """Replace each batch's links by one from each node to the smallest that it reaches there."""
    import pandas as pd

    for pdf in batches:
        nodes, at = np.unique(np.concatenate([pdf.u.to_numpy(), pdf.v.to_numpy()]), return_inverse=True)
        label = forest(at[: len(pdf)], at[len(pdf) :], len(nodes))
        own = label != np.arange(len(nodes))
        yield pd.DataFrame({"u": nodes[own], "v": nodes[label[own]]})


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of the links (u long, v long); component is the smallest node that it reaches.

    Links of a node with itself and repeated links are allowed; an empty table gives an empty one. Nulls are not.
    """
    links = shared.save(links.select("u", "v").mapInPandas(_local, "u long, v long").distinct(), name)
    spark = links.sparkSession
    n = links.count()
    if n <= SMALL:
        done = links.coalesce(1).mapInPandas(lambda it: _local(_joined(it)), "u long, v long")
        return _with_roots(shared.save(done, name))
    before = None
    while True:
        # large-star: each node's larger neighbours go to its smallest neighbour, or to itself
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small-star: each node and its smaller neighbours go to the smallest of them
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        new = shared.save(small, name)
        state = new.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        shared.drop(links)
        links = new
        if state == before:
            return _with_roots(links)
        before = state


def _joined(batches):
    import pandas as pd

    all_of = list(batches)
    if all_of:
        yield pd.concat(all_of, ignore_index=True)


def _with_roots(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select("v", "v").distinct())
