"""Quality classifier: positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled rows of quality 1; unlabelled web text is any document. The class prior is estimated
from the labelled rows. A linear model over hashed byte pairs and a few shape features is fitted by minimising
prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)) (Kiryo and others, 2017), on samples whose
expected sizes are parameters; scoring then streams over every document, whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import shared

DIMS = 4096
SHAPES = 6
#: The few shape features stand beside thousands of byte pairs: each counts as this many times its spread.
WEIGHT = 8.0


def pair_ids(text: bytes) -> np.ndarray:
    """A hashed feature for each pair of neighbouring bytes; line ends count as one before and one behind the text."""
    x = np.frombuffer(b"\n" + text + b"\n", np.uint8).astype(np.uint32)
    return (((x[:-1] << 8) | x[1:]) * np.uint32(2654435761)) >> np.uint32(20)


def shapes(text: bytes) -> np.ndarray:
    """Shares of words that repeat the one before, of repeated words and of repeated lines; word length; two measures of length."""
    words, lines = text.split(), text.split(b"\n")
    n = max(1, len(words))
    again = sum(map(bytes.__eq__, words, words[1:])) / n
    return np.array([again, 1 - len(set(words)) / n, 1 - len(set(lines)) / len(lines), min(1.0, len(text) / n / 40), np.log1p(len(words)) / 16, 1 / n], np.float32)


def vector(text: bytes) -> np.ndarray:
    ids = pair_ids(text)
    return np.concatenate([np.bincount(ids, minlength=DIMS).astype(np.float32) / len(ids), shapes(text)])


class Rows:
    """Vectors by their values other than zero, which are few; made one float32 matrix of chosen columns when all are there."""

    def __init__(self):
        self.at, self.values, self.seen = [], [], np.zeros(DIMS + SHAPES, bool)

    def add(self, vector: np.ndarray) -> None:
        at = np.nonzero(vector)[0].astype(np.uint16)
        self.seen[at] = True
        self.at.append(at)
        self.values.append(vector[at])

    def matrix(self, used: np.ndarray) -> np.ndarray:
        """The columns used, in order; the rows are let go."""
        to = np.cumsum(used) - 1
        out = np.zeros((len(self.at), int(used.sum())), np.float32)
        for row, at, values in zip(out, self.at, self.values):
            row[to[at]] = values
        self.at, self.values = [], []
        return out


def fit_rows(p: Rows, u: Rows, prior: float) -> np.ndarray:
    """fit over the columns that any row has: one that is zero in all rows is constant, and its weight stays zero."""
    used = p.seen | u.seen
    used[DIMS:] = True
    w = fit(p.matrix(used), u.matrix(used), prior)
    return np.append(np.bincount(np.nonzero(used)[0], w[:-1], DIMS + SHAPES), w[-1])


def fit(p: np.ndarray, u: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.02, decay: float = 1e-3) -> np.ndarray:
    """Weights (the bias last) of a linear model of relative byte-pair frequencies and shapes, by Adam on the non-negative risk.

    p, u (float32): vectors of positives and of unlabelled rows; they are standardised in place, so one copy is held.
    """
    n = len(p) + len(u)
    mean = (p.sum(axis=0, dtype=np.float64) + u.sum(axis=0, dtype=np.float64)) / n
    for x in (p, u):
        x -= mean.astype(np.float32)
    scale = np.sqrt((np.einsum("ij,ij->j", p, p) + np.einsum("ij,ij->j", u, u)) / n) + 1e-4
    scale[-SHAPES:] /= WEIGHT
    for x in (p, u):
        x /= scale
    norm = float(np.sqrt(np.einsum("ij,ij->", u, u) / len(u))) or 1.0
    for x in (p, u):
        x /= np.float32(norm)
    w, b = np.zeros(p.shape[1], np.float32), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, rounds + 1):
        zp, zu = (p @ w).astype(np.float64) + b, (u @ w).astype(np.float64) + b
        gp = (sigmoid(zp) - 1) / len(p)  # of the positives' risk as positives
        gn = sigmoid(zp) / len(p)  # of the positives' risk as negatives
        gu = sigmoid(zu) / len(u)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if negative >= 0:
            at_p, at_u = prior * (gp - gn), gu
        else:  # the estimate of the negatives' risk fell below zero: step back
            at_p, at_u = prior * gn, -gu
        g = np.append(p.T @ at_p.astype(np.float32) + u.T @ at_u.astype(np.float32) + decay * w, at_p.sum() + at_u.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1].astype(np.float32), b - step[-1]
    weights = w / (scale * norm)
    return np.append(weights, b - float(weights @ mean)).astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, positives: int = 6000, unlabelled: int = 6000, seed: int = 11) -> np.ndarray:
    """Fit on rows whose crc32(doc_id) mod 4 is not 2, on positives trusted ids and an expected number of unlabelled rows.

    labels: doc_id, quality. Rows with null ids, and labels other than 0 and 1, are not learnt from. Without a labelled
    row or a document the model is the prior alone.
    """
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(learn & F.col("quality").isin(0, 1))
    count = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("p")).first()
    prior = min(0.98, max(0.02, (count["p"] + 1) / (count["n"] + 2)))
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).where(learn)
    n = table.count()
    shared.bound_batches(docs.sparkSession)
    # ids drawn by hash: as many at most as asked for, so they can be sent to every task
    drawn = known.where("quality = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(positives)
    good = table.join(F.broadcast(drawn), "doc_id").select("text", F.lit(1).alias("y"))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    web = table.where(chance < unlabelled / max(n, 1)).select("text", F.lit(0).alias("y"))

    def vectors(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([vector(t.as_py()).tobytes() for t in b.column("text")], pa.binary())], names=["y", "x"])

    def learned(batches):
        import pyarrow as pa

        held = {1: Rows(), 0: Rows()}
        for b in batches:
            for y, v in zip(b.column("y").to_pylist(), b.column("x")):
                held[y].add(np.frombuffer(v.as_buffer(), np.float32))
        if held[0].at and held[1].at:
            yield pa.RecordBatch.from_arrays([pa.array([fit_rows(held[1], held[0], prior).tobytes()], pa.binary())], names=["w"])

    sample = good.union(web).mapInArrow(vectors, "y int, x binary")
    # repartitioned, not coalesced: the scan stays parallel and one task gets the drawn vectors alone
    found = sample.repartition(1).mapInArrow(learned, "w binary").collect()
    return np.frombuffer(found[0]["w"], np.float64) if found else np.append(np.zeros(DIMS + SHAPES), np.log(prior / (1 - prior)))


def scored(docs: DataFrame, weights: np.ndarray, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a score in 0..1 for each whole text, null as empty; a column of that name is replaced."""
    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        w, shape, b = weights[:DIMS], weights[DIMS:-1], weights[-1]
        z = np.array([w[pair_ids(t)].mean() + shapes(t) @ shape + b for t in map(bytes, text)])
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.withColumn(name, score(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))
