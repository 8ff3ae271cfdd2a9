"""From documents to packed sequences: quality classifier, near-dedup, substring dedup, mixing, packing.

Each stage takes what its predecessor kept, written as Parquet in the shared folder and read again, and returns a
DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import mixing, quality, shared, similar, substring, tokens
from textloom.llm.queries import domain_labels
from textloom.session import table

#: A document scored below this is rejected.
LEAST_SCORE = 0.7
#: Target shares of the mixture's expected tokens: what passed the classifier but looks poor or toxic is thinned out.
SHARES = {"high": 0.98, "low": 0.01, "toxic": 0.01}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier scores at LEAST_SCORE or more stay; null texts are scored as empty ones."""
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    (score,) = shared.free(docs, "score")
    return quality.scored(docs, weights, name=score).where(F.col(score) >= LEAST_SCORE).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose five-word shingles have Jaccard similarity 0.8 or more, the row with the smallest id stays (null ids last, then by text hash)."""
    return similar.one_of_each(docs, "0.8", words=5)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents lose passages of 35 words and more that come again anywhere; rows stay, and texts without a loss are unchanged."""
    return substring.replaced(docs, window=35)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its fitted rate says, so that expected tokens of the domains meet SHARES; rows without a word keep one copy."""
    return mixing.mixture(docs, domain_labels(spark, sf_dir), SHARES)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence of at most 2048 ids; null texts are empty documents, of an end id alone."""
    return tokens.pack_balanced(docs, capacity=2048, end_id=1)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("mixing to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express a trained classifier, groups that links of any length form or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = shared.save(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
        if before is not None:
            shared.drop(before)  # the next stages read this one's table alone
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
