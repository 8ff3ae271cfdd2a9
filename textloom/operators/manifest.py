"""An inventory of documents: what is excluded and why, counts by kind, and its form as JSON.

Entries have pdf_id, source_pdf, doc_type, ocr_status, inclusion_status, exclusion_reason and exclusion_details.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The states in which a document is left out.
EXCLUDED = ("excluded", "excluded_with_reason")
ENTRY = "pdf_id string, source_pdf string, doc_type string, ocr_status string, inclusion_status string, exclusion_reason string, exclusion_details string"


def included(entries: DataFrame, wanted: bool = True) -> DataFrame:
    """Entries that are included, or those that aren't; without a state a document is included."""
    out = F.coalesce(F.col("inclusion_status").isin(*EXCLUDED), F.lit(False))
    return entries.where(~out if wanted else out)


def excluded_ids(entries: DataFrame) -> DataFrame:
    """(pdf_id): each excluded document once; a missing id is the empty one."""
    return included(entries, False).select(F.coalesce("pdf_id", F.lit("")).alias("pdf_id")).distinct()


def without_excluded(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows of documents that aren't excluded; rows without an id stay."""
    return rows.join(excluded_ids(entries), "pdf_id", "left_anti")


def of_type(entries: DataFrame, kind: str) -> DataFrame:
    return entries.where(F.col("doc_type") == kind)


def distributions(entries: DataFrame, names: tuple[str, ...] = ("doc_type", "ocr_status", "inclusion_status")) -> DataFrame:
    """(kind, value, n): how many entries have each value; nulls are unknown. One pass for all kinds."""
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), F.coalesce(F.col(c), F.lit("unknown")).alias("value")) for c in names])
    return entries.select(F.explode(pairs).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def exclusion_totals(entries: DataFrame) -> DataFrame:
    """One row: total_documents, excluded_count, included_count and exclusion_rate to four digits (0 for an empty inventory)."""
    out = F.coalesce(F.col("inclusion_status").isin(*EXCLUDED), F.lit(False)).cast("long")
    sums = entries.agg(F.count("*").alias("total_documents"), F.coalesce(F.sum(out), F.lit(0)).alias("excluded_count"))
    rate = F.round(F.col("excluded_count") / F.greatest(F.col("total_documents"), F.lit(1)), 4)
    return sums.withColumns({"included_count": F.col("total_documents") - F.col("excluded_count"), "exclusion_rate": rate})


def exclusion_rows(entries: DataFrame) -> DataFrame:
    """(reason, pdf_id, source_pdf, details): a row for each excluded document; a missing reason is unknown."""
    reason = F.coalesce("exclusion_reason", F.lit("unknown")).alias("reason")
    return included(entries, False).select(reason, "pdf_id", "source_pdf", F.col("exclusion_details").alias("details"))


def exclusion_counts(entries: DataFrame) -> DataFrame:
    """(reason, n): excluded documents by reason; the documents themselves stay rows (see exclusion_rows), as lists of them may be long."""
    return exclusion_rows(entries).groupBy("reason").agg(F.count("*").alias("n"))


def upsert(entries: DataFrame, newer: DataFrame) -> DataFrame:
    """entries with those of newer in place of theirs; newer has each id once."""
    return entries.join(newer.select("pdf_id"), "pdf_id", "left_anti").unionByName(newer)


def save(entries: DataFrame, path: str) -> None:
    """A JSON object for each entry, nulls written out."""
    entries.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Entries that save wrote; an empty inventory where the path does not exist."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).json(path)
