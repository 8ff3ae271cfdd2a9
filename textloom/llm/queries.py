"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import media, mixing, omh, quality, sharding, simhash, substring, tokens, warc
from textloom.session import table


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicate(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Target shares of the mixture's expected tokens, far from what the table has (most of it is of high quality).
TARGETS = {"high": 0.6, "low": 0.3, "toxic": 0.1}


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", mixing.domain_of_labels().alias("domain"))


def op2_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixed(table(spark, sf_dir, "documents"), domain_labels(spark, sf_dir), TARGETS)
    return plan.select("doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(TARGETS)], "rate", "copies", "miss")


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shuffle(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"), radius=3, words=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pack_balanced(table(spark, sf_dir, "documents"), capacity=2048, end_id=1)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return quality.scored(docs.select("doc_id", "text"), weights).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pack_matrices(table(spark, sf_dir, "documents"), capacity=2048, end_id=1)


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.fingerprint_edits(table(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc_revisits, op2_soft_mixing, op3_feistel_shards, op4_simhash_groups, op5_cost_packing, op6_quality, op7_substring_dedup, op8_token_matrices, op9_order_minhash, op10_media_columns)}

#: DuckDB SQL where it can express the operator.
ORACLES = {
    "op1_warc_revisits": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
        FROM m""",
}
