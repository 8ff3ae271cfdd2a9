"""Evaluation: null-skipping summaries, pivots, telemetry, gates and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import ordered


def summary(rows: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """For each group: rows, and count, mean, least and greatest of each metric; nulls and NaN are left out."""
    out = [F.count("*").alias("n_rows")]
    for m in metrics:
        x = F.when(F.isnan(m), None).otherwise(F.col(m))
        out += [F.count(x).alias(f"{m}_n"), F.avg(x).alias(f"{m}_mean"), F.min(x).alias(f"{m}_min"), F.max(x).alias(f"{m}_max")]
    return rows.groupBy(by).agg(*out)


def wide(rows: DataFrame, key: str, label: str, labels: list[str], value: Column, base: str) -> DataFrame:
    """A row for each key, a column for each label; base comes from the first label in order that has the key."""
    named = rows.groupBy(key).pivot(label, labels).agg(value)
    first = rows.groupBy(key).agg(F.min_by(base, label).alias(base))
    return named.join(first, key)


def rate(total: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, total / seconds).otherwise(F.lit(0.0))


def telemetry(rows: DataFrame, by: str) -> DataFrame:
    """Tokens in and out, latency, and tokens a second, guarded against no latency."""
    out = rows.groupBy(by).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("latency").alias("latency"))
    return out.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")).withColumn("tokens_per_second", rate(F.col("output_tokens").cast("double"), F.col("latency")))


def weighted_mean(rows: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    return rows.groupBy(by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"), F.avg((F.col(value) < 0.15).cast("double")).alias("low_rate"))


def gate(scores: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """verdict: reject if any score is missing or under its threshold."""
    bad = F.lit(False)
    for name, least in thresholds.items():
        bad = bad | F.col(name).isNull() | (F.col(name) < least)
    return scores.withColumn("verdict", F.when(bad, "reject").otherwise("accept"))


def messages(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Conversations as arrays of (role, content) in turn order."""
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy(key).agg(F.transform(rows, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def explode_pairs(pairs: DataFrame, key: str, items: str) -> DataFrame:
    """One row for each item, with an id of the key and a three-digit number from 0."""
    rows = pairs.select(key, F.posexplode(items).alias("i", "item"))
    return rows.select(key, F.format_string("%s_qa_%03d", F.col(key).cast("string"), F.col("i")).alias("qa_id"), "item")


def examples(rows: DataFrame, order: list, n: int = 10) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def running_sample(pages: DataFrame, until: int = 3000, cut: int = 2000) -> DataFrame:
    """Text of a source's first pages until so many characters, cut."""
    before = ordered.summed_before(pages, F.col("source"), "page", F.length("text"), "before").where(F.col("before") < until)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: x["text"])
    return before.groupBy("source").agg(F.substring(F.array_join(parts, "\n"), 1, cut).alias("sample"))


def cost(rows: DataFrame, input_tokens: Column, output_tokens: Column, input_price: float, output_price: float) -> DataFrame:
    """Totals of tokens and their price, prices by a million."""
    out = rows.agg(F.count("*").alias("n"), F.sum(input_tokens).alias("input_tokens"), F.sum(output_tokens).alias("output_tokens"))
    return out.withColumn("cost", (F.col("input_tokens") * F.lit(input_price) + F.col("output_tokens") * F.lit(output_price)) / F.lit(1e6))


def long_rows(records: DataFrame, label: str, arrays: list[str]) -> DataFrame:
    """Evaluation records of one model as flat rows; arrays are joined by semicolons."""
    return records.withColumns({c: F.array_join(c, ";") for c in arrays}).withColumn("model", F.lit(label))


def combined(*counts: DataFrame) -> DataFrame:
    """Counters (key, n) added up."""
    rows = counts[0]
    for other in counts[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("key").agg(F.sum("n").alias("n"))


def coverage(before: DataFrame, after: DataFrame, least: float = 0.3) -> DataFrame:
    """Topics whose share of rows left is under least; both tables: topic, n."""
    joined = before.join(after.withColumnRenamed("n", "left_n"), "topic", "left")
    return joined.withColumn("ratio", F.coalesce("left_n", F.lit(0)) / F.col("n")).where(F.col("ratio") < least)
